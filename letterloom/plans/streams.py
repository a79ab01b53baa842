"""Queries that run a streaming job over a given table and read what it keeps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from letterloom.operators import feed, store
from letterloom.plans import corpora as C
from letterloom.plans.registry import query
from letterloom.plans.sql_views import MSG, SOURCES, with_views
from letterloom.plans.state import LOG, OFFSETS, page_offsets
from letterloom.session import fresh_path
from letterloom.streaming import bulk, consumers, jobs


BATCHES = 3


def _thirds(df) -> Column:
    """Which third of its days a row falls into, from 0."""
    span = df.agg(F.min(F.to_date("ts")).alias("lo"), F.max(F.to_date("ts")).alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    return F.floor(F.date_diff(F.to_date("ts"), lo) * BATCHES / (F.date_diff(hi, lo) + 1)).cast("int")


def _landed(spark, df, part):
    """``df`` as a stream that lands in three parts: after each the stream over what is there so far.

    A job is started again for every part and reads what is new as one batch. A part is as many
    files as tasks wrote it.
    """
    base = fresh_path(spark, "landed")
    for n in range(BATCHES):
        df.where(part == n).write.parquet(f"{base}/{n}")
        yield spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(base)


def _table_stream(spark, folder):
    events = C.table(spark, folder, "events")
    return _landed(spark, events, _thirds(events))


def _events(spark, folder):
    for stream in _table_stream(spark, folder):
        yield stream.selectExpr(
            "concat('h:', event_id) AS id", "concat('h', user_id % 3) AS source", "concat('t', user_id) AS thread_id",
            "CAST(ts AS TIMESTAMP) AS ts", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS date", "event_type AS subject")


EV = """WITH ev AS (SELECT 'h:' || event_id AS id, 'h' || (user_id % 3) AS source, 't' || user_id AS thread_id, ts, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS date FROM events)
"""


@query("stream_feed", EV + "SELECT id, source, date FROM ev")
def stream_feed(spark, folder):
    """Notices appended to a table, each id once."""
    out, checkpoint = jobs.working_paths(spark, "feed")
    for events in _events(spark, folder):
        jobs.append(jobs.deduplicated(events).select("id", "source", "date"), out, checkpoint)
    return spark.read.parquet(out)


@query("stream_upsert", EV + "SELECT source, max(date) AS date, arg_max(id, row(date, id)) AS last FROM ev GROUP BY source")
def stream_upsert(spark, folder):
    """The latest notice per source, kept by an upsert."""
    out, checkpoint = jobs.working_paths(spark, "upsert")
    for events in _events(spark, folder):
        stream = events.select(F.col("source").alias("id"), F.col("id").alias("last"), F.struct("date", "id").alias("date"))
        jobs.upsert_messages(stream, out, checkpoint)
    return jobs.latest(spark, out).select(F.col("id").alias("source"), F.col("date.date").alias("date"), "last")


@query("stream_offsets", EV + "SELECT 'reader' AS key, source, max(date) AS ts FROM ev GROUP BY source")
def stream_offsets(spark, folder):
    out, checkpoint = jobs.working_paths(spark, "offsets")
    for events in _events(spark, folder):
        jobs.follow(events, "reader", out, checkpoint)
    return jobs.snapshot(spark, out)


PARTS = """, span AS (SELECT min(CAST(ts AS DATE)) AS lo, max(CAST(ts AS DATE)) AS hi FROM events),
parts AS (SELECT ev.*, (date_diff('day', lo, CAST(ts AS DATE)) * 3) // (date_diff('day', lo, hi) + 1) AS part FROM ev, span)
"""


@query("stream_refs", EV + PARTS + "SELECT id, row_number() OVER (ORDER BY part, date DESC, id) AS ref FROM parts")
def stream_refs(spark, folder):
    """Numbers batch by batch, newest first in each."""
    out, checkpoint = jobs.working_paths(spark, "refs")
    for events in _events(spark, folder):
        jobs.number_refs(events, out, checkpoint)
    return jobs.refs(spark, out)


@query("stream_usage", LOG + """
SELECT command, source, count(*) AS calls, CAST(sum(bytes_in) AS BIGINT) AS bytes_in, CAST(sum(bytes_out) AS BIGINT) AS bytes_out, CAST(sum(messages) AS BIGINT) AS messages FROM log GROUP BY ALL""")
def stream_usage(spark, folder):
    out, checkpoint = jobs.working_paths(spark, "usage")
    for items in _landed(spark, C.table(spark, folder, "lineitem"), F.col("l_orderkey") % BATCHES):
        jobs.usage_counters(items.selectExpr(
            "l_returnflag AS command", "l_linestatus AS source", "CAST(l_extendedprice AS BIGINT) AS bytes_in",
            "CAST(l_extendedprice * l_discount AS BIGINT) AS bytes_out", "CAST(l_quantity AS BIGINT) AS messages"), out, checkpoint)
    return jobs.snapshot(spark, out)


@query("stream_meters", """
SELECT 'h' || (user_id % 4) AS source, arg_max(event_type || '=' || event_id, row(ts, event_id)) AS meters FROM events GROUP BY 1""")
def stream_meters(spark, folder):
    out, checkpoint = jobs.working_paths(spark, "meters")
    for events in _table_stream(spark, folder):
        jobs.last_meters(events.selectExpr(
            "concat('h', user_id % 4) AS source", "struct(ts, event_id) AS polled_at", "array(struct(event_type AS label, event_id AS count, '' AS link)) AS meters"), out, checkpoint)
    first = F.col("meters")[0]
    return jobs.snapshot(spark, out).select("source", F.concat(first["label"], F.lit("="), first["count"].cast("string")).alias("meters"))


@query("stream_window_counts", EV + """
SELECT source, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS count FROM ev GROUP BY ALL
HAVING date_trunc('day', max(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) FROM ev) - INTERVAL 1 DAY""")
def stream_window_counts(spark, folder):
    """Notices per source and day, for the days that are final."""
    out, checkpoint = jobs.working_paths(spark, "windows")
    for events in _events(spark, folder):
        counts = jobs.window_counts(events)
        jobs.append(counts.select("source", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "count"), out, checkpoint)
    return spark.read.parquet(out)


@query("stream_sessions", EV + """
, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM ev WINDOW w AS (PARTITION BY thread_id ORDER BY ts)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY thread_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT thread_id, strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') AS first, count(*) AS count FROM s GROUP BY thread_id, n
HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM ev) - INTERVAL 1 DAY""")
def stream_sessions(spark, folder):
    """Bursts of notices per thread, for those that are over."""
    out, checkpoint = jobs.working_paths(spark, "sessions")
    for events in _events(spark, folder):
        found = jobs.sessions(events)
        jobs.append(found.select("thread_id", F.date_format("session_window.start", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("first"), "count"), out, checkpoint)
    return spark.read.parquet(out)


# Polls: the messages land in three files, one after the other, and all consumers read after each.
POLLS = 3


def _poll_sql(polls: int) -> str:
    """Polls one by one: what is due by the offsets so far, the page, and where the offsets go."""
    ctes = ["seen0 AS (SELECT key, source, ts FROM offsets)"]
    for n in range(1, polls + 1):
        ctes.append(f"""page{n} AS (SELECT keys.key, k, msg.*, row_number() OVER (PARTITION BY keys.key ORDER BY date DESC, source_ord, seq) AS place
  FROM keys CROSS JOIN msg LEFT JOIN seen{n - 1} o ON o.key = keys.key AND o.source = msg.source WHERE seq % {polls} < {n} AND date >= coalesce(o.ts, '2001-07-26T00:00:00Z')),
per{n} AS (SELECT key, source, any_value(k) AS k, count(*) FILTER (place <= 60) AS r, count(*) FILTER (place > 60) AS d, min(date) FILTER (place <= 60) AS lo, max(date) FILTER (place <= 60) AS hi FROM page{n} GROUP BY key, source),
new{n} AS (SELECT key, source, CASE WHEN d > 0 THEN lo ELSE hi END AS ts FROM per{n} WHERE r > 0 AND (d = 0 OR k % 2 = 0)),
seen{n} AS (SELECT coalesce(n.key, o.key) AS key, coalesce(n.source, o.source) AS source, coalesce(n.ts, o.ts) AS ts FROM seen{n - 1} o FULL JOIN new{n} n ON n.key = o.key AND n.source = o.source)""")
    return with_views(MSG, SOURCES) + OFFSETS.replace("due AS", "due0 AS").replace("FROM due)", "FROM due0)") + ", " + ", ".join(ctes)


def _polled(spark, folder):
    """What all consumers read over the polls, restarted after each. Every other one is lossless."""
    base = fresh_path(spark, "polls")
    keys = C.table(spark, folder, "region").selectExpr("r_name AS key", "if(r_regionkey % 2 = 0, 'compatible', 'lossless') AS policy")
    follows = feed.followed(keys, page_offsets(spark, folder), C.sources(spark), "2001-07-26T00:00:00Z").join(keys, "key")
    messages = C.messages(spark, folder).select("source", "date", "seq", "id")
    for n in range(POLLS):
        messages.where(F.col("seq") % POLLS == n).write.parquet(f"{base}/landed/{n}")
        stream = spark.readStream.schema(messages.schema).option("recursiveFileLookup", "true").parquet(f"{base}/landed")
        consumers.read_pages(stream, follows, 60, f"{base}/table", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/table")


@query("stream_pages", _poll_sql(POLLS) + " UNION ALL ".join(
    f" SELECT key, {n} AS poll, id, place FROM page{n} WHERE place <= 60" for n in range(1, POLLS + 1)))
def stream_pages(spark, folder):
    """The page of every consumer at each of three polls."""
    return consumers.delivered(_polled(spark, folder)).select("key", F.col("poll").cast("int").alias("poll"), "id", "place")


@query("stream_page_offsets", _poll_sql(POLLS) + f" SELECT key, source, ts FROM seen{POLLS}")
def stream_page_offsets(spark, folder):
    """The offsets after three polls."""
    return consumers.offsets(_polled(spark, folder), page_offsets(spark, folder))


# Late rows: the events land in three files by their day; every seventh lands with the next third.
THIRDS = PARTS + """, shifted AS (SELECT source, ts, least(2, part + CASE WHEN CAST(id[3:] AS BIGINT) % 7 = 0 THEN 1 ELSE 0 END) AS part FROM parts),
marks AS (SELECT p.part, (SELECT max(ts) FROM shifted q WHERE q.part < p.part) - INTERVAL 1 DAY AS before FROM (SELECT DISTINCT part FROM shifted) p),
days AS (SELECT source, date_trunc('day', ts) AS day, coalesce(date_trunc('day', ts) + INTERVAL 1 DAY <= before, false) AS late FROM shifted JOIN marks USING (part))
SELECT source, strftime(day, '%Y-%m-%d') AS day, count(*) FILTER (NOT late) AS count, count(*) FILTER (late) AS late FROM days
GROUP BY source, day HAVING days.day + INTERVAL 1 DAY <= (SELECT max(ts) FROM shifted) - INTERVAL 1 DAY"""


@query("stream_late_rows", EV + THIRDS)
def stream_late_rows(spark, folder):
    """Notices per source and final day, and how many came when their day was closed already."""
    events = C.table(spark, folder, "events").selectExpr("event_id", "concat('h', user_id % 3) AS source", "CAST(ts AS TIMESTAMP) AS ts")
    part = F.least(F.lit(BATCHES - 1), _thirds(events) + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0))
    out, checkpoint = jobs.working_paths(spark, "late")
    for stream in _landed(spark, events, part):
        jobs.windows_with_late(stream, out, checkpoint)
    return jobs.windows(spark, out).select("source", F.date_format("start", "yyyy-MM-dd").alias("day"), "count", "late")


@query("bulk_load", with_views(MSG) + """
, pages AS (SELECT *, seq % 50 = 0 AS blank, seq % 9 <> 0 AS has_body FROM msg WHERE source IN ('g', 'o'))
SELECT 'history' AS job, 'done' AS status, CAST(2 AS BIGINT) AS batches, count(DISTINCT seq % 4) AS pages, count(*) FILTER (NOT blank) AS messages,
  count(*) FILTER (NOT blank AND has_body) AS bodies, count(*) FILTER (blank) AS skipped FROM pages""")
def bulk_load(spark, folder):
    """A load of four pages that is stopped after two and started again."""
    base = fresh_path(spark, "bulk")
    messages = C.messages(spark, folder).where("provider IN ('gmail', 'o365')").withColumn("page", (F.col("seq") % 4).cast("string"))
    texts = messages.where("seq % 9 <> 0").select("id", "body")
    landed = messages.withColumn("id", F.expr("if(seq % 50 = 0, NULL, id)")).drop("_schema_version")
    for n in range(2):
        landed.where(F.col("page").isin(str(2 * n), str(2 * n + 1))).write.parquet(f"{base}/landed/{n}")
        stream = spark.readStream.schema(landed.schema).option("recursiveFileLookup", "true").parquet(f"{base}/landed")
        headers = store.stamped(stream, C.sources(spark), F.lit("2001-08-02"))
        bulk.load(headers, "history", f"{base}/table", f"{base}/checkpoint", lambda rows: rows.select("id", "mailbox").join(texts, "id"))
    return bulk.report(spark, f"{base}/table").drop("error")
