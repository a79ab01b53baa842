"""Queries over threads, chats and overviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from letterloom.functions import dates
from letterloom.operators import feed, overview, store, threads
from letterloom.plans import corpora as C
from letterloom.plans.messages import M, MCS, RESOLVED
from letterloom.plans.registry import query
from letterloom.plans.sql_views import CHAT, MSG, SOURCES, with_views

ROLLUP = M + """
, keyed AS (SELECT *, coalesce(thread_id, source || ':' || chat_jid, id) AS k FROM msg),
firsts AS (SELECT k, sender, min(seq) AS s, row_number() OVER (PARTITION BY k ORDER BY min(seq)) AS r FROM keyed GROUP BY k, sender),
heads AS (SELECT k, string_agg(sender, ',' ORDER BY r) FILTER (WHERE r <= 3) || CASE WHEN count(*) > 3 THEN '+' || (count(*) - 3) ELSE '' END AS participants,
  count(*) AS participant_count FROM firsts GROUP BY k)
SELECT k AS id, k AS thread_id, min(source) AS source, arg_min(subject, row(date, seq)) AS subject, any_value(participants) AS participants,
  any_value(participant_count) AS participant_count, count(*) AS message_count, min(date) AS first_date, max(date) AS date,
  arg_max(CASE WHEN snippet <> '' THEN snippet ELSE body END, row(date, -seq)) AS snippet, bool_or(unread) AS unread, min(seq) AS first_seq
FROM keyed JOIN heads USING (k) GROUP BY k"""


@query("thread_rollup", ROLLUP)
def thread_rollup(spark, folder):
    """Every thread of the corpus as one row."""
    return threads.collapse_threads(C.messages(spark, folder))


@query("thread_page", M + """
, page AS (SELECT *, row_number() OVER (ORDER BY date DESC, source_ord, seq) AS place FROM msg QUALIFY place <= 200)
SELECT coalesce(thread_id, source || ':' || chat_jid, id) AS id, count(*) AS message_count, min(date) AS first_date,
  max(date) AS date, bool_or(unread) AS unread, min(place) AS first_seq FROM page GROUP BY ALL""")
def thread_page(spark, folder):
    """Threads of the newest 200 messages: counts describe the page, not the corpus."""
    page = feed.listed(C.messages(spark, folder), 200)
    return threads.collapse_threads(page, "place").select(
        "id", "message_count", "first_date", "date", "unread", F.col("first_seq").cast("bigint").alias("first_seq"))


@query("thread_participants", M + """
, firsts AS (SELECT source AS thread_id, sender, min(seq) AS s FROM msg GROUP BY ALL)
SELECT thread_id, sender, row_number() OVER (PARTITION BY thread_id ORDER BY s) AS ord FROM firsts""")
def thread_participants(spark, folder):
    """All senders in order; a whole source is one thread here, so the threads are large."""
    df = C.messages(spark, folder).withColumn("thread_id", F.col("source"))
    return threads.thread_participants(df).withColumn("ord", F.col("ord").cast("bigint"))


@query("thread_index", M + """
SELECT id, coalesce(thread_id, source || ':' || chat_jid, id) AS thread_id,
  row_number() OVER (PARTITION BY coalesce(thread_id, source || ':' || chat_jid, id) ORDER BY date, seq) AS idx FROM msg""")
def thread_index(spark, folder):
    return threads.in_thread(C.messages(spark, folder)).select("id", "thread_id", F.col("idx").cast("bigint").alias("idx"))


CHATS = with_views(CHAT)


@query("chat_context", CHATS + """
SELECT id, array_to_string(list(id) OVER (PARTITION BY chat_jid ORDER BY date, seq ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), ' ') AS before,
  array_to_string(list(id) OVER (PARTITION BY chat_jid ORDER BY date, seq ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING), ' ') AS after
FROM chat""")
def chat_context(spark, folder):
    ids = lambda c: F.array_join(F.transform(c, lambda x: x["id"]), " ")
    return threads.context(C.chat(spark, folder), ["chat_jid"], ["date", "seq"], 10).select(
        "id", F.nullif(ids("before"), F.lit("")).alias("before"), F.nullif(ids("after"), F.lit("")).alias("after"))


@query("last_n_per_chat", M + """
SELECT id, row_number() OVER (PARTITION BY source, chat_jid ORDER BY date DESC, seq DESC) AS rank
FROM msg WHERE chat_jid IS NOT NULL QUALIFY rank <= 20""")
def last_n_per_chat(spark, folder):
    return threads.last_per_chat(C.messages(spark, folder)).select("id", F.col("rank").cast("bigint").alias("rank"))


@query("day_markers", CHATS + """
SELECT id, coalesce(date[1:10] <> lag(date[1:10]) OVER (PARTITION BY thread_id ORDER BY date, seq), true) AS new_day FROM chat""")
def day_markers(spark, folder):
    return threads.day_marks(C.chat(spark, folder)).select("id", "new_day")


@query("date_groups", M + """
, labelled AS (SELECT *, strftime(CAST(date[1:19] AS TIMESTAMP), '%-d%b%y') AS label FROM msg),
marked AS (SELECT *, CASE WHEN label = lag(label) OVER (ORDER BY date DESC, source_ord, seq) THEN 0 ELSE 1 END AS c FROM labelled)
SELECT id, label, CAST(sum(c) OVER (ORDER BY date DESC, source_ord, seq) AS BIGINT) AS run FROM marked""")
def date_groups(spark, folder):
    return threads.date_runs(C.messages(spark, folder), feed.newest_first()).select("id", "label", "run")


NAMED = """
WITH named AS (SELECT 'w:' || (c_custkey % 40) AS thread_id, c_custkey AS seq, CASE c_custkey % 5
    WHEN 0 THEN lower(c_mktsegment) || c_custkey % 3 || '@x.com' WHEN 1 THEN c_mktsegment || ' ' || c_custkey
    WHEN 2 THEN lower(c_mktsegment) || '@y' || c_custkey || '.com' WHEN 3 THEN 'Zed ' || c_custkey % 2 ELSE c_mktsegment || '1' END AS sender FROM customer),
firsts AS (SELECT thread_id, sender, min(seq) AS place FROM named GROUP BY ALL),
words AS (SELECT *, CASE WHEN contains(sender, '@') THEN split_part(sender, '@', 1) ELSE split_part(sender, ' ', 1) END AS w FROM firsts),
names AS (SELECT *, upper(w[1]) || lower(w[2:]) AS name, upper(w[1]) AS initial FROM words),
counted AS (SELECT *, count(*) OVER (PARTITION BY thread_id, initial) AS ni, count(*) OVER (PARTITION BY thread_id, name) AS nn,
  row_number() OVER (PARTITION BY thread_id, name ORDER BY place) AS k FROM names),
taken AS (SELECT thread_id, list(name) FILTER (WHERE nn = 1) AS t FROM counted GROUP BY thread_id),
free AS (SELECT counted.*, list_filter(list_transform(range(1, k + 40), lambda n: name || n), lambda x: NOT list_contains(coalesce(t, []), x)) AS f
  FROM counted JOIN taken USING (thread_id))
SELECT thread_id, sender, CASE WHEN ni = 1 THEN initial WHEN nn = 1 THEN name ELSE f[k] END AS token FROM free"""


@query("sender_tokens", NAMED)
def sender_tokens(spark, folder):
    people = C.table(spark, folder, "customer").selectExpr(
        "concat('w:', c_custkey % 40) AS thread_id", "c_custkey AS seq", """CASE c_custkey % 5
            WHEN 0 THEN concat(lower(c_mktsegment), c_custkey % 3, '@x.com') WHEN 1 THEN concat(c_mktsegment, ' ', c_custkey)
            WHEN 2 THEN concat(lower(c_mktsegment), '@y', c_custkey, '.com') WHEN 3 THEN concat('Zed ', c_custkey % 2)
            ELSE concat(c_mktsegment, '1') END AS sender""")
    return threads.sender_tokens(people)


# Overviews

TOP = RESOLVED + """
, counted AS (SELECT source, name, count(*) AS count FROM msg JOIN resolved USING (source, sender) GROUP BY ALL)
"""


@query("overview_top", RESOLVED + """
, cur AS (SELECT * FROM msg WHERE schema_version >= 3 AND (source = 'w' OR mailbox LIKE '%me@example.com')),
counted AS (SELECT source, name, count(*) AS count FROM cur JOIN resolved USING (source, sender) GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY count DESC, name) AS rank FROM counted QUALIFY rank <= 5),
tops AS (SELECT source, string_agg(name || '(' || count || ')', ', ' ORDER BY rank) AS top_senders FROM top GROUP BY source)
SELECT source, CASE source WHEN 'g' THEN 'gmail' WHEN 'o' THEN 'o365' ELSE 'whatsapp' END AS label, count(*) AS count,
  min(date)[1:7] AS date_start, max(date)[1:7] AS date_end, any_value(top_senders) AS top_senders
FROM cur JOIN tops USING (source) GROUP BY source""")
def overview_top(spark, folder):
    parts = overview.overview(C.messages(spark, folder), C.contacts(spark, folder), C.sources(spark))
    listed = parts["senders"].groupBy("source").agg(F.array_sort(F.collect_list(F.struct("rank", "name", "count"))).alias("s"))
    names = F.array_join(F.transform("s", lambda x: F.concat(x["name"], F.lit("("), x["count"].cast("string"), F.lit(")"))), ", ")
    return parts["sources"].join(listed.select("source", names.alias("top_senders")), "source")


@query("top_senders", TOP + """
SELECT source, name, count, row_number() OVER (PARTITION BY source ORDER BY count DESC, name) AS rank FROM counted QUALIFY rank <= 10""")
def top_senders(spark, folder):
    return overview.top_senders(
        C.messages(spark, folder), C.contacts(spark, folder), C.sources(spark), 10,
    ).select("source", "name", "count", F.col("rank").cast("bigint").alias("rank"))


TOP_THREADS = """
, th AS (SELECT source, thread_id, count(*) AS count, arg_min(subject, seq) AS subject FROM msg WHERE thread_id IS NOT NULL GROUP BY ALL)
SELECT source, thread_id, count, subject, row_number() OVER (PARTITION BY source ORDER BY count DESC, thread_id) AS rank FROM th
WHERE source IN (SELECT source FROM th GROUP BY source HAVING count(*) >= 3) QUALIFY rank <= 10"""


@query("top_threads", M + TOP_THREADS)
def top_threads(spark, folder):
    return overview.top_threads(C.messages(spark, folder), 10).select(
        "source", "thread_id", "count", "subject", F.col("rank").cast("bigint").alias("rank"))


@query("overview_source", RESOLVED + """
, cur AS (SELECT * FROM msg WHERE source = 'g' AND schema_version >= 3 AND mailbox = 'gmail:me@example.com' AND date >= '1998-01' AND date < '1999-01'),
snd AS (SELECT name, count(*) AS n FROM cur JOIN resolved USING (source, sender) GROUP BY ALL),
th AS (SELECT thread_id, count(*) AS n, arg_min(subject, seq) AS subject FROM cur WHERE thread_id IS NOT NULL GROUP BY ALL)
SELECT 'total' AS part, 'g' AS name, count(*) AS count, min(date)[1:7] || '..' || max(date)[1:7] AS detail FROM cur
UNION ALL SELECT 'sender', name, n, '' FROM (SELECT * FROM snd ORDER BY n DESC, name LIMIT 10)
UNION ALL SELECT 'thread', thread_id, n, subject FROM (SELECT * FROM th ORDER BY n DESC, thread_id LIMIT 10)""")
def overview_source(spark, folder):
    parts = overview.overview(
        C.messages(spark, folder), C.contacts(spark, folder), C.sources(spark), source="g", period="1998")
    total = parts["sources"].select(F.lit("total").alias("part"), F.col("source").alias("name"), "count",
                                    F.concat_ws("..", "date_start", "date_end").alias("detail"))
    senders = parts["senders"].select(F.lit("sender").alias("part"), "name", "count", F.lit("").alias("detail"))
    listed = parts["threads"].select(F.lit("thread").alias("part"), F.col("thread_id").alias("name"), "count", F.col("subject").alias("detail"))
    return total.unionByName(senders).unionByName(listed)


@query("overview_contact", MCS + """
, idents AS (SELECT lower(identifier) AS i FROM contact_ids WHERE alias = 'aa5'),
needles AS (SELECT i FROM idents UNION SELECT substr(i, instr(i, ':') + 1) FROM idents),
hit AS (SELECT DISTINCT msg.* FROM msg JOIN needles ON contains(lower(sender), i)
  WHERE schema_version >= 3 AND (source = 'w' OR mailbox LIKE '%me@example.com'))
SELECT 'source' AS part, source AS name, count(*) AS count FROM hit GROUP BY source
UNION ALL SELECT 'period', date[1:4] || '-Q' || ((CAST(date[6:7] AS INT) + 2) // 3), count(*) FROM hit GROUP BY ALL""")
def overview_contact(spark, folder):
    parts = overview.overview(C.messages(spark, folder), C.contacts(spark, folder), C.sources(spark), contact="aa5")
    totals = parts["sources"].select(F.lit("source").alias("part"), F.col("source").alias("name"), "count")
    return totals.unionByName(parts["periods"].select(F.lit("period").alias("part"), F.col("period").alias("name"), "count"))


@query("quarter_histogram", M + """
SELECT source, date[1:4] || '-Q' || quarter(CAST(date[1:10] AS DATE)) AS period, count(*) AS count FROM msg GROUP BY ALL""")
def quarter_histogram(spark, folder):
    return overview.quarters(C.messages(spark, folder), "source")


@query("contact_activity", RESOLVED + """
SELECT name, source, date[1:4] || '-Q' || quarter(CAST(date[1:10] AS DATE)) AS period, count(*) AS count
FROM msg JOIN resolved USING (source, sender) WHERE name <> sender GROUP BY ALL""")
def contact_activity(spark, folder):
    return overview.contact_activity(C.messages(spark, folder), C.contacts(spark, folder), C.sources(spark))


METERS = """
, polls AS (SELECT CASE e.user_id % 5 WHEN 0 THEN 'h' WHEN 1 THEN 'g' WHEN 2 THEN 'h2' WHEN 3 THEN 'gone' ELSE 'h3' END AS source, * FROM events e),
last AS (SELECT source, arg_max(row(event_type, CAST(trunc(value) AS BIGINT)), row(ts, event_id)) AS m FROM polls GROUP BY source),
live AS (SELECT * FROM last WHERE source IN ('h', 'h2'))"""


@query("meter_full_outer", M + METERS + """
SELECT coalesce(t.source, live.source) AS source, coalesce(n, 0) AS count, CASE WHEN m IS NOT NULL THEN m[1] || '=' || m[2] END AS meter
FROM (SELECT source, count(*) AS n FROM msg GROUP BY source) t FULL JOIN live ON t.source = live.source""")
def meter_full_outer(spark, folder):
    """Sources with messages or with live meters; a source that is no HTTP source has none."""
    polls = C.table(spark, folder, "events").selectExpr(
        "CASE user_id % 5 WHEN 0 THEN 'h' WHEN 1 THEN 'g' WHEN 2 THEN 'h2' WHEN 3 THEN 'gone' ELSE 'h3' END AS source",
        "struct(ts, event_id) AS polled_at", "array(struct(event_type AS label, CAST(value AS BIGINT) AS count, '' AS link)) AS meters")
    known = C.sources(spark).select("prefix", "provider").union(
        C.constant(spark, [("h2", "http"), ("h3", "carddav")], "prefix string, provider string"))
    totals = overview.with_meters(overview.source_totals(C.messages(spark, folder)), polls, known)
    first = F.col("meters")[0]
    return totals.select("source", "count", F.concat(first["label"], F.lit("="), first["count"].cast("string")).alias("meter"))


@query("cache_stats", M + """
SELECT count(*) FILTER (schema_version >= 3) AS total, count(*) FILTER (schema_version < 3) AS stale,
  min(date) FILTER (schema_version >= 3) AS oldest, max(date) FILTER (schema_version >= 3) AS newest,
  count(*) AS bodies, CAST(sum(strlen(body)) AS BIGINT) AS bodies_bytes FROM msg""")
def cache_stats(spark, folder):
    df = C.messages(spark, folder)
    return overview.cache_stats(df, df)


@query("cached_by_source", M + "SELECT source, count(*) AS count FROM msg WHERE schema_version >= 3 GROUP BY source")
def cached_by_source(spark, folder):
    return overview.cached_by_source(C.messages(spark, folder))


@query("source_activity", with_views(MSG, SOURCES) + """
, cur AS (SELECT source, count(*) AS n, max(date) AS newest FROM msg
  WHERE schema_version >= 3 AND mailbox LIKE '%me@example.com' GROUP BY source)
SELECT prefix AS source, provider, CASE WHEN provider IN ('gmail', 'o365') THEN coalesce(n, 0) ELSE 0 END AS count, newest,
  CASE WHEN provider NOT IN ('gmail', 'o365') THEN 'n/a' WHEN n IS NULL THEN 'empty' WHEN newest >= '2001-07-03T00:00:00Z' THEN 'active' ELSE 'low' END AS tag
FROM sources LEFT JOIN cur ON cur.source = prefix""")
def source_activity(spark, folder):
    return overview.source_activity(C.messages(spark, folder), C.sources(spark), dates.resolve_since("30d", C.NOW))


@query("upsert_latest", M + """
SELECT id, CASE WHEN seq % 3 = 0 THEN 'second ' || body ELSE body END AS body, CASE WHEN seq % 3 = 0 THEN 2 ELSE 1 END AS version FROM msg
UNION ALL SELECT 'n' || id, body, 2 FROM msg WHERE seq % 50 = 0""")
def upsert_latest(spark, folder):
    old = C.messages(spark, folder).select("id", "body", F.lit(1).alias("version"), F.lit("2001-01-01").alias("_cached_at"))
    new = C.messages(spark, folder).where("seq % 3 = 0").select(
        "id", F.concat(F.lit("second "), "body").alias("body"), F.lit(2).alias("version"), F.lit("2001-01-02").alias("_cached_at"))
    fresh = C.messages(spark, folder).where("seq % 50 = 0").select(
        F.concat(F.lit("n"), "id").alias("id"), "body", F.lit(2).alias("version"), F.lit("2001-01-02").alias("_cached_at"))
    return store.upsert(old, new.unionByName(fresh)).drop("_cached_at")


@query("live_bodies", M + "SELECT id, body FROM msg WHERE seq % 13 <> 0")
def live_bodies(spark, folder):
    """Bodies read under another mailbox than the one their header now has are dropped."""
    df = C.messages(spark, folder)
    read = df.select("id", F.when(F.expr("seq % 13 = 0"), F.lit("other")).otherwise(F.col("mailbox")).alias("mailbox"), "body")
    return store.live_bodies(read, df).select("id", "body")


@query("cache_clear", M + "SELECT source, count(*) AS kept FROM msg WHERE NOT (source = 'g' AND schema_version < 3) GROUP BY source")
def cache_clear(spark, folder):
    kept, _ = store.clear(C.messages(spark, folder), source="g", stale_only=True)
    return kept.groupBy("source").agg(F.count("*").alias("kept"))
