"""What holds however large the tables are: plans, pieces of work, and results that size must not change."""

import glob
import re

from pyspark.sql import functions as F

from letterloom import session
from letterloom.functions import headers
from letterloom.operators import filters, render, store, threads
from letterloom.plans import streams
from letterloom.sources import landing
from letterloom.streaming import jobs

MESSAGE = "id string, source string, sender string, subject string, date string, snippet string, body string, unread boolean, seq long"


def test_a_listing_of_one_day_shows_its_date_if_asked(spark):
    data = [("g:1", "g", "ann", "A", "2026-01-05T10:00:00Z", "s", None, True, 1), ("g:2", "g", "bo", "B", "2026-01-05T09:00:00Z", "t", None, False, 2)]
    page = spark.createDataFrame(data, MESSAGE).withColumns({"place": F.col("seq"), "ref": F.col("seq")})
    shown = [r.line for r in render.listing(page, precision="day").orderBy("place", "part").collect()]
    assert shown[1:] == ["--- 5Jan ---", "*|1|g|ann|A|10:00|1b|s", " |2|g|bo|B|09:00|1b|t"]
    assert [r.line for r in render.listing(page).orderBy("place", "part").collect()] == [shown[0], *shown[2:]]


def test_rules_that_are_gone_are_looked_up_once(spark):
    rules = spark.range(50).select(F.lit("sender").alias("rule_type"), F.concat(F.lit("a"), F.col("id") % 5).alias("value"))
    gone = spark.range(50).select(F.lit("sender").alias("rule_type"), F.concat(F.lit("A"), F.col("id") % 2).alias("value"))
    left = filters.remove_rules(filters.add_rules(rules.limit(0), rules), gone)
    assert sorted(r.value for r in left.collect()) == ["a2", "a3", "a4"]
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Range"):]


def test_a_part_of_a_stream_lands_as_the_files_of_its_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "fresh_path", lambda spark, label: str(tmp_path / label))
    log = spark.range(0, 900, 1, 4).select("id", F.lit("c").alias("command"), F.lit("s").alias("source"),
                                           *[F.lit(1).cast("bigint").alias(c) for c in ("bytes_in", "bytes_out", "messages")])
    calls = []
    for stream in streams._landed(spark, log, F.col("id") % 3):
        jobs.usage_counters(stream.drop("id"), str(tmp_path / "table"), str(tmp_path / "checkpoint"))
        calls.append(jobs.snapshot(spark, str(tmp_path / "table")).first()["calls"])
    assert calls == [300, 600, 900]
    assert [len(glob.glob(f"{tmp_path}/landed/{n}/*.parquet")) for n in range(3)] == [4, 4, 4]


def test_a_month_of_the_cache_is_a_file_a_bucket(spark, tmp_path):
    headers = spark.range(0, 400, 1, 4).selectExpr(
        "concat('g:', id) AS id", "'g' AS source", "'me' AS mailbox", "if(id % 2 = 0, '2026-01-05', '2026-02-05') AS date",
        "3 AS _schema_version", "'2026-03-01' AS _cached_at")
    store.create(headers, "growth_cache", str(tmp_path / "cache"), buckets=2)
    files = lambda: [len(glob.glob(f"{tmp_path}/cache/source=g/month=2026-0{m}/*.parquet")) for m in (1, 2)]
    assert files() == [2, 2]
    store.merge("growth_cache", headers.withColumn("_cached_at", F.lit("2026-03-02")))
    assert files() == [2, 2]
    assert spark.table("growth_cache").where("_cached_at = '2026-03-02'").count() == 400
    spark.sql("DROP TABLE growth_cache")


def test_discussions_are_put_together_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def body(text):
        seen.add(1)
        return text

    columns = "thread_id string, id string, subject string, date string, seq long, state string"
    heads = spark.createDataFrame([("t", "t", "s", "2026-01-01", 0, None)], columns).selectExpr("*", "true AS is_pull_request", "'' AS body")
    reply = spark.createDataFrame([("t", f"c{i}", None, f"2026-01-{i + 1:02d}", i, None) for i in range(9)], columns)
    comments = reply.withColumn("body", body.asNondeterministic()("id"))
    whole = threads.assemble(heads, comments, reply.limit(0).withColumn("body", F.lit("")), reply.limit(0).withColumn("body", F.lit("")))
    assert [(r.idx, r.body) for r in whole.orderBy("idx").collect()] == [(1, "")] + [(i + 2, f"c{i}") for i in range(9)]
    assert seen.value == 9


def test_costly_work_is_dealt_out_by_its_size(spark, monkeypatch):
    table = spark.range(0, 1000, 1, 8)
    assert session.spread(table).rdd.getNumPartitions() == 8
    monkeypatch.setattr(session, "PIECE_BYTES", 400)
    assert session.spread(table).rdd.getNumPartitions() == 20


PAYLOADS = [
    ("g", "gmail", 1, '{"id":"a","internalDate":"0","sizeEstimate":7}'), ("g", "gmail", 2, "[]"), ("g", "gmail", 3, "null"), ("g", "gmail", 4, "{"),
    ("o", "o365", 5, '{"value":{"id":"b","receivedDateTime":" 2026-01-05T10:00:00Z "}}'), ("o", "o365", 6, '{"subject":"x"}'),
    ("h", "http", 7, '{"notifications":[{"id":"c"},{"id":"d"}]}'), ("w", "whatsapp", 8, '\n{broken\n{"id":"e"}\n[{"id":"f"}]'), ("n", "github", 9, '{"id":"i"}')]


def test_a_payload_is_made_once_to_be_landed(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def made(payload):
        seen.add(1)
        return payload

    raw = spark.createDataFrame(PAYLOADS, "source string, provider string, seq long, payload string").coalesce(1)
    rows = landing.land(raw.withColumn("payload", made("payload"))).select("seq", "id", "date").collect()
    assert sorted((r.seq, r.id) for r in rows) == [
        (1, "g:a"), (2, "g:"), (3, "g:"), (5, "o:b"), (7, "h:c"), (7, "h:d"), (8, "w:e"), (8, "w:f"), (9, "n:i")]
    assert {r.seq: r.date for r in rows if r.seq in (1, 5)} == {1: "1970-01-01T00:00:00Z", 5: "2026-01-05T10:00:00Z"}
    assert seen.value == len(PAYLOADS)


def test_landing_reads_of_a_payload_what_is_asked_for(spark):
    raw = spark.createDataFrame(PAYLOADS, "source string, provider string, seq long, payload string")
    plan = landing.land(raw).select("provider", "date")._jdf.queryExecution().optimizedPlan().toString()
    assert "internalDate" in plan and "sizeEstimate" not in plan


def test_dates_that_are_clean_stay(apply):
    dates = ["2026-01-05T10:00:00Z", "2026-01-05T10:00:00Z\n", " 2026-01-05T10:00:00Z", "2026-01-05 11:00:00+01:00", "Mon,  5 Jan 2026\t10:00:00 +0000", "soon", "", None]
    assert apply(lambda c: headers.header("Date", c), dates) == ["2026-01-05T10:00:00Z"] * 5 + ["soon", "", None]


def test_white_space_is_folded_but_for_lone_blanks(spark, apply):
    pieces = ["a", "<b@C.D>", " ", "  ", "\t", "\n ", "\x1c", "\x85", "\u3000", "\u200b", "\U0001f600"]
    texts = [x + y + z for x in pieces for y in pieces for z in pieces] + ["", None]
    folded = lambda t: t if t is None else re.sub(headers.SPACE + "+", " ", t).strip(" ")
    assert apply(headers.collapse_spaces, texts) == [folded(t) for t in texts]


def test_addresses_of_headers_are_compiled(spark):
    df = spark.createDataFrame([(" Ann  <ann@X.Org> ", "\tbo@Y.Org", "a@b@C", None)], "sender string, `to` string, cc string, `from` string")
    clean = headers.clean_headers(df, ("sender", "to", "cc", "from"))
    assert tuple(clean.first()) == ("ann@x.org", "bo@y.org", "a@b@C", None)
    assert tuple(df.select(*[headers.header(c, F.col(c)) for c in df.columns]).first()) == tuple(clean.first())
    assert "lambda" not in clean._jdf.queryExecution().optimizedPlan().toString()
