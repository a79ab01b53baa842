"""Consumers of a stream against polls of everything landed so far, one after the other."""

import random

import pytest
from pyspark.sql import functions as F

from letterloom.streaming import bulk, consumers, jobs

SCHEMA = "id string, source string, date string, seq long"
ORDS = {"g": 1, "o": 2, "w": 3}


def polled(polls, follows, count):
    """``polls`` lists the rows that land before each poll; ``follows`` is key, source, since, policy."""
    offsets, there, pages = {(k, s): since for k, s, since, _ in follows}, [], []
    policy = {k: p for k, _, _, p in follows}
    for number, landed in enumerate(polls, 1):
        there += landed
        for key in policy:
            due = [r for r in there if r[2] is not None and (key, r[1]) in offsets and r[2] >= offsets[key, r[1]]]
            due.sort(key=lambda r: (ORDS[r[1]], r[3]))
            due.sort(key=lambda r: r[2], reverse=True)
            page = due[:count]
            pages += [(key, number, place, r[0]) for place, r in enumerate(page, 1)]
            for source in {r[1] for r in page}:
                dates = [r[2] for r in page if r[1] == source]
                if len(dates) == sum(r[1] == source for r in due):
                    offsets[key, source] = max(dates)
                elif policy[key] == "compatible":
                    offsets[key, source] = min(dates)
    return sorted(pages), offsets


@pytest.mark.parametrize("seed", [1, 2])
def test_polls(spark, tmp_path, seed):
    """Truncation, both policies, ties at the bound, late rows, a source nobody follows, polls without news."""
    rng = random.Random(seed)
    follows = [(k, s, f"2026-01-0{rng.randrange(1, 4)}", p) for k, p in (("ann", "compatible"), ("bob", "lossless")) for s in ORDS if (k, s) != ("bob", "w")]
    rows = [(f"m{i}", rng.choice("gggoowz"), rng.choice([None, *(f"2026-01-{d:02d}" for d in range(1, 9 + i // 6))]), i) for i in range(90)]
    polls = [rows[:30], rows[30:32], rows[32:60], [("x", "z", "2026-02-01", 90)], rows[60:]]
    table = spark.createDataFrame([(k, s, ORDS[s], since, p) for k, s, since, p in follows], "key string, source string, source_ord int, since string, policy string")
    paths = {n: str(tmp_path / n) for n in ("in", "out", "mark")}
    for number, landed in enumerate(polls):
        spark.createDataFrame(landed, SCHEMA).repartition(3).write.parquet(f"{paths['in']}/{number}")
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(paths["in"])
        consumers.read_pages(stream, table, 7, paths["out"], paths["mark"])
    out = spark.read.parquet(paths["out"])
    pages, offsets = polled([[r for r in p if r[1] in ORDS] for p in polls], follows, 7)
    assert sorted((r.key, r.poll, r.place, r.id) for r in consumers.delivered(out).collect()) == pages
    before = table.select("key", "source", F.col("since").alias("ts"))
    assert {(r.key, r.source): r.ts for r in consumers.offsets(out, before).collect()} == offsets


def test_late_rows_are_counted(spark, tmp_path):
    path = str(tmp_path / "t")
    write = jobs.closing_windows(path, "1 day", "1 day")
    batches = [["2026-01-01 10:00", "2026-01-02 09:00"], ["2026-01-03 12:00", "2026-01-01 11:00", None], ["2026-01-01 12:00", "2026-01-02 23:00"],
               ["2026-01-09 00:00"], ["2026-01-02 01:00", "2026-01-08 01:00"]]
    for number, times in enumerate(batches):
        df = spark.createDataFrame([("g", t) for t in times], "source string, t string").withColumn("ts", F.to_timestamp("t"))
        write(df, number)
        if number == 2:
            write(df, number)
    got = {str(r.start.date()): (r["count"], r.late) for r in jobs.windows(spark, path).collect()}
    # A day closes when the newest time so far is a day past its end.
    assert got == {"2026-01-01": (2, 1), "2026-01-02": (2, 1), "2026-01-03": (1, 0)}


def test_bulk_load_goes_on(spark, tmp_path):
    """A job that fails in its second batch is started again; nothing counts twice."""
    src, path, mark = (str(tmp_path / n) for n in ("in", "t", "mark"))
    schema = "id string, mailbox string, date string, page string"
    spark.createDataFrame([("1", "a", "2026-01-01", "p1"), (None, "a", "2026-01-01", "p1"), ("2", "a", "2026-01-01", "p2")], schema).coalesce(1).write.parquet(f"{src}/a")
    spark.createDataFrame([("1", "a", "2026-01-02", "p3"), ("3", "a", "2026-01-02", "p3")], schema).coalesce(1).write.parquet(f"{src}/b")

    def bodies(rows):
        return rows.select("id", "mailbox", F.when(F.col("id") != "2", F.concat(F.lit("body "), "date")).alias("body"))

    def broken(rows):
        return bodies(rows).withColumn("body", F.when(F.col("id") == "3", F.raise_error(F.lit("no body"))).otherwise(F.col("body")))

    def start(read):
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(src)
        bulk.load(stream, "job", path, mark, read)

    with pytest.raises(Exception):
        start(broken)
    first = bulk.report(spark, path).first()
    assert first.status == "failed" and first.error and first.batches == 1
    start(bodies)
    done = bulk.report(spark, path).first()
    assert (done.status, done.error, done.batches, done.pages, done.messages, done.bodies, done.skipped) == ("done", None, 2, 3, 4, 3, 1)
    assert {r.id: r.date for r in bulk.headers(spark, path).collect()} == {"1": "2026-01-02", "2": "2026-01-01", "3": "2026-01-02"}
    assert {r.id: r.body for r in bulk.bodies_of(spark, path).collect()} == {"1": "body 2026-01-02", "3": "body 2026-01-02"}
