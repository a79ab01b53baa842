"""Streaming jobs: restarts go on where they stopped, batches count once."""

from pyspark.sql import functions as F

from letterloom.streaming import jobs, levels

SCHEMA = "id string, source string, date string, ts timestamp"


def land(spark, folder, name, rows):
    df = spark.createDataFrame(rows, "id string, source string, date string").withColumn("ts", F.to_timestamp("date"))
    df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)


def test_upsert_over_restarts(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    land(spark, src, "a", [("1", "g", "2026-01-01"), ("2", "g", "2026-01-01")])
    jobs.upsert_messages(stream(spark, src), out, mark)
    land(spark, src, "b", [("1", "g", "2026-01-03"), ("3", "o", "2026-01-02")])
    jobs.upsert_messages(stream(spark, src), out, mark)
    jobs.upsert_messages(stream(spark, src), out, mark)
    got = {r.id: r.date for r in jobs.latest(spark, out).collect()}
    assert got == {"1": "2026-01-03", "2": "2026-01-01", "3": "2026-01-02"}


def test_a_repeated_batch_counts_once(spark, tmp_path):
    path = str(tmp_path / "t")

    def merge(old, batch):
        rows = batch if old is None else old.select("n").unionByName(batch)
        return rows.agg(F.sum("n").alias("n"))

    write = jobs.replace_into(path, merge)
    for number in (0, 1, 1, 2):
        write(spark.createDataFrame([(10,)], "n long"), number)
    assert jobs.snapshot(spark, path).first().n == 30


def test_consumers_move_apart(spark, tmp_path):
    src = str(tmp_path / "in")
    land(spark, src, "a", [("1", "g", "2026-01-01"), ("2", "o", "2026-01-04")])
    paths = {k: (str(tmp_path / f"{k}-t"), str(tmp_path / f"{k}-m")) for k in ("one", "two")}
    jobs.follow(stream(spark, src), "one", *paths["one"])
    land(spark, src, "b", [("3", "g", "2026-01-05"), ("4", "o", "2026-01-02")])
    jobs.follow(stream(spark, src), "one", *paths["one"])
    got = {(r.source): r.ts for r in jobs.snapshot(spark, paths["one"][0]).collect()}
    assert got == {"g": "2026-01-05", "o": "2026-01-04"}
    jobs.follow(stream(spark, src), "two", *paths["two"])
    assert jobs.snapshot(spark, paths["two"][0]).count() == 2


def test_refs_go_on(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    land(spark, src, "a", [("x", "g", "2026-01-01"), ("y", "g", "2026-01-02")])
    jobs.number_refs(stream(spark, src), out, mark)
    land(spark, src, "b", [("x", "g", "2026-01-09"), ("z", "g", "2026-01-03")])
    jobs.number_refs(stream(spark, src), out, mark)
    assert {r.id: r.ref for r in jobs.refs(spark, out).collect()} == {"y": 1, "x": 2, "z": 3}


def test_append_is_resumed(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    land(spark, src, "a", [("1", "g", "2026-01-01"), ("1", "g", "2026-01-01")])
    jobs.append(jobs.deduplicated(stream(spark, src)), out, mark)
    land(spark, src, "b", [("2", "g", "2026-01-02")])
    jobs.append(jobs.deduplicated(stream(spark, src)), out, mark)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["1", "2"]


def test_a_repeated_batch_adds_once(spark, tmp_path):
    path = str(tmp_path / "t")
    write = jobs.append_into(path, lambda old, batch: batch if old is None else batch.join(old, "n", "left_anti"))
    for number, values in ((0, [1, 2]), (1, [2, 3]), (1, [2, 3]), (2, [3, 4])):
        write(spark.createDataFrame([(v,) for v in values], "n long"), number)
    assert sorted(r.n for r in spark.read.parquet(path).collect()) == [1, 2, 3, 4]


def test_runs_hold_all_batches_once():
    for fan in (2, 3, 8):
        for batches in range(200):
            runs = levels.cover(batches, fan)
            assert [b for level, r in runs for b in range(r * fan**level, (r + 1) * fan**level)] == list(range(batches))
            assert all(sum(level == k for level, _ in runs) < fan for k in range(9))
    assert len(levels.cover(100)) <= 14


def test_runs_are_merged_by_level(spark, tmp_path):
    """Every id changes in many batches; readers meet it once a run, and a repeated batch changes nothing."""
    path, fan = str(tmp_path / "t"), 3
    write = jobs.upsert_into(path, "date", fan)
    want = {}
    for number in range(19):
        rows = [(f"i{k}", f"2026-{number:02d}-{k:02d}" if k % 2 else "same", number) for k in range(number % 4, 8)]
        want |= {i: n for i, _, n in rows}
        df = spark.createDataFrame(rows, "id string, date string, n int").coalesce(1)
        write(df, number)
        if number in (5, 8):
            write(df, number)
    assert levels.complete(spark, path, fan) == levels.cover(19, fan) == [(2, 0), (2, 1), (0, 18)]
    assert {r.id: r.n for r in jobs.latest(spark, path, "date", fan).collect()} == want
    assert levels.read(spark, path, [(2, 0)]).count() == 8
    # What was merged long ago is gone, and so a reader of a merge that has not ended finds its parts.
    levels.remove(spark, f"{path}/level=2/run=1")
    assert levels.complete(spark, path, fan) == [(2, 0), (1, 3), (1, 4), (1, 5), (0, 18)]
    assert {r.id: r.n for r in jobs.latest(spark, path, "date", fan).collect()} == want


def test_refs_read_the_buckets_of_a_batch(spark, tmp_path):
    path = str(tmp_path / "t")
    write = jobs.refs_into(path, fan=2, buckets=4)
    for number, ids in enumerate(([], ["a", "b", "c"], ["b", "d"], [], ["a", "e"], ["f"])):
        write(spark.createDataFrame([(i, f"2026-01-0{9 - k}") for k, i in enumerate(ids)], "id string, date string").coalesce(1), number)
    assert {r.id: r.ref for r in jobs.refs(spark, path, 2).collect()} == {"a": 1, "b": 2, "c": 3, "d": 4, "e": 5, "f": 6}
    plan = levels.read(spark, path, levels.complete(spark, path, 2), [1])._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters:")[1].split("]")[0]
