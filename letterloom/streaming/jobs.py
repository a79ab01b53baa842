"""Streaming jobs: landed files in, tables kept up to date out.

Every job is resumable: the checkpoint is the bookmark, ``maxFilesPerTrigger`` the page
size, and ``trigger(availableNow=True)`` makes it a batch that ends when all is read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from letterloom.operators import feed
from letterloom.operators.ordering import top_in_groups
from letterloom.session import fresh_path, materialise
from letterloom.streaming import levels


def run(query) -> StreamingQuery:
    """Start a configured stream and wait until all that is there is read."""
    started = query.trigger(availableNow=True).start()
    started.awaitTermination()
    return started


def append(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append finished rows to a table; a restarted job goes on where it stopped."""
    return run(stream.writeStream.format("parquet").outputMode("append").option("path", out).option(
        "checkpointLocation", checkpoint))


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A small table as the last complete batch left it.

    Only that batch's folder is read; it stays until two more batches are complete.
    """
    folders = levels.finished(spark, f"{path}/batch=*")
    return spark.read.parquet(max(folders, key=lambda f: int(f.rsplit("=", 1)[1])))


def replace_into(path: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for small tables: each batch writes ``merge(old, batch)``.

    Every batch has a folder of its own and reads that of the batch before it, so a batch that
    is run again after a failure starts from the same table as the first time and counts once.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{path}/batch={number - 1}") if number else None
        merge(old, batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
        levels.remove(spark, f"{path}/batch={number - 2}")

    return write


def append_into(path: str, rows: Callable[[DataFrame | None, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for large tables: each batch adds ``rows(old, batch)``.

    What is there is read only as far as ``rows`` asks, and never written again, so a batch
    costs what it brings. Rows carry the number of their batch; a batch that is run again
    sees only those before it and replaces its own.
    """
    def write(batch: DataFrame, number: int) -> None:
        old = batch.sparkSession.read.parquet(path).where(F.col("batch") < number).drop("batch") if number else None
        rows(old, batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def newest(rows: DataFrame, order: str) -> DataFrame:
    """The version of every id that is greatest in ``order``; of equal ones that of the later batch."""
    return top_in_groups(rows, ["id"], [F.desc(order), F.desc("batch")], 1, "_rank").drop("_rank")


def upsert_into(path: str, order: str = "date", fan: int = levels.FAN) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that adds the latest version of every message id of a batch."""
    return levels.add_run(path, "id", lambda batch, number: newest(batch.withColumn("batch", F.lit(number).cast("bigint")), order),
                          lambda rows: newest(rows, order), fan)


def upsert_messages(stream: DataFrame, path: str, checkpoint: str, order: str = "date") -> StreamingQuery:
    """Keep the latest version of every message id; ``latest`` reads the table."""
    return run(stream.writeStream.foreachBatch(upsert_into(path, order)).option("checkpointLocation", checkpoint))


def latest(spark: SparkSession, path: str, order: str = "date", fan: int = levels.FAN) -> DataFrame:
    """The latest version of every message id; of equal ones that of the later batch.

    An id has at most one version in each run, and the runs grow with the logarithm of the batches.
    """
    return newest(levels.read(spark, path, levels.complete(spark, path, fan)), order).drop("batch", "bucket")


def follow(stream: DataFrame, key: str, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the offsets of one consumer: the newest date it was delivered per source.

    Each consumer is a query with a checkpoint of its own, so consumers progress apart.
    """
    def merge(old, batch):
        seen = batch.groupBy("source").agg(F.max("date").alias("ts")).select(F.lit(key).alias("key"), "source", "ts")
        if old is None:
            return seen
        return feed.merge_offsets(old, seen.join(old.select("key", "source", F.col("ts").alias("_old")), ["key", "source"], "left").select(
            "key", "source", F.greatest("ts", "_old").alias("ts")))

    return run(stream.writeStream.foreachBatch(replace_into(path, merge)).option("checkpointLocation", checkpoint))


def refs_into(path: str, fan: int = levels.FAN, buckets: int = levels.BUCKETS) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that numbers the ids that are new in a batch.

    Known ids are looked for in the buckets that the ids of the batch fall into, and the last
    number is a row of its own, so a batch never reads the whole table.
    """
    def rows(batch: DataFrame, number: int) -> DataFrame:
        spark = batch.sparkSession
        asked = [r[0] for r in batch.select(levels.bucket_of("id", buckets)).distinct().collect()]
        known = levels.read(spark, path, levels.cover(number, fan), asked)
        if known is None:
            known = spark.createDataFrame([], "id string, ref bigint")
        start = spark.read.parquet(f"{path}-last/batch={number - 1}").first()["last"] if number else 0
        return materialise(feed.assign_refs(batch, known, ["date"], newest_first=True, start=start))

    def last(old: DataFrame | None, fresh: DataFrame) -> DataFrame:
        most = fresh.select(F.col("ref").alias("last"))
        return (most if old is None else most.unionAll(old)).agg(F.coalesce(F.max("last"), F.lit(0)).alias("last"))

    keep_last = replace_into(f"{path}-last", last)

    def write(batch: DataFrame, number: int) -> None:
        fresh = rows(batch, number)
        levels.add_run(path, "id", lambda *_: fresh, lambda runs: runs, fan, buckets)(batch, number)
        keep_last(fresh, number)

    return write


def number_refs(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the reference numbers: ids that are new in a batch get the next ones; ``refs`` reads them."""
    return run(stream.writeStream.foreachBatch(refs_into(path)).option("checkpointLocation", checkpoint))


def refs(spark: SparkSession, path: str, fan: int = levels.FAN) -> DataFrame:
    """(id, ref) of all that is numbered."""
    return levels.read(spark, path, levels.complete(spark, path, fan)).select("id", "ref")


def usage_counters(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep running totals per command and source, as partial sums that later batches add to."""
    keys = ["command", "source"]
    sums = ["calls", "bytes_in", "bytes_out", "messages"]

    def merge(old, batch):
        new = batch.withColumn("calls", F.lit(1).cast("bigint")).select(*keys, *sums)
        rows = new if old is None else old.unionByName(new)
        return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])

    return run(stream.writeStream.foreachBatch(replace_into(path, merge)).option("checkpointLocation", checkpoint))


def last_meters(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the last meter snapshot per source; an empty one clears the source."""
    def merge(old, batch):
        new = batch.select("source", "polled_at", "meters")
        rows = new if old is None else old.unionByName(new)
        return rows.groupBy("source").agg(F.max("polled_at").alias("polled_at"), F.max_by("meters", "polled_at").alias("meters"))

    return run(stream.writeStream.foreachBatch(replace_into(path, merge)).option("checkpointLocation", checkpoint))


def deduplicated(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each id once, however often it is polled within the delay."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"])


def window_counts(stream: DataFrame, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Rows per source and tumbling window; a window is final once the delay has passed."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", width), "source").agg(F.count("*").alias("count"))


def closing_windows(path: str, width: str, delay: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: final counts per source and window, and the rows that came too late.

    The watermark is the newest time of all batches, less the delay. A window that it has
    reached is final: its count goes to ``path``/final, and rows of it that come in later
    batches are counted in ``path``/late. Open windows are a small table that batches replace.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kept = f"{path}/open/batch={number}"
        old = spark.read.parquet(f"{path}/open/batch={number - 1}") if number else None
        counted = batch.where("ts IS NOT NULL").groupBy(F.window("ts", width).alias("w"), "source").agg(F.count("*").alias("count"), F.max("ts").alias("_ts"))
        counted = materialise(counted.select("source", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "count", "_ts"))
        before = old.where("source IS NULL AND start IS NULL").first()["end"] if number else None
        mark = counted.agg(F.max(F.col("_ts") - F.expr(f"INTERVAL {delay}"))).first()[0]
        mark = max((m for m in (before, mark) if m is not None), default=None)

        reached = F.lit(False) if before is None else F.col("end") <= F.lit(before)
        counted.where(reached).select("source", "start", "count").write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        rows = counted.where(~reached).drop("_ts")
        if old is not None:
            rows = rows.unionByName(old.where("start IS NOT NULL"))
        rows = materialise(rows.groupBy("source", "start", "end").agg(F.sum("count").alias("count")))
        final = F.lit(False) if mark is None else F.col("end") <= F.lit(mark)
        rows.where(final).select("source", "start", "count").write.mode("overwrite").parquet(f"{path}/final/batch={number}")
        # The row without source and start holds the watermark.
        point = spark.createDataFrame([(None, None, mark, 0)], "source string, start timestamp, end timestamp, count bigint")
        rows.where(~final).unionByName(point).coalesce(1).write.mode("overwrite").parquet(kept)
        levels.remove(spark, f"{path}/open/batch={number - 2}")

    return write


def windows_with_late(stream: DataFrame, path: str, checkpoint: str, width: str = "1 day", delay: str = "1 day") -> StreamingQuery:
    """Rows per source and tumbling window, and apart from them the rows behind the watermark."""
    return run(stream.writeStream.foreachBatch(closing_windows(path, width, delay)).option("checkpointLocation", checkpoint))


def windows(spark: SparkSession, path: str) -> DataFrame:
    """(source, start, count, late) of the windows that are final."""
    final = spark.read.parquet(f"{path}/final").select("source", "start", "count")
    late = spark.read.parquet(f"{path}/late").groupBy("source", "start").agg(F.sum("count").alias("late"))
    return final.join(late, ["source", "start"], "full_outer").select(
        "source", "start", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("late", F.lit(0)).alias("late"))


def sessions(stream: DataFrame, gap: str = "6 hours", delay: str = "1 day") -> DataFrame:
    """Bursts per thread: rows that follow each other within the gap."""
    return stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "thread_id").agg(F.count("*").alias("count"))


def working_paths(spark: SparkSession, label: str) -> tuple[str, str]:
    """A new table path and checkpoint path in the shared folder."""
    base = fresh_path(spark, label)
    return f"{base}/table", f"{base}/checkpoint"
