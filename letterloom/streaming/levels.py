"""A stored table to which every batch adds a run, and whose runs are merged level by level.

Batch n is run n of level 0. Whenever ``fan`` runs of a level are complete they are merged
into one of the level above, so after any number of batches a reader opens at most
``fan - 1`` runs a level, and a row is written again once a level. Which runs hold the first
n batches follows from n alone, written to the base ``fan``: there is no list of files to
keep, and a batch that is repeated after a failure does the same as the first time. Runs are
split into buckets by a hash of the key, as folders, so a reader that knows its keys opens
theirs only. Merged runs go once the run after theirs has been merged as well, which leaves
readers the time of ``fan`` batches and more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FAN = 8
BUCKETS = 16

Run = tuple[int, int]


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def cover(batches: int, fan: int = FAN) -> list[Run]:
    """The (level, run) pairs that together hold the first ``batches`` batches, the oldest first."""
    out, level, span = [], 0, 1
    while span <= batches:
        out = [(level, r) for r in range(batches // (span * fan) * fan, batches // span)] + out
        level, span = level + 1, span * fan
    return out


def _folder(path: str, run: Run) -> str:
    return f"{path}/level={run[0]}/run={run[1]}"


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def finished(spark: SparkSession, pattern: str) -> list[str]:
    """The folders of a pattern whose writing is complete."""
    place, files = _hadoop(spark, f"{pattern}/_SUCCESS")
    return [status.getPath().getParent().toString() for status in files.globStatus(place) or []]


def remove(spark: SparkSession, path: str) -> None:
    place, files = _hadoop(spark, path)
    files.delete(place, True)


def _number(folder: str, name: str) -> int:
    return int(folder.rsplit(f"{name}=", 1)[1].split("/")[0])


def complete(spark: SparkSession, path: str, fan: int = FAN) -> list[Run]:
    """The runs a reader opens now; where a merge is still going on, those that go into it."""
    done = {(_number(f, "level"), _number(f, "run")) for f in finished(spark, f"{path}/level=*/run=*")}
    runs = cover(max((r for level, r in done if level == 0), default=-1) + 1, fan)
    out = []
    while runs:
        level, run = runs.pop(0)
        if (level, run) in done:
            out.append((level, run))
        elif level:
            runs = [(level - 1, run * fan + i) for i in range(fan)] + runs
    return out


def read(spark: SparkSession, path: str, runs: Iterable[Run], buckets: Iterable[int] | None = None) -> DataFrame | None:
    """The rows of the runs, of all buckets or of some; None if there are no runs."""
    folders = [_folder(path, run) for run in runs]
    if not folders:
        return None
    schema = spark.read.parquet(f"{path}-schema").schema
    rows = spark.read.schema(schema).option("basePath", path).parquet(*folders)
    if buckets is not None:
        rows = rows.where(F.col("bucket").isin(list(buckets)))
    return rows.drop("level", "run")


def add_run(path: str, key: str, rows: Callable[[DataFrame, int], DataFrame], merge: Callable[[DataFrame], DataFrame],
            fan: int = FAN, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: add ``rows(batch, number)`` as a run, and merge what is complete.

    ``merge`` reduces the rows of several runs to those that a reader needs; readers apply it again.
    """
    def put(df: DataFrame, run: Run) -> None:
        df.withColumn("bucket", bucket_of(key, buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(_folder(path, run))

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = rows(batch, number)
        if not number:
            # Runs without rows have no files that could tell their columns.
            fresh.withColumn("bucket", bucket_of(key, buckets)).limit(0).write.mode("overwrite").parquet(f"{path}-schema")
        put(fresh, (0, number))
        level, span = 1, fan
        while (number + 1) % span == 0:
            run = number // span
            put(merge(read(spark, path, [(level - 1, run * fan + i) for i in range(fan)]).drop("bucket")), (level, run))
            for i in range(fan if run else 0):
                remove(spark, _folder(path, (level - 1, (run - 1) * fan + i)))
            level, span = level + 1, span * fan

    return write
