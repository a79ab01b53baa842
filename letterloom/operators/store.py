"""The cached corpus as tables of headers and bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from letterloom.functions import patterns as P
from letterloom.operators.filters import expected_mailboxes
from letterloom.operators.lookups import thread_of
from letterloom.operators.ordering import top_in_groups
from letterloom.operators.threads import in_thread, thread_key
from letterloom.session import materialise

BUCKETS = 32


def stamped(messages: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """Header rows as the cache keeps them: cached providers only, without the body."""
    owners = expected_mailboxes(sources).withColumnRenamed("_expected", "_owner")
    return messages.where(F.lower("provider").isin(*P.CACHED_PROVIDERS)).join(
        owners, F.col("source") == F.col("_prefix"), "left").drop("_prefix", "body", "mailbox").withColumnsRenamed(
        {"_owner": "mailbox"}).withColumn("_schema_version", F.lit(P.SCHEMA_VERSION)).withColumn("_cached_at", now)


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """The latest version per id; every task first keeps its own latest."""
    both = old.unionByName(new, allowMissingColumns=True)
    return top_in_groups(both, ["id"], [F.desc("_cached_at")], 1, "_rank").drop("_rank")


def live_bodies(bodies: DataFrame, headers: DataFrame) -> DataFrame:
    """Bodies whose message still sits in the mailbox they were read from."""
    return bodies.join(headers.select("id", "mailbox"), ["id", "mailbox"], "left_semi")


def _month(date: Column) -> Column:
    """The partition of a date; undated rows have one of their own."""
    return F.coalesce(F.substring(date, 1, 7), F.lit("none"))


def _by_file(headers: DataFrame, buckets: int) -> DataFrame:
    """Rows dealt out so that one task writes a bucket of a month; else every task opens files for all of them."""
    return headers.repartition("source", "month", F.pmod(F.hash("id"), F.lit(buckets)))


def create(headers: DataFrame, name: str, path: str, buckets: int = BUCKETS) -> None:
    """Headers as a table by source and month, bucketed by id and sorted by date in each file."""
    _by_file(headers.withColumn("month", _month(F.col("date"))), buckets).write.partitionBy("source", "month").bucketBy(buckets, "id").sortBy("date").option(
        "path", path).saveAsTable(name)


def merge(name: str, new: DataFrame) -> None:
    """Put newer versions of headers into a table made by ``create``.

    Old versions are found by id, a join that leaves the buckets of the table where they are,
    and only the months that gain or lose a version are written again.
    """
    spark = new.sparkSession
    old = spark.table(name)
    new = materialise(upsert(new.withColumn("month", _month(F.col("date"))), new.limit(0).withColumn("month", F.lit(""))))
    stale = old.select("id", "source", "month").join(new.select("id"), "id", "left_semi").select("source", "month")
    touched = materialise(stale.unionAll(new.select("source", "month")).distinct())
    kept = old.join(touched, ["source", "month"], "left_semi")
    # Months that only lost versions come out without rows and have to go as partitions.
    merged = materialise(upsert(kept, new).select(old.columns))
    emptied = touched.join(merged.select("source", "month").distinct(), ["source", "month"], "left_anti").collect()
    buckets = int(spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Num Buckets'").first()["data_type"])
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        _by_file(merged, buckets).write.mode("overwrite").insertInto(name)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
    for row in emptied:
        spark.sql(f"ALTER TABLE {name} DROP PARTITION (source = :source, month = :month)", {"source": row.source, "month": row.month})


def scan(headers: DataFrame, source: str | None = None, since: str | None = None,
         sender: str | None = None) -> DataFrame:
    """Current headers of a stored table.

    The conditions on version and date reach the Parquet reader; source and, where the table
    has it, month choose its folders.
    """
    df = headers.where(F.col("_schema_version") >= P.SCHEMA_VERSION)
    if since and "month" in headers.columns:
        df = df.where(F.col("month") >= since[:7])
    if source:
        df = df.where(F.col("source") == source)
    if since:
        df = df.where(F.col("date") >= since)
    if sender:
        df = df.where(F.lower("sender").contains(sender.lower()))
    return df


def clear(headers: DataFrame, source: str | None = None, stale_only: bool = False) -> tuple[DataFrame, Observation]:
    """The rows that stay, and an observation that counts the others while they are written."""
    gone = F.lit(True)
    if source:
        gone = gone & (F.col("source") == source)
    if stale_only:
        gone = gone & (F.coalesce("_schema_version", F.lit(0)) < P.SCHEMA_VERSION)
    counted = Observation()
    return headers.observe(counted, F.count_if(gone).alias("removed")).where(~gone), counted


def write(headers: DataFrame, path: str) -> None:
    """Replace the partitions of the sources that ``headers`` holds."""
    headers.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)


def read_messages(headers: DataFrame, bodies: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Headers with their bodies, for some ids or for all."""
    if ids is not None:
        headers = headers.join(ids.select("id"), "id", "left_semi")
    return headers.join(bodies.select("id", "mailbox", "body"), ["id", "mailbox"], "left")


def read_threads(ids: DataFrame, messages: DataFrame) -> DataFrame:
    """For each asked id the messages of its thread, by date, numbered from 1 by ``idx``.

    The id may be that of a message or of a thread. Only the threads asked for are put in order.
    """
    wanted = thread_of(ids.select(F.col("id").alias("asked"), "id"), messages).select("asked", F.col("thread_id").alias("_thread"))
    keyed = messages.withColumn("_thread", thread_key())
    found = in_thread(keyed.join(wanted.select("_thread").distinct(), "_thread", "left_semi"))
    return wanted.join(found, "_thread").drop("_thread")


def read_events(ids: DataFrame, events: DataFrame) -> DataFrame:
    """The events of the asked ids, with all their fields."""
    return events.join(ids.select("id").distinct(), "id", "left_semi")
