"""Bulk loads of message headers, with their bodies if asked for, and a table of the jobs.

A job is a stream over landed pages: its checkpoint is what it resumes from. Every batch
leaves one row of counters, observed while the batch is read and numbered like it, so a batch
that is repeated after a crash counts once and the counters of a restarted job go on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from letterloom.session import materialise
from letterloom.streaming import jobs, levels

STATES = "status string, error string"
COUNTERS = "pages bigint, messages bigint, bodies bigint, skipped bigint"

#: Reads the bodies of headers: (id, mailbox, body).
Bodies = Callable[[DataFrame], DataFrame]


def _put(spark: SparkSession, row: tuple, ddl: str, path: str) -> None:
    spark.createDataFrame([row], ddl).coalesce(1).write.mode("overwrite").parquet(path)


def load(stream: DataFrame, job: str, path: str, checkpoint: str, bodies: Bodies | None = None, page: str = "page") -> None:
    """Keep the latest header of every message of a stream, and its body where ``bodies`` finds one.

    ``stream`` has id, mailbox, date and the page that a row came from; rows without id are
    skipped. A job that failed goes on when it is started again with the same checkpoint; its
    error is raised, and stands in the report until then.
    """
    spark = stream.sparkSession
    put_headers = jobs.upsert_into(f"{path}/headers")
    put_bodies = levels.add_run(f"{path}/bodies", "id", lambda batch, number: batch.withColumn("batch", F.lit(number).cast("bigint")),
                                lambda rows: jobs.newest(rows, "batch"))

    def write(batch: DataFrame, number: int) -> None:
        seen, read, named = Observation(), Observation(), F.coalesce("id", F.lit("")) != ""
        rows = materialise(batch.observe(
            seen, F.size(F.collect_set(page)).alias("pages"), F.count_if(named).alias("messages"), F.count_if(~named).alias("skipped")))
        headers = rows.where(named)
        put_headers(headers, number)
        if bodies is not None:
            texts = bodies(headers).select("id", "mailbox", "body").where("body IS NOT NULL")
            put_bodies(materialise(texts.observe(read, F.count("*").alias("bodies"))), number)
        counts = seen.get
        _put(spark, (counts["pages"], counts["messages"], read.get["bodies"] if bodies else 0, counts["skipped"]), COUNTERS,
             f"{path}/counters/job={job}/batch={number}")

    def state(status: str, error: str | None = None) -> None:
        _put(spark, (status, error), STATES, f"{path}/states/job={job}")

    state("in_progress")
    try:
        jobs.run(stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint))
    except Exception as error:
        state("failed", str(error).splitlines()[0])
        raise
    state("done")


def headers(spark: SparkSession, path: str) -> DataFrame:
    return jobs.latest(spark, f"{path}/headers")


def bodies_of(spark: SparkSession, path: str) -> DataFrame:
    return jobs.latest(spark, f"{path}/bodies", "batch")


def report(spark: SparkSession, path: str) -> DataFrame:
    """One row a job: its status and error, and its counters over all batches and restarts."""
    done = spark.read.schema(f"{COUNTERS}, job string, batch bigint").option("basePath", f"{path}/counters").parquet(f"{path}/counters/job=*")
    totals = done.groupBy("job").agg(F.count("*").alias("batches"), *[F.sum(c).alias(c) for c in ("pages", "messages", "bodies", "skipped")])
    return spark.read.schema(f"{STATES}, job string").parquet(f"{path}/states").join(totals, "job", "left")
