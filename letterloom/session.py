"""Session settings and the shared folder that long jobs write to."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution measures shuffle output before it picks a join, so no join in this
# package carries a broadcast hint: small sides are broadcast after their real size is
# known, large ones stay sort-merge and their hot partitions are split.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Rows of whole texts: smaller batches keep Python workers and Arrow buffers small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings every job here relies on; dates are always read as UTC."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, one in the warehouse.

    Executors share the warehouse as they share its tables, so neither is ever a folder that
    only one machine sees.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = context.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back from there.

    Cuts the lineage, survives the loss of executors, and freezes any value that depends
    on how rows were partitioned.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


# Packed columns that one task of costly work reads; a hundred thousand rows or two.
PIECE_BYTES = 4 << 20
# What one job can keep track of; beyond it pieces grow.
MOST_PIECES = 50_000


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many pieces as its size and the cores call for, if its files give fewer; else as it is.

    For the input of work that is costly by row: a file of one row group is one task, however
    many cores wait, and a task of as many packed rows as Spark reads at once takes too long.
    What a shuffle has dealt out, a stream, and a table of enough small files stay as they are.
    """
    if df.isStreaming:
        return df
    query = df._jdf.queryExecution()
    # Plans with a shuffle are adaptive; asking them for their partitions would run them.
    if query.executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return df
    size = int(str(query.optimizedPlan().stats().sizeInBytes()))
    # Rows that are no files have no known size, which Spark takes for the largest there is.
    known = size if size < 1 << 56 else 0
    cores = df.sparkSession.sparkContext.defaultParallelism
    pieces = cores * max(1, -(-min(known // PIECE_BYTES, MOST_PIECES) // cores))
    return df if query.toRdd().getNumPartitions() >= pieces else df.repartition(pieces)
