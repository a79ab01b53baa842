"""Intermediate tables in the shared folder, and text columns as rows of given columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.session import fresh_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table, read by Spark from whatever store the folder is in."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from there.

    Every later step reads the files, so lost executors cost a re-read at most, and values
    that depend on how rows were dealt (sampled ranges, partition numbers) stay as they are.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; whatever else a table carries, under any name, is left alone."""
    return df.select(*[F.col(f"`{n}`") for n in names])
