"""Groups of rows that hang together by shared keys.

Rows and keys are two sides of one graph; labels go from rows to keys and back, each an
aggregation, so a key that a third of all rows hold costs as many rows as hold it. Whoever
learns a smaller label hands it to the row that gave its old one, and labels of labels are
looked up in each round, so the reach of a label multiplies and the rounds grow with the
logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterloom.session import materialise


def components(holds: DataFrame, row: str, key: str) -> DataFrame:
    """(row, component) of every row in ``holds`` (row, key): the smallest row it hangs together with."""
    edges = materialise(holds.select(F.col(row).alias("_row"), F.col(key).alias("_key")).distinct())
    labels = materialise(edges.select("_row", F.col("_row").alias("_label")).distinct())
    while True:
        held = edges.join(labels, "_row")
        least = held.groupBy("_key").agg(F.min("_label").alias("_least"))
        heard = held.join(least, "_key")
        told = heard.select("_row", F.col("_least").alias("_label")).unionAll(
            heard.select(F.col("_label").alias("_row"), F.col("_least").alias("_label")))
        lowest = told.groupBy("_row").agg(F.min("_label").alias("_new"))
        # The label of the label: a reach of n rows becomes one of 2n and more.
        beyond = lowest.select(F.col("_row").alias("_new"), F.col("_new").alias("_next"))
        moved = materialise(labels.join(lowest, "_row").join(beyond, "_new").select(
            "_row", F.col("_next").alias("_label"), (F.col("_next") != F.col("_label")).alias("_moved")))
        labels = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            return labels.select(F.col("_row").alias(row), F.col("_label").alias("component"))
