"""Positions and neighbours in ordered groups, however large one group is.

A plain window sends a whole group to one task. These helpers range-sort the rows instead, so
a hot group is spread over many partitions, and stitch the pieces with per-piece counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from letterloom.session import materialise

BLOCK_ROWS = 100_000


def _columns(order) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def _position(df: DataFrame, keys, order, out: str) -> DataFrame:
    """1-based position by range partitions; rows must be uniquely ordered."""
    pieces = materialise(
        df.orderBy(*keys, *_columns(order)).withColumn("_piece", F.spark_partition_id()))
    counts = pieces.groupBy(*keys, "_piece").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(
        Window.unboundedPreceding, -1)
    counts = counts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_piece").alias("_p"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = pieces.join(counts, same + [F.col("_piece") == F.col("_p")])
    inside = Window.partitionBy(*keys, "_piece").orderBy(*_columns(order))
    return joined.withColumn(out, F.row_number().over(inside) + F.col("_before")).drop(
        "_piece", "_p", "_before", *[f"_k{i}" for i in range(len(keys))])


def number_rows(df: DataFrame, order, out: str = "position") -> DataFrame:
    """Number all rows in a total order: sort by range, count per piece, add offsets."""
    pieces = materialise(
        df.orderBy(*_columns(order)).withColumn("_piece", F.spark_partition_id()))
    # One row per partition, so this window and the join below stay as small as the
    # number of partitions.
    counts = pieces.groupBy("_piece").agg(F.count("*").alias("_n")).select(
        F.col("_piece").alias("_p"),
        F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_piece").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_piece").orderBy(*_columns(order))
    return pieces.join(counts, F.col("_piece") == F.col("_p")).withColumn(
        out, F.row_number().over(inside) + F.col("_before")).drop("_piece", "_p", "_before")


def number_in_groups(df: DataFrame, keys, order, out: str = "position") -> DataFrame:
    """Number the rows of each group."""
    return _position(df, keys, order, out)


def with_neighbours(df: DataFrame, keys, order, reach: int, compute, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Run ``compute(df, window)`` where the window sees ``reach`` rows to either side.

    Groups are cut into blocks by position; every block also gets copies of
    the ``reach`` rows around it, which are dropped again after the computation.
    """
    block_rows = max(block_rows, reach)
    at = F.col("_pos")
    df = _position(df, keys, order, "_pos")
    home = F.floor((at - 1) / block_rows)
    low = F.floor((at - 1 - reach) / block_rows)
    high = F.floor((at - 1 + reach) / block_rows)
    blocks = df.withColumn("_home", home).withColumn("_block", F.explode(
        F.array_distinct(F.array(F.greatest(low, F.lit(0)), home, high))))
    window = Window.partitionBy(*keys, "_block").orderBy("_pos")
    return compute(blocks, window).where(F.col("_home") == F.col("_block")).drop(
        "_home", "_block", "_pos")


def number_runs(df: DataFrame, order, label: str, out: str = "run") -> DataFrame:
    """Number the runs of equal labels in a total order; a label can come back in a later run.

    Rows are sorted by range and each piece finds where labels change inside it. Whether a
    piece goes on with the run of the piece before it, and how many runs there were before,
    is settled over one row a piece.
    """
    pieces = materialise(df.orderBy(*_columns(order)).withColumns({"_piece": F.spark_partition_id(), "_all": F.lit(0)}))
    inside = Window.partitionBy("_piece").orderBy(*_columns(order))
    marked = pieces.withColumns({
        "_new": (F.col(label) != F.lag(label).over(inside)).cast("int"), "_end": F.lead(label).over(inside).isNull()})
    sizes = marked.groupBy("_all", "_piece").agg(F.coalesce(F.sum("_new"), F.lit(0)).alias("_inner"))
    edges = marked.where("_new IS NULL OR _end").groupBy("_piece").agg(
        F.max(F.when(F.col("_new").isNull(), F.col(label))).alias("_first"), F.max(F.when(F.col("_end"), F.col(label))).alias("_last"))
    along = Window.partitionBy("_all").orderBy("_piece")
    opens = F.coalesce((F.col("_first") != F.lag("_last").over(along)).cast("int"), F.lit(1))
    carried = sizes.join(edges, "_piece").withColumn("_opens", opens).select(
        F.col("_piece").alias("_p"), (F.sum(F.col("_opens") + F.col("_inner")).over(along) - F.col("_inner")).alias("_before"))
    return marked.join(carried, F.col("_piece") == F.col("_p")).withColumn(
        out, F.coalesce(F.sum("_new").over(inside), F.lit(0)) + F.col("_before")).drop("_piece", "_p", "_all", "_new", "_end", "_before")


def top_in_groups(df: DataFrame, keys, order, k: int, out: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group.

    Spark keeps ``k`` rows per group in every task before it shuffles, so a hot group sends
    ``k`` rows per task, not all its rows.
    """
    window = Window.partitionBy(*keys).orderBy(*_columns(order))
    return df.withColumn(out, F.row_number().over(window)).where(F.col(out) <= k)
