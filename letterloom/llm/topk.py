"""Exact nearest binary codes by incremental multi-index hashing.

A vector's code has a bit for the sign of each component. Codes are cut into segments, and
each segment value leads to its codes. If two codes differ in d bits, they differ in at most
floor(d / segments) bits of some segment. Rounds therefore grow the radius of the search in
every segment; once all values within radius r have been looked up, every code within
segments * (r + 1) - 1 bits has been met. A query is done when its k-th distance so far is
no more than that, and only queries that are not done go on. Each round only lets through
codes that are no farther than the k-th of the round before.

Equal codes are one entry with their smallest ids, so a vector that many rows share is looked
up once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from letterloom.llm.tables import pick, stored

SEGMENT_BITS = 16


def code(vector: Column, bits: int) -> Column:
    """The sign bits as 64-bit numbers; components that are missing or NULL count as not positive."""
    words = [F.aggregate(F.transform(F.slice(vector, 64 * w + 1, 64), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))),
                         F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)) for w in range(-(-bits // 64))]
    return F.array(*words)


def _distance(a: str, b: str) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")


def _segment(source: str, at: Column, bits: int) -> Column:
    """The ``bits``-bit value of segment ``at``."""
    per = 64 // bits
    word = F.get(F.col(source), F.floor(at / per).cast("int"))
    return F.call_function("shiftrightunsigned", word, (at % per * bits).cast("int")).bitwiseAND(F.lit((1 << bits) - 1)).cast("long")


def nearest(vectors: DataFrame, queries: DataFrame, bits: int, k: int = 10, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """(query_id, rank, vec_id, distance): the ``k`` nearest codes of each query but its own row.

    ``vectors`` and ``queries`` have vec_id and embedding. Equal distances are ranked by
    vec_id. Rows of NULL vec_id or embedding are neither found nor searched for; a repeated
    id is one row; a query gets fewer than ``k`` rows when there are fewer vectors. Other
    columns are ignored. ``segment_bits`` divides 64.
    """
    segments = -(-bits // segment_bits)
    want = k + 1  # a query's own row is found and left out at the end
    coded = lambda df: pick(df, "vec_id", "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(
        "vec_id", code(F.col("embedding"), bits).alias("code")).distinct()
    # The first ids of each code; the limit runs in every task before the shuffle.
    order = F.row_number().over(Window.partitionBy("code").orderBy("vec_id"))
    index = stored(coded(vectors).withColumn("nth", order).where(F.col("nth") <= want).groupBy("code").agg(
        F.sort_array(F.collect_list("vec_id")).alias("ids")), "codes")
    asked = stored(coded(queries), "query-codes")
    by_segment = index.select(F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("segment"), "code", "ids")
    by_segment = stored(by_segment.withColumn("value", _segment("code", F.col("segment"), segment_bits)), "segments")

    open_ = asked.select(F.col("code").alias("q")).distinct().withColumn("bound", F.lit(bits))
    found = None
    for radius in range(segment_bits + 1):
        # All masks of ``radius`` bits; a constant of the plan.
        flips = F.expr(f"filter(sequence(0L, {(1 << segment_bits) - 1}L), x -> bit_count(x) = {radius})")
        probes = open_.select("q", "bound", F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("segment")) \
            .withColumn("value", _segment("q", F.col("segment"), segment_bits)) \
            .select("q", "bound", "segment", "value", F.explode(flips).alias("flip")) \
            .select("q", "bound", "segment", F.col("value").bitwiseXOR(F.col("flip")).alias("value"))
        # Probes are many times what is known of their size beforehand: both sides are sorted.
        met = probes.hint("merge").join(by_segment, (probes["segment"] == by_segment["segment"]) & (probes["value"] == by_segment["value"])
                          & (_distance("q", "code") <= F.col("bound"))).select("q", "code", "ids", _distance("q", "code").alias("distance")).distinct()
        if found is not None:
            met = met.join(found.select("q", "code"), ["q", "code"], "left_anti").unionAll(found)
        best = F.row_number().over(Window.partitionBy("q").orderBy("distance", F.get("ids", F.lit(0))))
        found = stored(met.withColumn("nth", best).where(F.col("nth") <= want).select("q", "code", "ids", "distance"), "nearest")
        # The distance of the last id wanted, as far as codes were met.
        ids = Window.partitionBy("q").orderBy("distance", F.get("ids", F.lit(0)))
        bound = found.withColumn("upto", F.sum(F.size("ids")).over(ids)).where(F.col("upto") >= want).groupBy("q").agg(F.min("distance").alias("bound"))
        covered = segments * (radius + 1) - 1
        left = open_.select("q").join(bound, "q", "left").withColumn("bound", F.coalesce("bound", F.lit(bits)))
        open_ = stored(left.where(F.col("bound") > covered), "open-queries")
        if covered >= bits or open_.isEmpty():
            break
    pairs = asked.select(F.col("vec_id").alias("query_id"), F.col("code").alias("q")).join(found, "q").select(
        "query_id", "distance", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("distance").cast("long").alias("distance"))


#: Brute force: every query against every row.
NEAREST_SQL = """
WITH b AS (SELECT DISTINCT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id,
      CAST(list_sum([CASE WHEN (x[1] > 0) <> (x[2] > 0) THEN 1 ELSE 0 END FOR x IN list_zip(q.embedding, v.embedding)]) AS BIGINT) AS distance
      FROM b q, b v WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, distance FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p) WHERE rank <= 10
"""
