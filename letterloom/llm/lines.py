"""Line dedup: repeated lines stay in one document only; the result is a bitmap per document.

Keys of lines are range-partitioned by hash, document (largest first) and position, so one
key with any share of the rows is spread over as many partitions as it fills. Each partition
is then read in that order: the first document of a key is the one that keeps it. Only the
first and the last key of a partition can go on in another, so at most two keys a partition
have to be counted across partitions.

Defined results: a null or empty text is one empty line; a row without ``doc_id`` is no
document, it counts for no key and keeps all its lines; rows repeated in full count once and
get the same bitmap; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from letterloom.llm.tables import pick, stored

#: Fixed value: the characters of [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with A-Z in lower case; other letters stay."""
    bare = F.btrim(line, F.lit(WHITE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def with_row(docs: DataFrame) -> DataFrame:
    """Documents with ``row``, a hash that tells different texts of one id apart."""
    return pick(docs, "doc_id", "text").withColumn("row", F.xxhash64("text"))


def line_keys(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """A row for each line long enough to be judged: 128 bits of its key, document, position."""
    lines = with_row(docs).where("doc_id IS NOT NULL").select(
        "doc_id", "row", F.posexplode(text_lines(F.col("text"))).alias("pos", "line"))
    keyed = lines.select("doc_id", "row", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "doc_id", "row", "pos")


def dropped_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, row, pos) of each line that goes."""
    # Written before it is ranged: finding range bounds reads its input once more.
    keys = stored(line_keys(docs, min_chars), "line-keys")
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc(), F.col("row"), F.col("pos")]
    ranged = stored(
        keys.repartitionByRange(*order[:3]).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()),
        "line-ranges")
    # Keys on the border of two partitions: two a partition at most, so the hint is bounded.
    ends = ranged.groupBy("part").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"))
    split = ends.select("part", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("h1")) \
        .groupBy("h1").agg(F.count("*").alias("parts")).where("parts > 1").select("h1", F.lit(True).alias("split"))
    group = Window.partitionBy("part", "h1", "h2")
    stream = group.orderBy(*order[2:])
    seen = ranged.select(
        "*", F.dense_rank().over(group.orderBy(order[2])).alias("nth"), F.row_number().over(stream).alias("at"),
        F.first("doc_id").over(stream).alias("top"))
    seen = seen.withColumn("n_docs", F.max("nth").over(group))
    # A key and document never straddle a border, so documents of the pieces of a key add up.
    repeated = stored(
        seen.join(F.broadcast(split), "h1", "left").where(f"split OR n_docs >= {min_docs}")
        .select("h1", "h2", "doc_id", "row", "pos", "at", "top", "n_docs", F.coalesce("split", F.lit(False)).alias("split")),
        "line-repeats")
    totals = repeated.where("split AND at = 1").groupBy("h1", "h2").agg(
        F.sum("n_docs").alias("all_docs"), F.max("top").alias("all_top"))
    whole = repeated.where("NOT split").select("doc_id", "row", "pos", "top")
    pieces = repeated.where("split").join(F.broadcast(totals), ["h1", "h2"]).where(f"all_docs >= {min_docs}") \
        .select("doc_id", "row", "pos", F.col("all_top").alias("top"))
    return whole.unionAll(pieces).where("doc_id < top").select("doc_id", "row", "pos")


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """One row for each document that loses lines: doc_id, row, n_dropped and ``keep``.

    ``keep`` lists the blocks of 64 lines that lose any, in order, each with its number and 64
    bits, 1 for lines that stay. Blocks that stay whole and documents that do are left out.
    """
    blocks = dropped_lines(docs, min_chars, min_docs).groupBy(
        "doc_id", "row", F.expr("pos div 64").cast("int").alias("block")).agg(
            F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("gone"))
    return blocks.groupBy("doc_id", "row").agg(
        F.sum(F.bit_count("gone")).cast("long").alias("n_dropped"),
        F.sort_array(F.collect_list(F.struct("block", F.bitwise_not("gone").alias("bits")))).alias("keep"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Documents with n_lines, n_dropped and ``kept``, the text without the lines that go."""
    # Blocks in full up to the last one listed, so that a line finds its bits by number.
    spread = bitmaps.select(
        F.col("doc_id").alias("to"), F.col("row").alias("to_row"), "n_dropped",
        F.expr("""flatten(transform(keep, (x, i) -> concat(
            array_repeat(-1L, x.block - if(i = 0, -1, keep[greatest(i - 1, 0)].block) - 1), array(x.bits))))""").alias("bits"))
    rows = docs.withColumn("__row", F.xxhash64("text"))
    joined = rows.join(spread, (rows["doc_id"] == spread["to"]) & (rows["__row"] == spread["to_row"]), "left")
    left = F.expr("""array_join(filter(split(text, '\\n', -1), (x, i) -> coalesce(
        shiftright(get(bits, cast(i div 64 AS INT)), i % 64) & 1L, 1L) = 1L), '\\n')""")
    return joined.withColumns({
        "n_lines": F.size(text_lines(F.col("text"))).cast("long"),
        "kept": F.when(F.col("bits").isNull(), F.coalesce("text", F.lit(""))).otherwise(left),
        "n_dropped": F.coalesce("n_dropped", F.lit(0)).cast("long"),
    }).drop("to", "to_row", "__row", "bits")


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) of every row of ``docs``."""
    plain = pick(docs, "doc_id", "text")
    return apply_bitmaps(plain, keep_bitmaps(plain, min_chars, min_docs)).select("doc_id", "n_lines", "n_dropped", "kept")


#: The same by DuckDB: keys and the largest document of each are found with a join.
LINE_DEDUP_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {docs}),
l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
f AS (SELECT k.*, r.top IS NOT NULL AND k.doc_id < r.top AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept
FROM f GROUP BY doc_id
"""
