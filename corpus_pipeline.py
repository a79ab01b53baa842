"""Raw documents to token ids: five stages, each written as Parquet and read by the next.

Each stage takes (spark, docs, sf_dir). All but the last give back the columns of
``documents``; what a stage decides takes effect on its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.llm import bpe, decontam, langid, lines, neardup
from letterloom.llm.queries import ranks
from letterloom.llm.tables import pick, stored, table
from letterloom.operators.ordering import top_in_groups
from letterloom.session import configure

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def prepare(spark: SparkSession) -> None:
    """Session settings of a stage. Python workers stay from stage to stage, so their batches are small."""
    configure(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; see ``langid.recognised`` for those that go."""
    prepare(spark)
    return langid.recognised(docs, langid.train(docs), COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that at least five hold; ``n_chars`` follows the text."""
    prepare(spark)
    docs = pick(docs, *COLUMNS)
    left = lines.apply_bitmaps(docs, lines.keep_bitmaps(docs))
    return left.withColumns({"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one of smallest doc_id, once if its row is repeated.

    Rows of one doc_id and the same text are repeats; which of them stays makes no difference
    to doc_id and text, and of other columns those that come first by value stay.
    """
    prepare(spark)
    docs = pick(docs, *COLUMNS)
    gone = neardup.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    # Repeats are looked for in the input, where no text has to move for it.
    same = F.xxhash64("text").alias("same")
    repeated = stored(docs.where("doc_id IS NOT NULL").groupBy("doc_id", same).count().where("count > 1").select("doc_id", "same"), "repeated-rows")
    left = docs.join(gone, "doc_id", "left_anti")
    if repeated.isEmpty():
        return left.select(*COLUMNS)
    left = left.withColumn("same", F.xxhash64("text"))
    once = top_in_groups(left.join(repeated, ["doc_id", "same"]), ["doc_id", "same"], ["lang", "source", "n_chars"], 1)
    return left.join(repeated, ["doc_id", "same"], "left_anti").select(*COLUMNS).unionAll(once.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark."""
    prepare(spark)
    return decontam.clean(pick(docs, *COLUMNS), table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids, and a digest of what they decode to."""
    prepare(spark)
    vocabulary = ranks()
    return bpe.decode(bpe.encode(docs, vocabulary), vocabulary).select(
        "doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
    ("decontamination", decontamination), ("encoding", encoding),
]
#: Language ID, near-dedup, edit distances and merges have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
