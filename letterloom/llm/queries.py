"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.llm import bpe, decontam, langid, lines, neardup, quality, resample, secret_scan, substrings, token_counts, topk, turn_trie, urls
from letterloom.llm.tables import table
from letterloom.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = lambda spark, folder: function(configure(spark), folder)
        if sql is not None:
            ORACLES[name] = sql.strip()
        return function
    return register


#: Personal data that the token counts take out: mail addresses and long numbers.
PERSONAL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+|[0-9][0-9 -]{5,}[0-9]"


@query("op1_url_filter")
def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.url_filter(table(spark, folder, "pages"))


@query("op2_topk", topk.NEAREST_SQL)
def op2_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The query set is every row whose id is divisible by 50."""
    vectors = table(spark, folder, "embeddings")
    return topk.nearest(vectors, vectors.where("vec_id % 50 = 0"), bits=64)


@query("op3_near_dedup")
def op3_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"))


def ranks() -> bytes:
    """The vocabulary that the queries use; the operators take any."""
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query("op4_bpe")
def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = ranks()
    both = bpe.decode(bpe.encode(table(spark, folder, "documents"), vocabulary), vocabulary)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op5_substring_dedup")
def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.substring_dedup(table(spark, folder, "documents"))


@query("op6_quality")
def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Grades are 0 toxic, 1 of low quality, 2 good; kept documents are probably good."""
    docs = table(spark, folder, "documents")
    model = quality.train(docs, quality.grades_of(table(spark, folder, "labels")), grades=3)
    return quality.selected(quality.rate(docs, model, grades=3), grade=2)


@query("op7_line_dedup", "SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM ("
       + lines.LINE_DEDUP_SQL.format(docs="documents") + ")")
def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.line_dedup(table(spark, folder, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of each document before and after its personal data are taken out."""
    edits = token_counts.redactions(table(spark, folder, "documents"), PERSONAL, "[removed]")
    return token_counts.counted(edits, ranks())


@query("op9_language_id")
def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return langid.predict(docs, langid.train(docs)).select(
        "doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")


@query("op10_decontamination")
def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op11_resample", resample.RESAMPLE_SQL)
def op11_resample(spark: SparkSession, folder: str) -> DataFrame:
    """Documents drawn for their likeness to the benchmark."""
    drawn = resample.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query("op12_secrets")
def op12_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of each document, plain and wrapped."""
    found = secret_scan.secrets(table(spark, folder, "documents"))
    return found.select(
        "doc_id", *[secret_scan.count_of(k).alias(f"n_{k}") for k in secret_scan.KINDS],
        F.sha2(secret_scan.spans(plain=True), 256).alias("base_sha256"), secret_scan.spans().alias("spans"), "n_closed")


@query("op13_turn_trie", turn_trie.TRIE_SQL)
def op13_turn_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Prefixes that conversations share, after each took its opening from the first of its twenty."""
    turns = turn_trie.numbered(table(spark, folder, "conversations"))
    return turn_trie.trie(*turn_trie.with_shared_openings(turns))
