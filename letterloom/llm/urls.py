"""URL filters: rules first, then the ratio of two character language models.

Accepted and rejected URLs each have a Markov model of characters, of up to ``ORDER``
characters of context, smoothed by Witten and Bell: a character costs an escape where its
context has not met it, and contexts not met at all hand on to shorter ones. The score of a
URL is the difference of its log-likelihoods a character. Written out, it is a sum of one
weight for each run of 1 to ORDER + 1 characters of the URL, so scoring is one join and one
sum. The threshold is the score that a given share of the accepted URLs kept out of training
stay below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.llm.lines import LOWER, UPPER
from letterloom.llm.tables import pick, stored
from letterloom.operators.ordering import number_rows

ORDER = 3
#: Weights go to every task only while there are no more than this; else they are joined by shuffle.
BROADCAST_ROWS = 1_000_000
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Hosts with one of these between separators are examples of what to reject.
SEEDS = ("casino", "bets", "pills", "spam", "ads", "adult")


def _lower(text: Column) -> Column:
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host, path and ``tail``, all that follows the host; empty for a URL that is NULL or has no ``://``."""
    at = F.coalesce(F.instr("url", "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(F.col("url"), at + 3)).otherwise("")
    return pick(pages, "page_id", "url").select("page_id", rest.alias("rest")).select(
        "page_id", _lower(F.regexp_extract("rest", r"^[^/?#]*", 0)).alias("host"), F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"),
        F.regexp_extract("rest", r"(?s)^[^/?#]*(.*)$", 1).alias("tail"))


def ruled(urls: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """``urls`` with the longest rule that fits and its verdict, or NULL for both.

    A rule fits its host and all subdomains when the path begins with the rule's.
    """
    fits = []
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        fit = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        fits.append(F.when(fit, F.struct(F.lit(len(rule)).alias("n"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    best = F.array_max(F.array(*fits))
    return urls.withColumn("best", best).select("*", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("ruling")).drop("best")


def _grams(df: DataFrame, *keep: str) -> DataFrame:
    """Every run of 1 to ORDER + 1 characters; a line break stands for the end of the URL."""
    marked = df.withColumn("s", F.concat("text", F.lit("\n")))
    runs = F.expr(f"""flatten(transform(sequence(1, length(s)), i -> transform(
        sequence(1, least(i, {ORDER + 1})), n -> substring(s, i - n + 1, n))))""")
    return marked.select(*keep, F.explode(runs).alias("gram"))


def weights(examples: DataFrame) -> tuple[DataFrame, float]:
    """(gram, weight) from (text, rejected), and the weight of every character as such.

    ``weight`` is log P(rejected) - log P(accepted): what the run adds as the end of a longer
    context, and what it adds as the context of the next character.
    """
    counts = _grams(examples, "rejected").groupBy("rejected", "gram").agg(F.count("*").cast("double").alias("n"))
    counts = stored(counts.withColumn("size", F.length("gram")), "url-grams")
    after = counts.where("size > 1").groupBy("rejected", F.expr("substring(gram, 1, size - 1)").alias("gram")).agg(
        F.sum("n").alias("met"), F.count("*").cast("double").alias("kinds"))
    start = {r["rejected"]: (r["met"], r["kinds"]) for r in counts.where("size = 1").groupBy("rejected").agg(
        F.sum("n").alias("met"), F.count("*").cast("double").alias("kinds")).collect()}
    if len(start) < 2:
        return counts.select("gram", F.lit(0.0).alias("weight")).limit(0), 0.0
    met0, kinds0 = (F.when(F.col("rejected"), F.lit(start[True][k])).otherwise(F.lit(start[False][k])) for k in (0, 1))
    level = counts.where("size = 1").select("rejected", "gram", ((F.col("n") + kinds0 / 65536) / (met0 + kinds0)).alias("p"),
                                            (F.lit(1 / 65536) * kinds0 / (met0 + kinds0)).alias("low"))
    parts = level.select("rejected", "gram", F.log(F.col("p") / F.col("low")).alias("w"))
    for size in range(2, ORDER + 2):
        longer = counts.where(f"size = {size}").select(
            "rejected", "gram", "n", F.expr("substring(gram, 1, size - 1)").alias("context"), F.expr("substring(gram, 2)").alias("shorter"))
        longer = longer.join(level.select("rejected", F.col("gram").alias("shorter"), F.col("p").alias("below")), ["rejected", "shorter"])
        longer = longer.join(after.withColumnRenamed("gram", "context"), ["rejected", "context"])
        level = longer.select("rejected", "gram", ((F.col("n") + F.col("kinds") * F.col("below")) / (F.col("met") + F.col("kinds"))).alias("p"),
                              (F.col("kinds") * F.col("below") / (F.col("met") + F.col("kinds"))).alias("low"))
        parts = parts.unionAll(level.select("rejected", "gram", F.log(F.col("p") / F.col("low")).alias("w")))
    escapes = after.where(F.length("gram") <= ORDER).select("rejected", "gram", F.log(F.col("kinds") / (F.col("met") + F.col("kinds"))).alias("w"))
    signed = F.sum(F.when(F.col("rejected"), F.col("w")).otherwise(-F.col("w")))
    table = stored(parts.unionAll(escapes).groupBy("gram").agg(signed.alias("weight")), "url-weights")
    from math import log

    each = [log(k / (m + k)) for m, k in (start[True], start[False])]
    return table, each[0] - each[1]


def scores(texts: DataFrame, table: DataFrame, each: float) -> DataFrame:
    """(text, score) of each ``text``: log-likelihood ratio a character, its end counted."""
    if table.count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    summed = _grams(texts, "text").join(table, "gram", "left").groupBy("text").agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("w"))
    return summed.select("text", (F.col("w") / (F.length("text") + 1) + F.lit(each)).alias("score"))


def quantile(scored: DataFrame, share: float) -> float | None:
    """The score that ``share`` of the rows (text, score) are below, between two scores in proportion.

    Scores are put in order by range, so no task holds them all; two rows come to the driver.
    """
    count = scored.count()
    if not count:
        return None
    at = (count - 1) * share
    low = int(at)
    near = number_rows(scored.select("score", "text"), ["score", "text"], "at").where(F.col("at").isin(low + 1, low + 2)).orderBy("at").select("score").collect()
    first, last = near[0][0], near[-1][0]
    return first + (last - first) * (at - low)


def url_filter(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, seeds: tuple[str, ...] = SEEDS,
               false_rejects: float = 0.01) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row of ``pages``.

    The verdict is the rule's, else ``block`` where the score is over the threshold. The models
    see whole URLs after ``://``, query and fragment included, with the host in lower case. Rejected
    examples are URLs that a rule blocks or whose host has a seed word; all others are
    accepted ones, each different URL once. A quarter of the accepted, by hash, is kept out of
    training and sets the threshold so that at most ``false_rejects`` of them are over it. A
    URL without a host has no score and is blocked; without examples of both kinds nothing is
    blocked but by rule. NULL page_ids and repeated rows are rows like others; other columns
    are ignored.
    """
    urls = stored(ruled(parsed(pages), rules).withColumn("text", F.concat("host", "tail")), "urls")
    seeded = F.col("host").rlike("(^|[.-])(" + "|".join(seeds) + ")([.-]|$)")
    # A URL is one row from here on, however many pages have it.
    texts = urls.where("text <> ''").groupBy("text").agg(
        F.max(F.coalesce(F.col("ruling") == "block", seeded & F.col("ruling").isNull())).alias("rejected"),
        F.max(F.col("ruling").isNull()).alias("asked"))
    texts = stored(texts.withColumn("apart", ~F.col("rejected") & (F.pmod(F.xxhash64("text"), F.lit(4)) == 0)), "url-texts")
    table, each = weights(texts.where("NOT apart").select("text", "rejected"))
    scored = stored(scores(texts.where("asked OR apart").select("text"), table, each), "url-scores")
    limit = quantile(scored.join(texts.where("apart").select("text"), "text"), 1 - false_rejects)
    over = F.coalesce(F.col("score") > F.lit(max(limit or 0.0, 0.0)), F.col("text") == "")
    out = urls.join(scored.withColumnRenamed("text", "of"), F.col("text") == F.col("of"), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruling", F.when(over, "block").otherwise("allow")).alias("verdict"),
                      F.when(F.col("ruling").isNull(), F.col("score")).alias("score"))
