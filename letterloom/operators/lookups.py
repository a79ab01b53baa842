"""Lookups between messages, contacts, sources and short references.

No join here is hinted: adaptive execution broadcasts a side whose measured size allows it
and splits hot partitions of the rest. Lookups by sender run on the distinct senders, so a
sender with a third of all messages is looked up once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.functions import patterns as P

# Rank of keys made from the fixed labels: after those of any number of sources.
LAST = 1_000_000_000
# Length of the pieces by which substrings are looked up.
GRAM = 3


def after_colon(text: Column) -> Column:
    return F.substr(text, F.instr(text, F.lit(":")) + 1)


def _grams(text: Column, sizes: Column) -> Column:
    """The distinct pieces of a text that have one of the sizes."""
    return F.array_distinct(F.flatten(F.transform(sizes, lambda n: F.transform(
        F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.substring(text, i, n)))))


def candidates(texts: DataFrame, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """(text, needle) of distinct texts and needles that may be in them.

    Needles are indexed by one piece each, of GRAM characters or their whole length if that is
    less: the piece that the fewest texts have. A text meets a needle only through that piece,
    and a needle with a piece that no text has meets none.
    """
    wanted = needles.where(F.length(needle) > 0).select(F.col(needle).alias(needle)).distinct()
    size = F.least(F.length(needle), F.lit(GRAM))
    index = wanted.select(needle, F.explode(_grams(F.col(needle), F.array(size))).alias("_gram"))
    sizes = wanted.agg(F.collect_set(size)).scalar()
    pieces = texts.select(text).distinct().withColumn("_sizes", sizes).select(text, F.explode(_grams(F.col(text), F.col("_sizes"))).alias("_gram")).join(
        index.select("_gram").distinct(), "_gram", "left_semi")
    held = pieces.groupBy("_gram").agg(F.count("*").alias("_n"))
    rarest = index.join(held, "_gram", "left").groupBy(needle).agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram")).alias("_best")).select(needle, F.col("_best._gram").alias("_gram"))
    return pieces.join(rarest, "_gram").select(text, needle)


def containing(left: DataFrame, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """Rows of ``left`` with each needle that their text contains; nothing is compared pairwise."""
    hits = candidates(left, text, needles, needle).where(F.contains(F.col(text), F.col(needle)))
    return left.join(hits, text)


def aliases(contacts: DataFrame) -> DataFrame:
    """One alias per identifier; the alphabetically first where two claim it."""
    return contacts.groupBy("identifier").agg(F.min("alias").alias("alias"))


def siblings(sources: DataFrame) -> DataFrame:
    """For each source the sources of the same provider, in configured order."""
    left = sources.select(F.col("prefix"), F.lower("provider").alias("_provider"))
    right = sources.select(
        F.col("prefix").alias("sibling"), F.lower("provider").alias("_provider"),
        F.col("ord").alias("sibling_ord"))
    return left.join(right, "_provider").drop("_provider")


def _under_sources(known: DataFrame, sources: DataFrame) -> DataFrame:
    """(provider, own, prio, alias) of identifiers under a configured source: what follows its prefix.

    Every stretch before a colon may be the prefix, so prefixes are looked up by value.
    """
    parts = F.split("identifier", ":", -1)
    cut = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.struct(
        F.array_join(F.slice(parts, F.lit(1), n), ":").alias("prefix"), F.array_join(F.slice(parts, n + 1, F.size(parts)), ":").alias("own")))
    return known.where(F.instr("identifier", ":") > 0).select("alias", F.inline(cut)).join(
        sources.select("prefix", F.lower("provider").alias("provider"), (F.col("ord") + 3).alias("prio")), "prefix").select(
        "provider", "own", "prio", "alias")


def named(rows: DataFrame, contacts: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows that no two agree in, with the ``name`` of their sender: an alias, or the sender.

    Keys in falling priority: the sender itself; the part after its colon, where it has one;
    else the sender under its own source, under sources of the same provider, under the
    canonical ones. A row asks for a fixed number of keys, and for the sender under its
    provider, whose sources are taken off the identifiers; so no keys grow with the sources.
    The best hit is taken with map-side partials.
    """
    sender, known = F.col("sender"), aliases(contacts)

    def key(prio, value):
        return F.struct(F.lit(prio).alias("_prio"), value.alias("identifier"))

    own = F.filter(
        F.array(F.when(F.col("source") != "", key(2, F.concat("source", F.lit(":"), sender))),
                *[key(LAST + i, F.concat(F.lit(f"{p}:"), sender)) for i, p in enumerate(P.SOURCE_LABELS)]), lambda x: x.isNotNull())
    keys = F.concat(F.array(key(0, sender)), F.when(F.instr(sender, ":") > 0, F.array(key(1, after_colon(sender)))).otherwise(own))
    direct = rows.select(*rows.columns, F.inline(keys)).join(known, "identifier").select(*rows.columns, "_prio", F.col("alias").alias("_alias"))
    provider = sources.select(F.col("prefix").alias("_prefix"), F.lower("provider").alias("_provider"))
    under = _under_sources(known, sources).select(F.col("provider").alias("_provider"), F.col("own").alias("_own"), F.col("prio").alias("_prio"), F.col("alias").alias("_alias"))
    related = rows.where(F.instr(sender, ":") == 0).join(provider, F.col("source") == F.col("_prefix")).withColumn("_own", sender).join(under, ["_provider", "_own"]).select(*rows.columns, "_prio", "_alias")
    nothing = rows.select(*rows.columns, F.lit(None).cast("int").alias("_prio"), F.lit(None).cast("string").alias("_alias"))
    hit = F.when(F.col("_alias").isNotNull(), F.struct("_prio", "_alias"))
    return nothing.unionAll(direct).unionAll(related).groupBy(*rows.columns).agg(F.min(hit).alias("_hit")).select(
        *rows.columns, F.coalesce("_hit._alias", "sender").alias("name"))


def with_aliases(df: DataFrame, contacts: DataFrame, sources: DataFrame) -> DataFrame:
    """Messages with the resolved ``name`` of their sender; each distinct sender is looked up once."""
    pairs = df.select(F.coalesce("source", F.lit("")).alias("source"), F.coalesce("sender", F.lit("")).alias("sender")).distinct()
    names = named(pairs, contacts, sources).withColumnsRenamed({"source": "_source", "sender": "_sender"})
    return df.join(
        names, (F.coalesce("source", F.lit("")) == F.col("_source"))
        & (F.coalesce("sender", F.lit("")) == F.col("_sender")), "left").drop("_source", "_sender")


def configured(df: DataFrame, sources: DataFrame) -> DataFrame:
    """Messages of configured sources, with their provider."""
    known = sources.select(F.col("prefix").alias("source"), F.col("provider").alias("_provider"),
                           F.col("ord").alias("source_ord"))
    return df.drop("provider").join(known, "source").withColumnRenamed("_provider", "provider")


def thread_of(ids: DataFrame, messages: DataFrame) -> DataFrame:
    """The thread of each id; an unknown id, or that of a thread, stands for itself."""
    known = messages.select(F.col("id"), F.nullif("thread_id", F.lit("")).alias("_thread"))
    return ids.join(known, "id", "left").withColumn(
        "thread_id", F.coalesce("_thread", "id")).drop("_thread")


def resolve_refs(asked: DataFrame, refs: DataFrame) -> DataFrame:
    """``3`` or ``#3`` as the id it stands for; anything else passes through."""
    number = F.regexp_extract(F.trim("asked"), r"^#?(\d+)$", 1)
    known = refs.select(F.col("ref").alias("_ref"), F.col("id").alias("_id"))
    return asked.withColumn("_n", number.try_cast("bigint")).join(
        known, F.col("_n") == F.col("_ref"), "left").withColumn(
        "id", F.coalesce("_id", "asked")).drop("_n", "_ref", "_id")


def split_known(ids: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids that the cache holds and ids that still have to be fetched."""
    held = cached.select("id").distinct()
    return ids.join(held, "id", "left_semi"), ids.join(held, "id", "left_anti")


def read_through(ids: DataFrame, cached: DataFrame, remote: DataFrame) -> DataFrame:
    """Rows for the ids, from the cache where it has them and else from the provider."""
    known, unknown = split_known(ids, cached)
    served = cached.join(known.select("id"), "id", "left_semi").withColumn("origin", F.lit("cache"))
    fetched = remote.join(unknown.select("id"), "id", "left_semi").withColumn("origin", F.lit("provider"))
    return served.unionByName(fetched, allowMissingColumns=True)


def source_by_prefix(ids: DataFrame, sources: DataFrame) -> DataFrame:
    """The configured source with the longest prefix of each id, else its text up to a colon.

    Every stretch before a colon is a candidate and joined by value. Ids without a colon
    get NULL: they are rejects.
    """
    parts = F.split("id", ":", -1)
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ":"))
    candidates = ids.where(F.instr("id", ":") > 0).select("id", F.explode(prefixes).alias("prefix"))
    best = candidates.join(sources.select("prefix"), "prefix").groupBy("id").agg(
        F.max_by("prefix", F.length("prefix")).alias("_best"))
    first = F.when(F.instr("id", ":") > 0, F.substring_index("id", ":", 1))
    return ids.join(best, "id", "left").withColumn("source", F.coalesce("_best", first)).drop("_best")


def live_meters(meters: DataFrame, sources: DataFrame) -> DataFrame:
    """The last meter snapshot of each source that still is an HTTP source.

    An empty snapshot clears the source.
    """
    last = meters.groupBy("source").agg(F.max_by("meters", "polled_at").alias("meters"))
    http = sources.where(F.lower("provider") == "http").select(F.col("prefix").alias("source"))
    return last.where(F.size("meters") > 0).join(http, "source", "left_semi")


def contact_messages(messages: DataFrame, contacts: DataFrame, source: str) -> DataFrame:
    """Messages from or to each contact, by its identifiers under one source."""
    own = contacts.where(F.col("identifier").startswith(f"{source}:")).select(
        "alias", F.lower(F.substr("identifier", F.lit(len(source) + 2))).alias("address"))
    inside = messages.where(F.col("source") == source)
    people = F.array(F.col("sender"), F.coalesce("to", F.lit("")), F.coalesce("cc", F.lit("")))
    addresses = F.array_distinct(F.flatten(F.transform(people, lambda x: F.transform(
        F.split(x, ","), lambda y: F.lower(F.trim(y))))))
    return inside.withColumn("address", F.explode(addresses)).join(own, "address").dropDuplicates(
        ["id", "alias"]).drop("address")
