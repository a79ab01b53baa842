"""Drill-down overviews of the cached corpus.

Messages are counted per source and sender before any alias is looked up, so a hot sender
costs one row; the top lists keep only their ``k`` rows per group before they shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.functions import dates
from letterloom.functions import patterns as P
from letterloom.functions.headers import lit_map
from letterloom.operators import filters
from letterloom.operators.lookups import live_meters, named
from letterloom.operators.ordering import top_in_groups


def source_label(source: Column) -> Column:
    return F.coalesce(F.try_element_at(lit_map(P.SOURCE_LABELS), source), source)


def _months() -> list[Column]:
    when = F.nullif(F.coalesce("date", F.lit("")), F.lit(""))
    return [F.coalesce(dates.month_of(F.min(when)), F.lit("")).alias("date_start"),
            F.coalesce(dates.month_of(F.max(when)), F.lit("")).alias("date_end")]


def source_totals(messages: DataFrame) -> DataFrame:
    return messages.groupBy("source").agg(F.count("*").alias("count"), *_months()).select(
        "source", source_label(F.col("source")).alias("label"), "count", "date_start", "date_end")


def with_meters(totals: DataFrame, meters: DataFrame, sources: DataFrame) -> DataFrame:
    """Totals with live meters, plus the sources that have meters but no messages."""
    live = live_meters(meters, sources)
    return totals.join(live, "source", "full_outer").select(
        "source", F.coalesce("label", source_label(F.col("source"))).alias("label"),
        F.coalesce("count", F.lit(0)).alias("count"),
        F.coalesce("date_start", F.lit("")).alias("date_start"),
        F.coalesce("date_end", F.lit("")).alias("date_end"), "meters")


def sender_counts(messages: DataFrame, contacts: DataFrame, sources: DataFrame) -> DataFrame:
    """Messages per source and resolved sender."""
    counts = messages.groupBy(
        F.coalesce("source", F.lit("")).alias("source"), F.coalesce("sender", F.lit("")).alias("sender")
    ).agg(F.count("*").alias("n"))
    return named(counts, contacts, sources).groupBy("source", "name").agg(F.sum("n").alias("count"))


def top_senders(messages: DataFrame, contacts: DataFrame, sources: DataFrame, k: int) -> DataFrame:
    """The ``k`` busiest senders per source; ties by name."""
    return top_in_groups(
        sender_counts(messages, contacts, sources), ["source"], [F.desc("count"), "name"], k)


def top_view_senders(messages: DataFrame, contacts: DataFrame, sources: DataFrame, top: int = 10) -> DataFrame:
    """Top senders as the top view lists them: never more than five per source."""
    return top_senders(messages, contacts, sources, min(top, 5))


def top_threads(messages: DataFrame, k: int) -> DataFrame:
    """The ``k`` longest threads per source, of sources with at least three threads."""
    threads = messages.where("thread_id <> ''").groupBy("source", "thread_id").agg(
        F.count("*").alias("count"), F.coalesce(F.min_by("subject", "seq"), F.lit("")).alias("subject"))
    enough = threads.groupBy("source").agg(F.count("*").alias("_n")).where("_n >= 3").select("source")
    return top_in_groups(threads, ["source"], [F.desc("count"), "thread_id"], k).join(enough, "source", "left_semi")


def quarters(messages: DataFrame, *by: str) -> DataFrame:
    """Messages per quarter; dates without a readable month are skipped."""
    return messages.withColumn("period", dates.quarter_label(F.col("date"))).where(
        "period IS NOT NULL").groupBy(*by, "period").agg(F.count("*").alias("count"))


def contact_activity(messages: DataFrame, contacts: DataFrame, sources: DataFrame) -> DataFrame:
    """Quarterly messages of every contact by source.

    The period is part of the first count, so only counts meet the alias lookup.
    """
    counts = messages.withColumn("period", dates.quarter_label(F.col("date"))).where("period IS NOT NULL").groupBy(
        F.coalesce("source", F.lit("")).alias("source"), F.coalesce("sender", F.lit("")).alias("sender"), "period",
    ).agg(F.count("*").alias("n"))
    return named(counts, contacts, sources).where("name <> sender").groupBy(
        "name", "source", "period").agg(F.sum("n").alias("count"))


def overview(cached: DataFrame, contacts: DataFrame, sources: DataFrame, meters: DataFrame | None = None, *,
             source: str | None = None, contact: str | None = None, period: str | None = None,
             top: int = 10) -> dict[str, DataFrame]:
    """The tables of one overview: over everything, over one source, or over one contact."""
    rows = filters.current_rows(cached, sources)
    if source:
        rows = rows.where(F.col("source") == source)
    if period:
        rows = rows.where(filters.in_period(period))
    if contact:
        rows = filters.from_contact(rows, contacts, contact)
        return {"sources": source_totals(rows), "periods": quarters(rows)}
    totals = source_totals(rows)
    if source:
        return {"sources": totals, "senders": top_senders(rows, contacts, sources, top),
                "threads": top_threads(rows, top)}
    if meters is not None:
        totals = with_meters(totals, meters, sources)
    return {"sources": totals, "senders": top_view_senders(rows, contacts, sources, top)}


def cache_stats(cached: DataFrame, bodies: DataFrame) -> DataFrame:
    """Current and stale entries, bodies, bytes, and the span of dates."""
    current = F.col("_schema_version") >= P.SCHEMA_VERSION
    when = F.when(current, F.nullif(F.col("date"), F.lit("")))
    heads = cached.agg(
        F.count_if(current).alias("total"), F.count_if(~F.coalesce(current, F.lit(False))).alias("stale"),
        F.min(when).alias("oldest"), F.max(when).alias("newest"))
    texts = bodies.agg(
        F.count("*").alias("bodies"), F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("bodies_bytes"))
    both = heads.unionByName(texts, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def cached_by_source(cached: DataFrame) -> DataFrame:
    return cached.where(F.col("_schema_version") >= P.SCHEMA_VERSION).groupBy("source").agg(F.count("*").alias("count"))


def source_activity(cached: DataFrame, sources: DataFrame, cutoff: str) -> DataFrame:
    """How alive each source looks; ``cutoff`` is thirty days before now."""
    seen = filters.current_rows(cached, sources).groupBy("source").agg(
        F.count("*").alias("_count"), F.max(F.nullif(F.col("date"), F.lit(""))).alias("newest"))
    cacheable = F.lower("provider").isin(*P.CACHED_PROVIDERS)
    tag = (
        F.when(~cacheable, F.lit("n/a"))
        .when(F.col("_count").isNull(), F.lit("empty"))
        .when(F.col("newest") >= cutoff, F.lit("active"))
        .otherwise(F.lit("low")))
    return sources.select(F.col("prefix").alias("source"), "provider").join(seen, "source", "left").select(
        "source", "provider",
        F.when(cacheable, F.coalesce("_count", F.lit(0))).otherwise(F.lit(0)).alias("count"),
        F.when(cacheable, F.col("newest")).alias("newest"), tag.alias("tag"))
