"""The newest-first feed, with an offset per consumer and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.operators.ordering import number_in_groups, number_rows, top_in_groups


def newest_first() -> list[Column]:
    """Newest first, undated last; ties keep the order of sources and of arrival."""
    return [F.desc(F.coalesce("date", F.lit(""))), F.col("source_ord"), F.col("seq")]


def page(messages: DataFrame, count: int) -> DataFrame:
    """The newest ``count`` messages: every task keeps only its own best ``count``."""
    return messages.orderBy(*newest_first()).limit(count)


def listed(messages: DataFrame, count: int) -> DataFrame:
    """A page with the place of each row; the page bounds what is numbered."""
    return top_in_groups(
        page(messages, count).withColumn("_all", F.lit(0)), ["_all"], newest_first(), count, "place").drop("_all")


def followed(keys: DataFrame, offsets: DataFrame, sources: DataFrame, default_since: str) -> DataFrame:
    """(key, source, source_ord, since): from where each consumer key reads each source.

    A source the key has not seen yet starts at ``default_since``.
    """
    # The source list is configuration: one short array, which Spark fetches as it runs.
    listed = sources.agg(F.collect_list(F.struct(F.col("prefix").alias("source"), F.col("ord").alias("source_ord")))).scalar()
    return keys.select("key", F.inline(listed)).join(offsets.select("key", "source", "ts"), ["key", "source"], "left").select(
        "key", "source", "source_ord", F.coalesce("ts", F.lit(default_since)).alias("since"))


def feed_pages(messages: DataFrame, follows: DataFrame, count: int) -> DataFrame:
    """The newest ``count`` messages of every key, at or after its offsets.

    The bound is inclusive, so the row on it is delivered again. It only cuts off old rows,
    so no page needs more than the newest ``count`` rows of a source, and only those meet
    the consumers.
    """
    heads = top_in_groups(messages.where("date IS NOT NULL"), ["source"], [F.desc("date"), F.col("seq")], count, "_nth").drop("_nth")
    rows = heads.join(follows, "source").where(F.col("date") >= F.col("since")).drop("since")
    return top_in_groups(rows, ["key"], newest_first(), count, "place")


def available(messages: DataFrame, follows: DataFrame) -> DataFrame:
    """(source, since, available): messages at or after each offset that any consumer has.

    Messages and offsets are sorted together once: an offset's place, less the offsets before
    it, is the number of messages it leaves. Consumers of equal offset share a row.
    """
    bounds = follows.select("source", F.col("since").alias("date")).distinct()
    low = bounds.groupBy("source").agg(F.min("date").alias("_low"))
    recent = messages.select("source", "date").join(low, "source").where("date >= _low")
    both = recent.select("source", "date", F.lit(0).alias("_mark")).unionAll(bounds.select("source", "date", F.lit(1)))
    at = number_in_groups(both, ["source"], [F.desc("date"), "_mark"], "_at").where("_mark = 1")
    before = number_in_groups(bounds, ["source"], [F.desc("date")], "_nth")
    return at.join(before, ["source", "date"]).select(
        "source", F.col("date").alias("since"), (F.col("_at") - F.col("_nth")).cast("bigint").alias("available"))


def truncation(messages: DataFrame, follows: DataFrame, pages: DataFrame) -> DataFrame:
    """Per key and source: rows available, rows on the page, and the dates on the page."""
    there = follows.join(available(messages, follows), ["source", "since"]).where("available > 0").select("key", "source", "available")
    shown = pages.groupBy("key", "source").agg(
        F.count("*").alias("returned"), F.min("date").alias("oldest"), F.max("date").alias("newest"))
    return there.join(shown, ["key", "source"], "left").select(
        "key", "source", "available", F.coalesce("returned", F.lit(0)).alias("returned"),
        (F.col("available") - F.coalesce("returned", F.lit(0))).alias("dropped"), "oldest", "newest")


def page_report(report: DataFrame) -> DataFrame:
    """Per key: whether more is available, how much, and where to go on."""
    return report.groupBy("key").agg(
        F.sum("returned").alias("returned"), F.sum("dropped").alias("remaining"),
        (F.sum("dropped") > 0).alias("has_more"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("dropped") > 0, F.col("source")))), ",").alias("truncated_sources"),
        F.when(F.sum("dropped") > 0, F.substring(F.min("oldest"), 1, 10)).alias("continue_since"))


def advanced(report: DataFrame, policy: str = "compatible") -> DataFrame:
    """New offsets of the sources that returned something.

    A fully returned source moves to its newest date. A truncated one moves to the oldest
    date returned, or stays put under ``policy='lossless'``, which never skips a row.
    """
    moved = report.where("returned > 0")
    if policy == "lossless":
        moved = moved.where("dropped = 0")
    return moved.select("key", "source", F.when(F.col("dropped") > 0, F.col("oldest")).otherwise(F.col("newest")).alias("ts"))


def merge_offsets(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old offsets with new ones in their place."""
    return old.withColumnRenamed("ts", "_old").join(
        new.withColumnRenamed("ts", "_new"), ["key", "source"], "full_outer").select(
        "key", "source", F.coalesce("_new", "_old").alias("ts"))


def clear_offsets(offsets: DataFrame, key: str) -> DataFrame:
    return offsets.where(F.col("key") != key)


def assign_refs(listing: DataFrame, refs: DataFrame, order: list[str], newest_first: bool = False, start: int | None = None) -> DataFrame:
    """Known ids keep their number, new ids get the next ones in listing order.

    ``start`` is the last number given so far; without it, it is looked up in ``refs``.

    Returns only the new rows. The listing may be a whole corpus: it is range-sorted, and
    the numbers of a partition follow from the sizes of those before it.
    """
    first = listing.where("id <> ''").select("id", *order).dropDuplicates(["id"])
    fresh = first.join(refs.select("id"), "id", "left_anti")
    if start is None:
        start = refs.agg(F.coalesce(F.max("ref"), F.lit(0))).first()[0]
    way = [F.desc(c) if newest_first else F.asc(c) for c in order]
    return number_rows(fresh, [*way, F.asc("id")], "ref").select("id", (F.col("ref") + start).cast("bigint").alias("ref"))


def continuation(messages: DataFrame, counts: int) -> DataFrame:
    """Where the page after this one starts."""
    return page(messages, counts).agg(F.substring(F.min("date"), 1, 10).alias("since"))

