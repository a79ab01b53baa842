"""Usage counters and the savings they show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rollup(log: DataFrame) -> DataFrame:
    """Grand total, per source and per command in one pass; ``calls`` counts log rows."""
    return log.groupingSets([[F.col("source")], [F.col("command")], []], "source", "command").agg(
        F.grouping_id().alias("_gid"),
        F.count("*").alias("calls"),
        F.coalesce(F.sum("bytes_in"), F.lit(0)).alias("bytes_in"),
        F.coalesce(F.sum("bytes_out"), F.lit(0)).alias("bytes_out"),
        F.coalesce(F.sum("messages"), F.lit(0)).alias("messages"),
    ).select(
        F.element_at(F.create_map(F.lit(1), F.lit("source"), F.lit(2), F.lit("command"), F.lit(3), F.lit("total")),
                     F.col("_gid").cast("int")).alias("level"),
        F.coalesce("source", "command", F.lit("")).alias("name"),
        "calls", "bytes_in", "bytes_out", "messages")


def savings(bytes_in: Column, bytes_out: Column) -> Column:
    """Saved bytes in percent, to one decimal; 0 without input."""
    return F.when(bytes_in == 0, F.lit(0.0)).otherwise(
        F.bround((F.lit(1.0) - bytes_out / bytes_in) * 100, 1))


def json_bytes(df: DataFrame) -> Column:
    """The size of a row as JSON."""
    return F.octet_length(F.to_json(F.struct(*df.columns)))


def attribute(messages: DataFrame, line_bytes: Column, command: str) -> DataFrame:
    """Log rows of one call: input bytes per source, output bytes by its share of messages.

    ``line_bytes`` is what each message adds to the output of the call.
    """
    per_source = messages.select("source", json_bytes(messages).alias("_in"), line_bytes.alias("_out")).groupBy(
        "source").agg(F.sum("_in").alias("bytes_in"), F.sum("_out").alias("_out"), F.count("*").alias("messages"))
    # One row per source is left, so the totals over all of them are cheap.
    every = Window.partitionBy(F.lit(0))
    share = F.col("messages") / F.sum("messages").over(every)
    return per_source.select(
        F.lit(command).alias("command"), F.coalesce(F.nullif("source", F.lit("")), F.lit("?")).alias("source"),
        "bytes_in", F.bround(F.sum("_out").over(every) * share).cast("bigint").alias("bytes_out"), "messages")


def offset_summary(offsets: DataFrame) -> DataFrame:
    """Per consumer key: how many sources it follows and its latest offset."""
    return offsets.groupBy("key").agg(F.count("*").alias("sources"), F.max("ts").alias("latest"))


def status(contacts: DataFrame, rules: DataFrame, log: DataFrame, cached: DataFrame) -> DataFrame:
    """The few numbers of a status page as ``(section, name, value)``."""
    people = contacts.agg(F.count_distinct("alias").alias("a"), F.count("*").alias("i"))
    parts = [
        people.select(F.lit("contacts").alias("section"), F.explode(F.create_map(
            F.lit("aliases"), F.col("a"), F.lit("identifiers"), F.col("i"))).alias("name", "value")),
        rules.agg(F.count("*").alias("value")).select(
            F.lit("filters").alias("section"), F.lit("rules").alias("name"), "value"),
        rollup(log).select(F.lit("usage").alias("section"), F.concat_ws(":", "level", "name").alias("name"),
                           F.col("bytes_in").alias("value")),
        cached.groupBy("source").agg(F.count("*").alias("value")).select(
            F.lit("cache").alias("section"), F.col("source").alias("name"), "value"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def reduction(df: DataFrame, before: str, after: str, *by: str) -> DataFrame:
    """Bytes before and after clean-up and the share that went."""
    return df.groupBy(*by).agg(
        F.sum(F.octet_length(before)).alias("bytes_in"), F.sum(F.octet_length(after)).alias("bytes_out"),
        F.count("*").alias("documents"),
    ).withColumn("saved_pct", savings(F.col("bytes_in"), F.col("bytes_out")))
