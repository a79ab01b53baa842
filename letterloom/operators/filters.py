"""Message filters: listing filters that stack, opt-in skip rules, periods and contacts."""

from __future__ import annotations

import re
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.functions import dates
from letterloom.functions import patterns as P
from letterloom.functions.headers import either, mailbox_identity
from letterloom.operators.lookups import containing



def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def sender_contains(sender: str) -> Column:
    return F.lower(_text("sender")).contains(sender.lower())


def domain_matches(domain: str) -> Column:
    """An address, not just a name, in the domain itself or one below it."""
    wanted = re.escape(domain.lower().lstrip("@"))
    return _text("sender").rlike(rf"(?iu)@[> ]*(?:[^@]*\.)?{wanted}[> ]*$")


def text_contains(query: str) -> Column:
    """Free text in the sender, the subject or the snippet, not in the body."""
    query = query.lower()
    return (F.lower(_text("sender")).contains(query)
            | F.lower(_text("subject")).contains(query)
            | F.lower(_text("snippet")).contains(query))


def since_bound(since: str | None, now: datetime) -> Column:
    bound = dates.resolve_since(since, now)
    return F.lit(True) if bound is None else F.col("date") >= bound


def in_period(period: str) -> Column:
    start, end = dates.period_bounds(period)
    return (F.col("date") >= start) & (F.col("date") < end)


def listing(df: DataFrame, *, now: datetime, sender: str | None = None, domain: str | None = None,
            query: str | None = None, since: str | None = None, period: str | None = None,
            unread_only: bool = False) -> DataFrame:
    """All the listing filters that are given, stacked into one predicate.

    Sources without mail addresses fall out of the sender and domain filters by themselves.
    Bounds on ``date`` come first: they reach the scan.
    """
    df = df.where(~F.lower(_text("provider")).isin(*P.CALENDAR_PROVIDERS, *P.CONTACT_PROVIDERS))
    if since is not None:
        df = df.where(since_bound(since, now))
    if period:
        df = df.where(in_period(period))
    if unread_only:
        df = df.where("unread")
    if sender:
        df = df.where(sender_contains(sender))
    if domain:
        df = df.where(domain_matches(domain))
    if query:
        df = df.where(text_contains(query))
    if sender or domain:
        df = df.where(_text("provider") != "github")
    return df


def subject_contains(query: str) -> Column:
    """The narrower search that notification feeds offer."""
    return F.lower(_text("subject")).contains(query.lower())


# Skip rules

def usable_patterns(spark: SparkSession, patterns: list[str]) -> list[str]:
    """The patterns that compile; the others are left out, as a user may have mistyped them."""
    regex = spark.sparkContext._jvm.java.util.regex.Pattern

    def compiles(pattern):
        try:
            regex.compile(f"(?iUd){pattern}")
            return True
        except (Py4JJavaError, PySparkException):
            return False

    return [p for p in patterns if compiles(p)]


def skip_predicate(patterns: list[str] = (), categories: list[str] = (),
                   groups: bool = False) -> Column:
    """Rows that a category, the group rule or a pattern drops."""
    hit = F.lit(False)
    if categories:
        hit = hit | F.lower(F.trim(_text("category"))).isin([c.lower() for c in categories])
    if groups:
        hit = hit | F.coalesce(F.col("is_group"), F.lit(False)) | _text("chat_jid").endswith(P.GROUP_DOMAIN)
    text = F.concat(_text("subject"), F.lit(" "), _text("body"))
    apart = any("(?" in p or any(f"\\{d}" in p for d in range(1, 10)) for p in patterns)
    for pattern in patterns if apart else [P.any_of(f"(?:{p})" for p in patterns)] if patterns else []:
        hit = hit | text.rlike(f"(?iUd){pattern}")
    return hit


def skip(df: DataFrame, rules: DataFrame, *, groups: bool = False, patterns: list[str] = (),
         categories: list[str] = ()) -> DataFrame:
    """Drop every row that any rule hits.

    Sender and domain rules are a table of any size, applied as anti joins; a domain rule
    does not reach sub-domains. The few category and pattern rules are parameters.
    """
    value = F.lower("value").alias("_rule")
    senders = rules.where(F.col("rule_type") == "sender").select(value).distinct()
    domains = rules.where(F.col("rule_type") == "domain").select(value).distinct()
    sender = F.lower(F.trim(_text("sender")))
    exact_domain = F.when(sender.contains("@"), F.substring_index(sender, "@", -1))
    return (
        df.where(~skip_predicate(list(patterns), list(categories), groups))
        .join(senders, F.nullif(sender, F.lit("")) == F.col("_rule"), "left_anti")
        .join(domains, exact_domain == F.col("_rule"), "left_anti"))


def add_rules(rules: DataFrame, new: DataFrame) -> DataFrame:
    """Rules with more rules; all but patterns are kept in lower case, none twice."""
    value = F.when(F.col("rule_type") == "pattern", F.col("value")).otherwise(F.lower("value"))
    return rules.unionByName(new).select("rule_type", value.alias("value")).distinct()


def remove_rules(rules: DataFrame, gone: DataFrame) -> DataFrame:
    """Rules without those that are gone; a rule may be named as gone many times, and is looked up once."""
    value = F.when(F.col("rule_type") == "pattern", F.col("value")).otherwise(F.lower("value"))
    return rules.join(gone.select("rule_type", value.alias("value")).distinct(), ["rule_type", "value"], "left_anti")


def own_text(body: Column) -> Column:
    """A body up to the mark of a forwarded message."""
    return F.trim(F.regexp_replace(body, P.FORWARD_MARK, ""))


def noise_flags(df: DataFrame, *, automated: list[str] = (), labels: list[str] = (),
                allowed: DataFrame | None = None) -> DataFrame:
    """Mark each row with the first noise layer that catches it, or NULL.

    Layers: a label, an automated sender by ``LIKE`` pattern, an unknown contact, nothing but
    attachments, nothing but a forwarded message, a body of under 20 characters.
    """
    layer = F.when(F.arrays_overlap(F.coalesce("labels", F.array().cast("array<string>")),
                                    F.array(*[F.lit(x) for x in labels]).cast("array<string>")), "label")
    for pattern in automated:
        layer = layer.when(F.lower(_text("sender")).like(pattern.lower()), "automated")
    if allowed is not None:
        known = allowed.select(F.lower("identifier").alias("_known")).distinct()
        df = df.join(known, F.lower(_text("sender")) == F.col("_known"), "left")
        layer = layer.when(F.col("_known").isNull(), "unknown")
    body = F.trim(either("body", "snippet"))
    if "attachments" in df.columns:
        layer = layer.when((body == "") & (F.size("attachments") > 0), "attachments")
    layer = layer.when(body.rlike(P.FORWARD_MARK) & (own_text(body) == ""), "forwarded")
    return df.withColumn("noise", layer.when(F.length(body) < 20, "trivial")).drop("_known")


def noise_report(flagged: DataFrame) -> DataFrame:
    """How many rows each layer caught, and how many are left of all: (layer, messages)."""
    layers = flagged.groupBy(F.coalesce("noise", F.lit("processed")).alias("layer")).agg(F.count("*").alias("messages"))
    return layers.unionByName(flagged.agg(F.count("*").alias("messages")).select(F.lit("total").alias("layer"), "messages"))


# Sources, mailboxes and contacts

def select_sources(sources: DataFrame, wanted: str | None) -> DataFrame:
    """Sources by ``all``, prefix, prefix in lower case, provider or provider alias."""
    raw = (wanted or "all").strip()
    if raw.lower() == "all":
        return sources
    provider = P.PROVIDER_ALIASES.get(raw.lower(), raw.lower())
    rank = (
        F.when(F.col("prefix") == raw, 1)
        .when(F.col("prefix") == raw.lower(), 2)
        .when(F.lower("provider") == provider, 3))
    ranked = sources.withColumn("_rank", rank).where("_rank IS NOT NULL")
    best = ranked.agg(F.min("_rank").alias("_best"))
    return ranked.join(best, F.col("_rank") == F.col("_best"), "left_semi").drop("_rank")


def expected_mailboxes(sources: DataFrame) -> DataFrame:
    return sources.where(F.lower("provider").isin(*P.CACHED_PROVIDERS)).select(
        F.col("prefix").alias("_prefix"),
        mailbox_identity(*[F.col(c) for c in (
            "provider", "email", "mailbox", "client_id", "tenant_id")]).alias("_expected"))


def current_rows(cached: DataFrame, sources: DataFrame) -> DataFrame:
    """Cached rows of the current schema whose source still points at the same mailbox."""
    expected = expected_mailboxes(sources)
    return (
        cached.where(F.col("_schema_version") >= P.SCHEMA_VERSION)
        .join(expected, F.col("source") == F.col("_prefix"), "left")
        .where("_expected IS NULL OR _expected = coalesce(mailbox, '')")
        .drop("_prefix", "_expected"))


def from_contact(df: DataFrame, contacts: DataFrame, contact: str) -> DataFrame:
    """Messages of one contact: by alias, else by the first alias that the text is part of.

    A message matches where its sender contains one of the identifiers, with or without
    their source prefix. An unknown contact is looked for in the sender itself.
    """
    term = contact.lower().strip()
    alias = contacts.agg(F.coalesce(
        F.min(F.when(F.col("alias") == term, F.col("alias"))),
        F.min(F.when(F.col("alias").contains(term) | F.lower("identifier").contains(term), F.col("alias"))))).scalar()
    own = contacts.where(F.col("alias") == alias).select(F.lower("identifier").alias("needle"))
    bare = own.where(F.instr("needle", ":") > 0).select(
        F.expr("substring(needle, instr(needle, ':') + 1)").alias("needle"))
    unknown = df.sparkSession.range(1).where(alias.isNull()).select(F.lit(contact.lower()).alias("needle"))
    senders = df.select(F.lower(_text("sender")).alias("_sender")).distinct()
    hits = containing(senders, "_sender", own.union(bare).union(unknown), "needle").select("_sender").distinct()
    return df.join(hits, F.lower(_text("sender")) == F.col("_sender"), "left_semi")
