"""The contact map, and the plan to import an address book into it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.functions.headers import collapse_spaces, phone_to_chat
from letterloom.operators.components import components
from letterloom.session import materialise

NO_COUNTRY = "phone number without a country code (+ or 00)"


def tidy_alias(alias: Column) -> Column:
    return F.trim(F.lower(alias))


def link(contacts: DataFrame, new: DataFrame) -> DataFrame:
    """Add identifiers to aliases; what is there keeps its place, new ones follow in order."""
    new = new.withColumn("alias", tidy_alias(F.col("alias")))
    ends = contacts.groupBy("alias").agg(F.max("ord").alias("_end"))
    fresh = new.groupBy("alias", "identifier").agg(F.min("ord").alias("ord")).join(
        contacts.select("alias", "identifier"), ["alias", "identifier"], "left_anti")
    moved = fresh.join(ends, "alias", "left").select(
        "alias", "identifier", (F.col("ord") + F.coalesce("_end", F.lit(0))).alias("ord"))
    return contacts.select("alias", "identifier", "ord").unionByName(moved)


def unlink(contacts: DataFrame, gone: DataFrame) -> DataFrame:
    """Remove identifiers; a NULL identifier removes the whole alias."""
    gone = gone.select(tidy_alias(F.col("alias")).alias("alias"), "identifier")
    return contacts.join(gone.where("identifier IS NULL").select("alias"), "alias", "left_anti").join(
        gone.where("identifier IS NOT NULL"), ["alias", "identifier"], "left_anti")


def find(contacts: DataFrame, text: str) -> DataFrame:
    """All identifiers of the aliases whose name or identifiers contain the text."""
    text = text.lower().strip()
    hits = contacts.where(F.col("alias").contains(text) | F.lower("identifier").contains(text)).select("alias").distinct()
    return contacts.join(hits, "alias", "left_semi")


def card_identifiers(cards: DataFrame, mail_prefixes: list[str], chat_prefixes: list[str]) -> DataFrame:
    """Identifiers of each card: emails under every mail source, phones under every chat source."""
    def under(prefixes, value):
        return F.array(*[F.concat(F.lit(f"{p}:"), value) for p in prefixes])

    mail = F.flatten(F.transform("emails", lambda x: under(mail_prefixes or ["g"], x)))
    chats = F.filter(F.transform("phones", phone_to_chat), lambda x: x.isNotNull())
    chat = F.flatten(F.transform(chats, lambda x: under(chat_prefixes or ["w"], x)))
    bad = F.size(F.filter(F.transform("phones", phone_to_chat), lambda x: x.isNull()))
    return cards.select(
        "seq", F.lower(collapse_spaces(F.coalesce("display_name", F.lit("")))).alias("alias"),
        F.array_distinct(F.concat(mail, chat)).alias("identifiers"), bad.alias("bad_phones"))


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The accepted cards of groups sorted by card; a claim is let go after the last card that holds it."""
    group, taken = None, set()
    for batch in batches:
        accepted = []
        for row in batch.to_pylist():
            if row["component"] != group:
                group, taken = row["component"], set()
            claims = [c["claim"] for c in row["claims"]]
            if taken.isdisjoint(claims):
                accepted.append(row["seq"])
                taken.update(claims)
            taken.difference_update(c["claim"] for c in row["claims"] if c["last"] == row["seq"])
        yield pa.RecordBatch.from_arrays([pa.array(accepted, pa.int64())], names=["seq"])


def _round(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The claims of cards that come first on all of theirs, and of those that nothing decides yet."""
    first = claims.groupBy("claim").agg(F.min("seq").alias("_first"))
    waiting = claims.join(first, "claim").where("seq > _first").select("seq").distinct()
    won = materialise(claims.join(waiting, "seq", "left_anti"))
    rest = claims.join(waiting, "seq", "left_semi")
    lost = rest.join(won.select("claim"), "claim", "left_semi").select("seq").distinct()
    return won, materialise(rest.join(lost, "seq", "left_anti"))


def first_come(claims: DataFrame) -> DataFrame:
    """The rows of ``claims`` (seq, claim) whose card is accepted.

    Cards come in the order of ``seq``; one is accepted if no accepted card before it holds
    any of its claims. Two rounds take all cards at once; they settle what many cards want,
    as one aggregate by claim, and leave chains in which one decision hangs on another. The
    groups that hang together are found in rounds by the logarithm of the longest chain, and
    each is settled card by card.
    """
    won, rest = _round(materialise(claims.distinct()))
    more, rest = _round(rest)
    if rest.isEmpty():
        return won.unionAll(more)
    last = rest.groupBy("claim").agg(F.max("seq").alias("last"))
    cards = rest.join(last, "claim").groupBy("seq").agg(F.collect_list(F.struct("claim", "last")).alias("claims")).join(
        components(rest, "seq", "claim"), "seq")
    settled = cards.repartition("component").sortWithinPartitions("component", "seq").mapInArrow(_settled, "seq bigint")
    return won.unionAll(more).unionAll(rest.join(settled, "seq", "left_semi").select("seq", "claim"))


def import_plan(cards: DataFrame, contacts: DataFrame, mail_prefixes: list[str], chat_prefixes: list[str]) -> DataFrame:
    """The outcome of every card: ``link``, ``conflict`` or ``skip``, with the reason.

    Cards claim their alias and identifiers in order, and only accepted cards claim; see
    ``first_come``.
    """
    cards = card_identifiers(cards, mail_prefixes, chat_prefixes)
    owner = contacts.groupBy("identifier").agg(F.max("alias").alias("owner"))
    aliases = contacts.select("alias").distinct()
    known = contacts.select("alias", "identifier").distinct()

    named = cards.where("alias <> '' AND size(identifiers) > 0")
    idents = named.select("seq", "alias", F.posexplode("identifiers").alias("ord", "identifier"))
    existing = named.join(aliases, "alias", "left_semi")
    extra = idents.join(aliases, "alias", "left_semi").join(known, ["alias", "identifier"], "left_anti").select("seq").distinct()
    taken_now = idents.join(owner, "identifier").join(aliases, "alias", "left_anti").groupBy("seq").agg(
        F.min_by(F.struct("identifier", "owner"), "ord").alias("hit"))
    candidates = named.join(existing.select("seq"), "seq", "left_anti").join(taken_now.select("seq"), "seq", "left_anti")
    claims = candidates.select("seq", F.concat(F.lit("a:"), "alias").alias("claim")).unionByName(
        candidates.select("seq", F.explode(F.transform("identifiers", lambda x: F.concat(F.lit("i:"), x))).alias("claim")))
    accepted = materialise(first_come(claims))

    claimed = accepted.withColumnRenamed("seq", "_by")
    owners = claimed.where(F.col("claim").startswith("i:")).select(
        F.substr("claim", F.lit(3)).alias("identifier"), "_by").join(
        cards.select(F.col("seq").alias("_by"), F.col("alias").alias("owner")), "_by")
    early = owner.select("identifier", F.lit(-1).cast("bigint").alias("_by"), "owner").unionByName(
        owners.select("identifier", "_by", "owner"))
    # What stands against a refused card: stored identifiers, and names and identifiers
    # that an accepted card claimed before it.
    open_cards = idents.join(aliases, "alias", "left_anti").join(accepted.select("seq").distinct(), "seq", "left_anti")
    hits = open_cards.join(early, "identifier").where("_by < seq").groupBy("seq").agg(
        F.min_by(F.struct("identifier", "owner"), F.struct("ord", -F.col("_by"))).alias("hit"))
    proposed = claimed.where(F.col("claim").startswith("a:")).select(
        F.substr("claim", F.lit(3)).alias("alias"), "_by")
    duplicates = open_cards.select("seq", "alias").distinct().join(proposed, "alias").where("_by < seq").select("seq").distinct()

    reason = (
        F.when(F.col("alias") == "", F.lit("no name"))
        .when(F.size("identifiers") == 0, F.lit("no phone or email"))
        .when(F.col("_existing") & F.col("_extra").isNull(), F.lit("already up to date"))
        .when(F.col("_existing"), F.lit("alias already exists"))
        .when(F.col("_dup"), F.lit("duplicate in import"))
        .when(F.col("hit").isNotNull(), F.concat(
            F.col("hit.identifier"), F.lit(" already linked to '"), F.col("hit.owner"), F.lit("'"))))
    outcome = (
        F.when(F.col("reason").isNull(), F.lit("link"))
        .when(F.col("reason").isin("no name", "no phone or email", "already up to date"), F.lit("skip"))
        .otherwise(F.lit("conflict")))
    return (
        cards.join(existing.select("seq", F.lit(True).alias("_existing")), "seq", "left")
        .join(extra.withColumn("_extra", F.lit(True)), "seq", "left")
        .join(duplicates.withColumn("_dup", F.lit(True)), "seq", "left")
        .join(hits, "seq", "left")
        .withColumn("reason", reason).withColumn("outcome", outcome)
        .select("seq", "alias", "identifiers", "bad_phones", "outcome", "reason"))


def planned_links(plan: DataFrame) -> DataFrame:
    """The edges that an applied plan adds to the contact map."""
    return plan.where("outcome = 'link'").select(
        "alias", F.posexplode("identifiers").alias("ord", "identifier")).select(
        "alias", "identifier", (F.col("ord") + 1).alias("ord"))


def skipped(plan: DataFrame) -> DataFrame:
    """Skips by reason. A phone without a country code counts once per phone.

    A card without a name is skipped before its phones are looked at.
    """
    cards = plan.where("outcome = 'skip'").groupBy("reason").agg(F.count("*").alias("count"))
    phones = plan.where("alias <> ''").agg(F.sum("bad_phones").alias("count")).where("count > 0").select(
        F.lit(NO_COUNTRY).alias("reason"), "count")
    return cards.unionByName(phones)


def plan_report(plan: DataFrame, applied: bool = False) -> DataFrame:
    """The plan as numbered lines per section, ready to be sorted and written as text."""
    head = "LINKED" if applied else "LINKS"
    # Every section reads the plan twice; it is made once.
    plan = materialise(plan)
    # A section opens with its own line, so it shows only where it has content.
    links = plan.where("outcome = 'link'").select(
        F.lit(1).alias("section"), F.col("seq").alias("line_no"),
        F.concat_ws("|", F.array("alias"), "identifiers").alias("line"))
    conflicts = plan.where("outcome = 'conflict'").select(
        F.lit(2).alias("section"), F.col("seq").alias("line_no"), F.concat_ws("|", "alias", "reason").alias("line"))
    skips = skipped(plan).select(
        F.lit(3).alias("section"), F.lit(0).cast("bigint").alias("line_no"),
        F.concat(F.col("count").cast("string"), F.lit("|"), "reason").alias("line"))
    titles = {
        1: lambda n: F.concat(F.lit(f"{head} ("), n, F.lit("):")),
        2: lambda n: F.concat(F.lit("CONFLICTS ("), n, F.lit(" — stored values left unchanged):")),
        3: lambda n: F.lit("SKIPPED:"),
    }
    out = None
    for number, part in enumerate((links, conflicts, skips), 1):
        title = part.groupBy("section").agg(F.count("*").alias("_n")).select(
            "section", F.lit(-1).cast("bigint").alias("line_no"), titles[number](F.col("_n").cast("string")).alias("line"))
        part = title.unionByName(part)
        out = part if out is None else out.unionByName(part)
    return out
