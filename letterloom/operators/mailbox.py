"""Mailbox state: label counts, and a log of actions applied to the labels of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.functions import patterns as P
from letterloom.functions.headers import lit_map
from letterloom.operators.ordering import top_in_groups

# Per action the labels it adds and removes; ``*`` stands for the label or folder it names.
EFFECTS = {
    "archive": ((), ("INBOX",)),
    "unarchive": (("INBOX",), ()),
    "read": ((), ("UNREAD",)),
    "unread": (("UNREAD",), ()),
    "label": (("*",), ()),
    "unlabel": ((), ("*",)),
    "trash": (("TRASH",), ("INBOX",)),
    "move": (("*",), ("INBOX",)),
}


def label_stats(messages: DataFrame) -> DataFrame:
    """Total and unread messages of the counted labels, per source."""
    names = lit_map(dict(P.COUNTED_LABELS))
    ranks = F.create_map(*[F.lit(x) for i, (k, _) in enumerate(P.COUNTED_LABELS) for x in (k, i)])
    wanted = F.filter("labels", lambda x: x.isin(*[k for k, _ in P.COUNTED_LABELS]))
    return messages.select(
        "source", F.coalesce("unread", F.lit(False)).alias("unread"), F.explode(F.array_distinct(wanted)).alias("label"),
    ).groupBy("source", "label").agg(F.count("*").alias("total"), F.count_if("unread").alias("unread")).select(
        "source", F.element_at(names, F.col("label")).alias("name"),
        F.element_at(ranks, F.col("label")).alias("ord"), "total", "unread")


def level_rank(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in P.LEVELS]), F.coalesce(F.lower(level), F.lit("readonly")))


def gate(actions: DataFrame, sources: DataFrame, required: str = "modify") -> DataFrame:
    """Each action with the reason why it may not run, or NULL.

    The level to send is closed to message sources whatever they are configured as.
    """
    known = sources.select(
        F.col("prefix").alias("source"), F.col("provider").alias("_provider"), F.lower("level").alias("_level"),
        F.lit(True).alias("_known"))
    need = F.lit(P.LEVELS.index(required) + 1)
    named = F.col("action").isin("label", "unlabel", "move")
    reason = (
        F.when(F.col("_known").isNull(), F.lit("unknown source"))
        .when(~F.col("action").isin(*EFFECTS), F.concat(F.lit("unknown action "), F.col("action")))
        .when(named & (F.coalesce("label", F.lit("")) == ""), F.lit("label required")))
    if required == "send":
        reason = reason.when(~F.col("_provider").isin(*P.CALENDAR_PROVIDERS), F.lit("sending is closed to message sources"))
    reason = reason.when(
        level_rank(F.col("_level")) < need,
        F.concat(F.lit(f"needs level {required}, source has "), F.coalesce("_level", F.lit("readonly"))))
    return actions.join(known, "source", "left").withColumn("reason", reason).drop("_provider", "_level", "_known")


def _effects(actions: DataFrame) -> DataFrame:
    """The last word per target and label: ``(scope, target, label, code)``, an odd code adds.

    The log is cut to one row per target and label with map-side partials over numbers, so a
    thread that a third of all actions ask for ends up as its labels.
    """
    def changes(side: int, add: bool) -> Column:
        labels = F.array().cast("array<string>")
        for action, both in EFFECTS.items():
            named = [F.col("label") if x == "*" else F.lit(x) for x in both[side]]
            if named:
                labels = F.when(F.col("action") == action, F.array(*named)).otherwise(labels)
        return F.transform(labels, lambda x: F.struct(x.alias("label"), F.lit(int(add)).alias("add")))

    every = actions.select("scope", "target", "seq", F.inline(F.concat(changes(0, True), changes(1, False))))
    return every.groupBy("scope", "target", "label").agg(F.max(F.col("seq") * 2 + F.col("add")).alias("code"))


def apply_actions(messages: DataFrame, actions: DataFrame) -> DataFrame:
    """Labels after the log; the last action on a message and label decides.

    An action on a thread reaches every message of it. Actions on a message and on its thread
    are merged by message and label, as rows, and a message then meets its own changes only:
    stored labels keep their order, new ones follow by name.
    """
    effects = _effects(actions)
    own = effects.where("scope = 'message'").select(F.col("target").alias("_id"), "label", "code")
    whole = messages.select("id", F.col("thread_id").alias("target")).join(
        effects.where("scope = 'thread'").select("target", "label", "code"), "target").select(F.col("id").alias("_id"), "label", "code")
    merged = own.unionAll(whole).groupBy("_id", "label").agg(F.max("code").alias("code"))
    adds = F.col("code").bitwiseAND(1) == 1
    changes = merged.groupBy("_id").agg(F.array_sort(F.collect_list(F.when(adds, F.col("label")))).alias("_added"),
                                        F.collect_list(F.when(~adds, F.col("label"))).alias("_gone"))
    none = F.array().cast("array<string>")
    stored = F.coalesce("labels", none)
    return messages.join(changes, F.col("id") == F.col("_id"), "left").withColumn(
        "labels", F.array_except(F.array_union(stored, F.coalesce("_added", none)), F.coalesce("_gone", none))).withColumn(
        "unread", F.array_contains("labels", "UNREAD")).drop("_id", "_added", "_gone")


def preview(actions: DataFrame) -> DataFrame:
    """What a dry run reports."""
    scope = F.when(F.col("scope") == "thread", F.lit(" (whole thread)")).otherwise("")
    label = F.when(F.coalesce("label", F.lit("")) != "", F.concat(F.lit(" label="), F.col("label"))).otherwise("")
    return actions.select("seq", F.concat("target", F.lit(": would "), "action", scope, label).alias("line"))


def first_requests(actions: DataFrame) -> DataFrame:
    """Whole-thread requests: the first per call and thread runs, the others name it."""
    group = ["call", "source", "thread_id"]
    firsts = top_in_groups(actions, group, ["seq"], 1, "_rank").select(
        *group, F.col("seq").alias("_first"), F.col("target").alias("same_as"))
    return actions.join(firsts, group).withColumn("runs", F.col("seq") == F.col("_first")).withColumn(
        "same_as", F.when(~F.col("runs"), F.col("same_as"))).drop("_first")
