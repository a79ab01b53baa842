"""Threads: collapse, assembly, context, day marks and sender tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.functions import dates
from letterloom.functions.headers import either, participants, source_of
from letterloom.operators.ordering import number_in_groups, number_runs, top_in_groups, with_neighbours
from letterloom.session import materialise


def thread_key() -> Column:
    """The thread, else the chat under its source, else the message itself."""
    source = source_of(F.col("source"), F.col("id"))
    chat = F.when(either("chat_jid") != "", F.concat(source, F.lit(":"), "chat_jid"))
    return either("thread_id", chat, "id")


def collapse_threads(messages: DataFrame, order: str = "seq") -> DataFrame:
    """One row per thread, in the order in which threads are first met.

    ``order`` is the place of a message in the listing. The oldest message with a subject
    owns the subject, the newest the snippet. Messages are first merged per thread and
    sender, with map-side partials, and then per thread; no list of a thread's messages or
    senders is ever built. The first three senders come from a second, narrow pass over
    threads and senders that keeps three rows per thread in every task.
    """
    when = F.nullif(F.coalesce("date", F.lit("")), F.lit(""))
    subject = F.nullif(F.coalesce("subject", F.lit("")), F.lit(""))
    place = F.col(order)
    by_sender = messages.select(
        thread_key().alias("thread"), source_of(F.col("source"), F.col("id")).alias("source"),
        F.coalesce("sender", F.lit("")).alias("sender"), when.alias("date"), subject.alias("subject"),
        either("snippet", "body").alias("snippet"), F.coalesce("unread", F.lit(False)).alias("unread"),
        place.alias("place"),
    ).where("thread <> ''").groupBy("thread", "sender").agg(
        F.count("*").alias("n"),
        F.bool_or("unread").alias("unread"),
        F.min("date").alias("first_date"),
        F.max("date").alias("date"),
        F.min("place").alias("place"),
        F.min(F.struct("place", "source", F.coalesce("subject", F.lit("")).alias("subject"))).alias("first_met"),
        F.max(F.when(F.col("date").isNotNull(), F.struct("date", (-F.col("place")).alias("back"), "snippet"))).alias("newest"),
        F.min(F.when(F.col("date").isNotNull() & F.col("subject").isNotNull(),
                     F.struct("date", "place", "subject"))).alias("oldest"))
    rows = by_sender.groupBy("thread").agg(
        F.min("first_met").alias("first_met"),
        F.min("oldest").alias("oldest"),
        F.max("newest").alias("newest"),
        F.count_if(F.col("sender") != "").alias("participant_count"),
        F.sum("n").alias("message_count"),
        F.coalesce(F.min("first_date"), F.lit("")).alias("first_date"),
        F.coalesce(F.max("date"), F.lit("")).alias("date"),
        F.bool_or("unread").alias("unread"),
        F.min("place").alias("first_seq"))
    heads = top_in_groups(
        by_sender.where("sender <> ''").select("thread", "sender", "place"),
        ["thread"], ["place"], 3,
    ).groupBy("thread").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "sender"))), lambda x: x["sender"]).alias("names"))
    return rows.join(heads, "thread", "left").select(
        F.col("thread").alias("id"), F.col("thread").alias("thread_id"),
        F.col("first_met.source").alias("source"),
        F.coalesce("oldest.subject", "first_met.subject").alias("subject"),
        F.coalesce(participants(F.col("names"), F.col("participant_count")), F.lit("")).alias("participants"),
        "participant_count", "message_count", "first_date", "date",
        F.coalesce("newest.snippet", F.lit("")).alias("snippet"), "unread", "first_seq")


def thread_participants(messages: DataFrame, order: str = "seq") -> DataFrame:
    """Every sender of every thread, numbered in the order of their first message."""
    firsts = messages.select(thread_key().alias("thread_id"), "sender", F.col(order).alias("place")).where(
        "thread_id <> '' AND sender <> ''").groupBy("thread_id", "sender").agg(F.min("place").alias("place"))
    return number_in_groups(firsts, ["thread_id"], ["place"], "ord").drop("place")


def in_thread(messages: DataFrame) -> DataFrame:
    """Messages numbered from 1 within their thread, by date."""
    return number_in_groups(
        messages.withColumn("thread_id", thread_key()), ["thread_id"],
        [F.coalesce("date", F.lit("")), F.col("seq")], "idx")


def thread_headers(messages: DataFrame) -> DataFrame:
    """Per thread: subject of its first message and how many messages it has."""
    first = F.struct(F.coalesce("date", F.lit("")).alias("d"), "seq")
    return messages.withColumn("thread_id", thread_key()).groupBy("thread_id").agg(
        F.coalesce(F.min_by("subject", first), F.lit("")).alias("subject"),
        F.count("*").alias("message_count"))


def assemble(heads: DataFrame, comments: DataFrame, reviews: DataFrame, inline: DataFrame) -> DataFrame:
    """Discussions as threads: the head first, then its replies.

    Replies to a pull request include submitted reviews and inline comments and are ordered
    by date; replies to an issue keep the order they came in. Drafts of reviews are left out.
    """
    pulls = heads.where("is_pull_request").select("thread_id")
    feedback = reviews.where(F.upper(F.coalesce("state", F.lit(""))) != "PENDING").unionByName(
        inline, allowMissingColumns=True).join(pulls, "thread_id", "left_semi")
    kinds = heads.select("thread_id", "is_pull_request", F.col("subject").alias("_subject"))
    replies = comments.unionByName(feedback, allowMissingColumns=True).join(kinds, "thread_id").withColumn(
        "subject", F.col("_subject")).drop("_subject")
    messages = heads.withColumn("_reply", F.lit(0)).unionByName(
        replies.withColumn("_reply", F.lit(1)), allowMissingColumns=True)
    by_date = F.when(F.col("is_pull_request"), F.coalesce("date", F.lit(""))).otherwise("")
    # Sorting by range reads its input twice, once for the bounds, so the joins are done before.
    return number_in_groups(
        materialise(messages.withColumn("_by", by_date)), ["thread_id"], ["_reply", "_by", "seq", "id"], "idx",
    ).drop("_reply", "_by")


def context(messages: DataFrame, keys, order, k: int = 10, **limits) -> DataFrame:
    """Each message with up to ``k`` messages before and after it, in order."""
    item = F.struct("id", "sender", "date")

    def compute(df, window):
        return df.withColumn("before", F.collect_list(item).over(window.rowsBetween(-k, -1))).withColumn(
            "after", F.collect_list(item).over(window.rowsBetween(1, k)))

    return with_neighbours(messages, keys, order, k, compute, **limits)


def last_per_chat(messages: DataFrame, k: int = 20) -> DataFrame:
    """The newest ``k`` messages of each chat; ``rank`` 1 is the newest."""
    return top_in_groups(messages.where("chat_jid <> ''"), ["source", "chat_jid"],
                         [F.desc("date"), F.desc("seq")], k)


def day_marks(messages: DataFrame) -> DataFrame:
    """Mark the first message of every day of a thread.

    In date order that is the smallest message of its day, so an aggregate finds it; the
    days of a hot thread are spread over tasks.
    """
    day = F.to_date(dates.parse_iso(F.col("date")))
    numbered = messages.withColumn("thread_id", thread_key()).withColumn("day", day)
    place = F.struct("date", "seq")
    firsts = numbered.where("day IS NOT NULL").groupBy("thread_id", "day").agg(
        F.min(place).alias("_first")).select(
        F.col("thread_id").alias("_t"), F.col("_first.seq").alias("_s"), F.col("_first.date").alias("_d"))
    return numbered.join(
        firsts, (F.col("thread_id") == F.col("_t")) & (F.col("seq") == F.col("_s")) & (F.col("date") == F.col("_d")),
        "left").withColumn("new_day", F.col("_t").isNotNull()).drop("_t", "_s", "_d")


def date_runs(rows: DataFrame, order, precision: Column | None = None) -> DataFrame:
    """Runs of equal day labels in the order of a listing of any length; a label can come back later."""
    precision = F.lit("year") if precision is None else precision
    label = F.coalesce(dates.day_label(dates.parse_iso(F.col("date")), precision), F.lit("?"))
    return number_runs(rows.withColumn("label", label), order, "label")


def first_name(sender: Column) -> Column:
    """The local part of an address or the first word of a name, capitalised."""
    local = F.when(sender.contains("@"), F.substring_index(sender, "@", 1)).otherwise(sender)
    word = F.regexp_extract(local, r"(?U)(\S+)", 1)
    name = F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substr(word, F.lit(2))))
    return F.when(word == "", F.lit("?")).otherwise(name)


def sender_tokens(messages: DataFrame, order: str = "seq") -> DataFrame:
    """A short name per sender and thread.

    The initial, unless others share it; then the first name, unless others share that; then
    the first name and a number, skipping numbers that make somebody's own name. Works on
    distinct senders, found with map-side partials.
    """
    senders = messages.select("thread_id", F.coalesce("sender", F.lit("")).alias("sender"), F.col(order).alias("place")).groupBy(
        "thread_id", "sender").agg(F.min("place").alias("place"))
    senders = senders.withColumn("name", first_name(F.col("sender")))
    senders = senders.withColumn("initial", F.upper(F.substring("name", 1, 1)))
    names = senders.groupBy("thread_id", "initial", "name").agg(F.count("*").alias("n_name"))
    initials = names.groupBy("thread_id", "initial").agg(
        F.sum("n_name").alias("n_initial"))
    shared = names.where("n_name > 1").select("thread_id", "name", "n_name")
    # Own names such as Ann1 that a numbered Ann must not take: split off their digits and
    # look the rest up among the shared names.
    digits = F.regexp_extract("name", r"^.*?([1-9]\d*)$", 1)
    stem = F.expr("substring(name, 1, length(name) - length(_digits))")
    taken = names.where("n_name = 1").withColumn("_digits", digits).where("_digits <> ''").select(
        "thread_id", stem.alias("name"), F.expr("try_cast(_digits AS DECIMAL(38, 0))").alias("_no")).where("_no IS NOT NULL").join(
        shared.select("thread_id", "name"), ["thread_id", "name"], "left_semi").distinct()
    numbered = number_in_groups(senders, ["thread_id", "name"], ["place"], "_no")
    # The k-th free number is k and one more for every taken number that k has reached: the
    # j-th taken number t is reached from k = t - j + 1 on, so a running count finds them.
    taken = number_in_groups(taken, ["thread_id", "name"], ["_no"], "_j").select(
        "thread_id", "name", (F.col("_no") - F.col("_j") + 1).cast("decimal(38,0)").alias("_at"), F.lit(1).alias("_is_taken"))
    # A step's place among all, less its place among its own, is how many taken numbers it has reached.
    steps = numbered.withColumns({"_at": F.col("_no").cast("decimal(38,0)"), "_is_taken": F.lit(0)}).unionByName(taken, allowMissingColumns=True)
    reached = number_in_groups(steps, ["thread_id", "name"], ["_at", F.desc("_is_taken")], "_all")
    numbered = reached.where("_is_taken = 0").withColumn("_moved", F.col("_all") - F.col("_no"))
    free = numbered.join(initials, ["thread_id", "initial"]).join(
        names.select("thread_id", "name", "n_name"), ["thread_id", "name"])
    number = F.col("_no") + F.col("_moved")
    token = (
        F.when(F.col("n_initial") == 1, F.col("initial"))
        .when(F.col("n_name") == 1, F.col("name"))
        .otherwise(F.concat("name", number.cast("string"))))
    return free.select("thread_id", "sender", token.alias("token"))
