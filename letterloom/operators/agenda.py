"""Calendar events: windows, order, durations, recurring series and display times."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.functions import dates
from letterloom.functions import patterns as P
from letterloom.functions.headers import lit_map
from letterloom.operators.ordering import top_in_groups


def window_bounds(kind: str, now: datetime, tz: str, first: str = "", last: str = "") -> tuple[datetime, datetime]:
    """The UTC bounds of today, tomorrow, this week, the next year or a range of dates.

    Days begin at midnight where the reader is.
    """
    zone = ZoneInfo(tz)
    today = now.astimezone(zone).date()
    if kind == "range":
        start, days = date.fromisoformat(first), None
        end = datetime.combine(date.fromisoformat(last), datetime.max.time().replace(microsecond=0), zone)
    else:
        offset, days = {"today": (0, 1), "tomorrow": (1, 1), "week": (-today.weekday(), 7), "next": (0, 365)}[kind]
        start = today + timedelta(days=offset)
        end = datetime.combine(start + timedelta(days=days), datetime.min.time(), zone)
    begin = datetime.combine(start, datetime.min.time(), zone)
    return begin.astimezone(timezone.utc), end.astimezone(timezone.utc)


def start_ts() -> Column:
    return dates.parse_iso(F.col("start"))


def timed() -> Column:
    return F.instr("start", "T") > 0


def display_date(value: Column, tz: str) -> Column:
    """The day a start falls on for the reader; all-day dates never move."""
    local = F.date_format(F.from_utc_timestamp(dates.parse_iso(value), tz), "yyyy-MM-dd")
    return F.when(F.instr(value, "T") > 0, F.coalesce(local, F.substring(value, 1, 10))).otherwise(value)


def overlapping(events: DataFrame, low: datetime, high: datetime, tz: str) -> DataFrame:
    """Events of a window: timed ones by instant, all-day ones by the dates the reader asked for."""
    zone = ZoneInfo(tz)
    low_date = low.astimezone(zone).date()
    last_date = (high - timedelta(microseconds=1)).astimezone(zone).date()
    begin, end = start_ts(), dates.parse_iso(F.col("end"))
    instants = (begin < F.lit(high)) & (end > F.lit(low))
    first = F.col("start").try_cast("date")
    after = F.greatest(F.coalesce(F.nullif("end", F.lit("")), "start").try_cast("date"), F.date_add(first, 1))
    days = (first <= F.lit(last_date)) & (after > F.lit(low_date))
    return events.where(F.when(timed(), instants).otherwise(F.coalesce(days, F.lit(True))))


def agenda_order(tz: str) -> list[Column]:
    """By the reader's day, all-day events first, then by instant."""
    return [display_date(F.col("start"), tz), timed().cast("int"), F.col("start"), F.col("source"), F.col("id")]


def agenda(events: DataFrame, low: datetime, high: datetime, tz: str, count: int | None = None) -> DataFrame:
    """The events of a window in order; with ``count``, the first so many of them."""
    rows = overlapping(events, low, high, tz).orderBy(*agenda_order(tz))
    return rows if count is None else rows.limit(count)


def collapse_recurring(events: DataFrame, tz: str) -> DataFrame:
    """One row per series: its first instance, and how many there are.

    Instances are counted with map-side partials and the first one is found by rank, so a
    series with a third of all events does not gather in one task.
    """
    series = F.coalesce("recurring_event_id", F.concat(F.lit("\u0000"), "id"))
    keyed = events.withColumn("_series", series)
    counts = keyed.groupBy("_series").agg(F.count("*").alias("instances"))
    first = top_in_groups(keyed, ["_series"], agenda_order(tz), 1, "_rank").drop("_rank")
    return first.join(counts, "_series").drop("_series").withColumn("collapsed", F.col("instances") > 1)


def duration_minutes(start: Column, end: Column) -> Column:
    """Whole minutes, never negative; NULL where a time cannot be read."""
    seconds = F.unix_seconds(dates.parse_iso(end)) - F.unix_seconds(dates.parse_iso(start))
    return F.greatest(F.lit(0), (seconds / 60).cast("bigint"))


def duration_text(all_day: Column, start: Column, end: Column, minutes: Column) -> Column:
    """``30m``, ``1h``, ``1h30m``; ``3d`` for all-day events of more than one day."""
    days = F.datediff(end.try_cast("date"), start.try_cast("date"))
    hours = F.floor(minutes / 60).cast("string")
    rest = minutes % 60
    whole = F.coalesce(F.when(days > 1, F.concat(days.cast("string"), F.lit("d"))), F.lit(""))
    clock = (
        F.when(minutes.isNull(), F.lit(""))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m")))
        .when(rest == 0, F.concat(hours, F.lit("h")))
        .otherwise(F.concat(hours, F.lit("h"), rest.cast("string"), F.lit("m"))))
    return F.when(all_day, whole).otherwise(clock)


def time_mode(tz: str) -> Column:
    """Aggregate: how much of a date the rows of a listing need."""
    day = F.when(F.col("all_day"), F.col("start")).otherwise(display_date(F.col("start"), tz))
    span = F.datediff(F.max(day).try_cast("date"), F.min(day).try_cast("date"))
    return (
        F.when(F.coalesce(F.min(day) == F.max(day), F.lit(True)), F.lit("time"))
        .when(span <= 7, F.lit("day"))
        .otherwise(F.lit("date")))


def event_time(mode: Column, tz: str) -> Column:
    """When an event is, for a listing."""
    first = F.col("start").try_cast("date")
    last = F.date_sub(F.col("end").try_cast("date"), 1)
    month_day = F.date_format(first, "MMM d")
    several = (F.col("end") != F.col("start")) & (F.date_format(last, "MMM d") != month_day)
    whole = (
        F.when(mode == "time", F.lit("all-day"))
        .when(mode == "day", F.date_format(first, "EEE 'all-day'"))
        .when(several, F.concat(month_day, F.lit("-"), F.date_format(last, "d")))
        .otherwise(F.concat(month_day, F.lit(" all-day"))))
    begin = F.from_utc_timestamp(start_ts(), tz)
    end = F.from_utc_timestamp(dates.parse_iso(F.col("end")), tz)
    clock = F.concat(F.date_format(begin, "HH:mm"), F.lit("-"), F.date_format(end, "HH:mm"))
    at = (
        F.when(mode == "time", clock)
        .when(mode == "day", F.concat(F.date_format(begin, "EEE "), clock))
        .otherwise(F.concat(F.date_format(begin, "MMM d "), clock)))
    return F.when(F.col("all_day"), whole).otherwise(F.coalesce(at, F.col("start")))


def when_detail(tz: str) -> Column:
    """When an event is, in full."""
    first, last = F.col("start").try_cast("date"), F.date_sub(F.col("end").try_cast("date"), 1)
    days = (F.datediff(last, first) + 1).cast("string")
    whole = F.when(first == last, F.concat(F.date_format(first, "EEE MMM d"), F.lit(", all-day"))).otherwise(
        F.concat(F.date_format(first, "EEE MMM d"), F.lit("-"), F.date_format(last, "MMM d"),
                 F.lit(" ("), days, F.lit("d)")))
    begin = F.from_utc_timestamp(start_ts(), tz)
    end = F.from_utc_timestamp(dates.parse_iso(F.col("end")), tz)
    length = duration_text(F.col("all_day"), F.col("start"), F.col("end"), F.col("duration_minutes"))
    clock = F.concat(F.date_format(begin, "EEE MMM d, HH:mm"), F.lit("-"), F.date_format(end, "HH:mm"),
                     F.when(length != "", F.concat(F.lit(" ("), length, F.lit(")"))).otherwise(""))
    return F.when(F.col("all_day"), F.coalesce(whole, F.lit("all-day"))).otherwise(F.coalesce(clock, F.col("start")))


def rule_text(rule: Column) -> Column:
    """A recurrence rule in words: ``weekly on Mon+Tue``; an unusual rule stays as it is."""
    parts = F.str_to_map(rule, F.lit(";"), F.lit("="))
    freq = F.try_element_at(parts, F.lit("FREQ"))
    by_day = F.coalesce(F.try_element_at(parts, F.lit("BYDAY")), F.lit(""))
    names = lit_map(P.RULE_DAYS)
    days = F.array_join(F.transform(F.split(by_day, ","), lambda d: F.coalesce(
        F.try_element_at(names, F.trim(d)), F.trim(d))), "+")
    return (
        F.when(freq == "DAILY", F.lit("daily"))
        .when((freq == "WEEKLY") & (by_day != ""), F.concat(F.lit("weekly on "), days))
        .when(freq == "WEEKLY", F.lit("weekly"))
        .when(freq == "MONTHLY", F.lit("monthly"))
        .when(freq == "YEARLY", F.lit("yearly"))
        .otherwise(F.coalesce(rule, F.lit(""))))


def pattern_text(kind: Column, interval: Column, days: Column) -> Column:
    """A recurrence pattern in words, with ``every N`` where it skips."""
    names = lit_map(P.PATTERN_DAYS)
    listed = F.array_join(F.transform(days, lambda d: F.coalesce(F.try_element_at(names, F.lower(d)), d)), "+")
    every = F.when(F.coalesce(interval, F.lit(1)) > 1, F.concat(F.lit("every "), interval.cast("string"), F.lit(" "))).otherwise("")
    word = (
        F.when(kind == "daily", F.lit("daily"))
        .when((kind == "weekly") & (F.coalesce(F.size(days), F.lit(0)) > 0), F.concat(F.lit("weekly on "), listed))
        .when(kind == "weekly", F.lit("weekly"))
        .when(kind.isin("absoluteMonthly", "relativeMonthly"), F.lit("monthly"))
        .when(kind.isin("absoluteYearly", "relativeYearly"), F.lit("yearly")))
    return F.when(kind.isNull(), F.lit("")).otherwise(F.coalesce(F.concat(every, word), F.lit("recurring")))


def usable_calendars(calendars: DataFrame) -> DataFrame:
    """Calendars that hold readable events."""
    return calendars.where(
        (F.coalesce("access_role", F.lit("")) != "freeBusyReader")
        & (F.col("components").isNull() | F.array_contains("components", "VEVENT")))


def enrich_attendees(attendees: DataFrame, names: DataFrame, messages: DataFrame) -> DataFrame:
    """Attendees with what is known of their mail: unread messages and the last subject.

    Messages are summed up per sender before they meet the attendees.
    """
    mail = messages.groupBy(F.lower("sender").alias("email")).agg(
        F.count_if(F.coalesce("unread", F.lit(False))).alias("unread"),
        F.max_by("subject", F.struct("date", "seq")).alias("last_subject"))
    return attendees.withColumn("email", F.lower("email")).join(names, "email", "left").join(
        mail, "email", "left").withColumn("unread", F.coalesce("unread", F.lit(0)))
