"""Queries over calendar events."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from letterloom.functions import dates
from letterloom.operators import agenda
from letterloom.plans import corpora as C
from letterloom.plans.registry import query
from letterloom.plans.sql_views import EVENTS, MSG, with_views

TZ = "Asia/Tokyo"
NOW = datetime(2024, 1, 10, 18, 0, tzinfo=timezone.utc)
E = with_views(EVENTS)
# Tokyo keeps no summer time: local time is UTC and nine hours. The week of NOW starts on
# 2024-01-08 there.
WEEK = """
, week AS (SELECT *, CASE WHEN all_day THEN start ELSE strftime(start_utc + INTERVAL 9 HOUR, '%Y-%m-%d') END AS day FROM cal
  WHERE CASE WHEN all_day THEN first_day <= DATE '2024-01-14' AND after_day > DATE '2024-01-08'
        ELSE start_utc < TIMESTAMP '2024-01-14 15:00:00' AND end_utc > TIMESTAMP '2024-01-07 15:00:00' END)"""
AGENDA = "day, CASE WHEN all_day THEN 0 ELSE 1 END, start, source, id"


def week(spark, folder):
    low, high = agenda.window_bounds("week", NOW, TZ)
    return agenda.overlapping(C.events(spark, folder), low, high, TZ)


@query("agenda_week", E + WEEK + f"SELECT id, day, row_number() OVER (ORDER BY {AGENDA}) AS place FROM week QUALIFY place <= 250")
def agenda_week(spark, folder):
    """The first 250 events of the reader's week, in reading order."""
    from letterloom.operators.ordering import top_in_groups
    low, high = agenda.window_bounds("week", NOW, TZ)
    rows = agenda.agenda(C.events(spark, folder), low, high, TZ).withColumn("_all", F.lit(0))
    rows = top_in_groups(rows, ["_all"], agenda.agenda_order(TZ), 250, "place")
    return rows.select("id", agenda.display_date(F.col("start"), TZ).alias("day"), F.col("place").cast("bigint").alias("place"))


@query("agenda_range", E + """
SELECT id FROM cal WHERE CASE WHEN all_day THEN first_day <= DATE '2024-01-20' AND after_day > DATE '2024-01-15'
  ELSE start_utc < TIMESTAMP '2024-01-20 14:59:59' AND end_utc > TIMESTAMP '2024-01-14 15:00:00' END""")
def agenda_range(spark, folder):
    """Every event of an inclusive range of dates."""
    low, high = agenda.window_bounds("range", NOW, TZ, "2024-01-15", "2024-01-20")
    return agenda.overlapping(C.events(spark, folder), low, high, TZ).select("id")


@query("agenda_next", E + """
, nxt AS (SELECT *, CASE WHEN all_day THEN start ELSE strftime(start_utc + INTERVAL 9 HOUR, '%Y-%m-%d') END AS day FROM cal
  WHERE CASE WHEN all_day THEN first_day <= DATE '2025-01-08' AND after_day > DATE '2024-01-11' ELSE end_utc > TIMESTAMP '2024-01-10 15:00:00' END),
page AS (SELECT *, row_number() OVER (ORDER BY """ + AGENDA + """) AS place FROM nxt QUALIFY place <= 50),
ser AS (SELECT *, coalesce(recurring_event_id, id) AS k FROM page)
SELECT arg_min(id, place) AS id, count(*) AS instances FROM ser GROUP BY k""")
def agenda_next(spark, folder):
    """The next fifty events, series folded."""
    low, high = agenda.window_bounds("next", NOW, TZ)
    page = agenda.agenda(C.events(spark, folder), low, high, TZ, 50)
    return agenda.collapse_recurring(page, TZ).select("id", "instances")


@query("recurring_collapse", E + """
SELECT arg_min(id, row(day, CASE WHEN all_day THEN 0 ELSE 1 END, start, source, id)) AS id, count(*) AS instances FROM (
  SELECT *, CASE WHEN all_day THEN start ELSE strftime(start_utc + INTERVAL 9 HOUR, '%Y-%m-%d') END AS day FROM cal) GROUP BY coalesce(recurring_event_id, id)""")
def recurring_collapse(spark, folder):
    return agenda.collapse_recurring(C.events(spark, folder), TZ).select("id", "instances")


@query("event_duration", E + """
SELECT id, CASE WHEN all_day THEN 0 ELSE date_diff('minute', start_utc, end_utc) END AS minutes,
  CASE WHEN all_day THEN CASE WHEN event_id % 3 > 0 THEN (1 + event_id % 3) || 'd' ELSE '' END
    WHEN duration_minutes < 60 THEN duration_minutes || 'm' WHEN duration_minutes % 60 = 0 THEN (duration_minutes // 60) || 'h'
    ELSE (duration_minutes // 60) || 'h' || (duration_minutes % 60) || 'm' END AS text FROM cal""")
def event_duration(spark, folder):
    e = C.events(spark, folder)
    minutes = F.when(F.col("all_day"), F.lit(0)).otherwise(agenda.duration_minutes(F.col("start"), F.col("end")))
    return e.select("id", minutes.cast("bigint").alias("minutes"), agenda.duration_text(
        F.col("all_day"), F.col("start"), F.col("end"), F.col("duration_minutes")).alias("text"))


@query("event_times", E + """
, loc AS (SELECT *, start_utc + INTERVAL 9 HOUR AS s, end_utc + INTERVAL 9 HOUR AS e, strftime(first_day, '%b %-d') AS fd, strftime(after_day - 1, '%b %-d') AS ld, date_part('day', after_day - 1) AS lday FROM cal)
SELECT id, CASE WHEN all_day THEN CASE WHEN fd <> ld THEN fd || '-' || lday ELSE fd || ' all-day' END
    ELSE strftime(s, '%b %-d %H:%M-') || strftime(e, '%H:%M') END AS by_date,
  CASE WHEN all_day THEN strftime(first_day, '%a all-day') ELSE strftime(s, '%a %H:%M-') || strftime(e, '%H:%M') END AS by_day FROM loc""")
def event_times(spark, folder):
    return C.events(spark, folder).select(
        "id", agenda.event_time(F.lit("date"), TZ).alias("by_date"), agenda.event_time(F.lit("day"), TZ).alias("by_day"))


@query("summer_time", """
WITH e AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN DATE '2027-10-31' ELSE DATE '2027-03-28' END AS day, (event_id * 7) % 240 AS m FROM events)
SELECT event_id, strftime(day + to_minutes(m) - to_hours(CASE WHEN (month(day) = 10) = (m < 180) THEN 2 ELSE 1 END), '%Y-%m-%dT%H:%M:%S+00:00') AS start FROM e""")
def summer_time(spark, folder):
    """Times in the night in which clocks change: a repeated hour is its first, a skipped one lies an hour on."""
    minutes = F.expr("CAST((event_id * 7) % 240 AS INT)")
    day = F.expr("if(event_id % 2 = 0, '2027-10-31', '2027-03-28')")
    local = F.concat(day, F.lit("T"), F.lpad(F.floor(minutes / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((minutes % 60).cast("string"), 2, "0"), F.lit(":00"))
    return C.table(spark, folder, "events").select("event_id", dates.to_utc_iso(local, F.lit("Europe/Berlin")).alias("start"))


@query("rrule_text", """
SELECT event_id, CASE user_id % 6 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly on Mon+' || CASE WHEN event_id % 2 = 0 THEN 'Fri' ELSE '2SU' END WHEN 2 THEN 'weekly'
  WHEN 3 THEN 'monthly' WHEN 4 THEN 'yearly' ELSE 'FREQ=HOURLY;INTERVAL=' || (event_id % 5) END AS rule,
  CASE event_id % 4 WHEN 0 THEN CASE WHEN user_id % 3 > 1 THEN 'every ' || (user_id % 3) || ' ' ELSE '' END || 'weekly on Tue+Thu'
    WHEN 1 THEN CASE WHEN user_id % 3 > 1 THEN 'every ' || (user_id % 3) || ' ' ELSE '' END || 'monthly' WHEN 2 THEN 'recurring' ELSE '' END AS pattern FROM events""")
def rrule_text(spark, folder):
    e = C.table(spark, folder, "events").withColumns({
        "rule": F.expr("""CASE user_id % 6 WHEN 0 THEN 'FREQ=DAILY' WHEN 1 THEN concat('FREQ=WEEKLY;BYDAY=MO,', if(event_id % 2 = 0, 'FR', '2SU'))
            WHEN 2 THEN 'FREQ=WEEKLY;COUNT=3' WHEN 3 THEN 'FREQ=MONTHLY' WHEN 4 THEN 'FREQ=YEARLY' ELSE concat('FREQ=HOURLY;INTERVAL=', event_id % 5) END"""),
        "kind": F.expr("CASE event_id % 4 WHEN 0 THEN 'weekly' WHEN 1 THEN 'relativeMonthly' WHEN 2 THEN 'lunar' END"),
        "step": F.expr("CAST(user_id % 3 AS INT)")})
    days = F.array(F.lit("tuesday"), F.lit("Thursday"))
    return e.select("event_id", agenda.rule_text(F.col("rule")).alias("rule"), agenda.pattern_text(F.col("kind"), F.col("step"), days).alias("pattern"))


@query("attendee_enrichment", with_views(EVENTS, MSG) + """
, att AS (SELECT id AS event, 'u' || (event_id % 100) || '@' || CASE WHEN event_id % 2 = 0 THEN 'furniture' ELSE 'building' END || '.example.com' AS email FROM cal),
mail AS (SELECT sender AS email, count(*) FILTER (unread) AS unread, arg_max(subject, row(date, seq)) AS last_subject FROM msg GROUP BY sender)
SELECT event, email, coalesce(unread, 0) AS unread, last_subject FROM att LEFT JOIN mail USING (email)""")
def attendee_enrichment(spark, folder):
    """Attendees with the unread messages and the last subject of their mail."""
    people = C.events(spark, folder).selectExpr(
        "id AS event", "concat('u', event_id % 100, '@', if(event_id % 2 = 0, 'Furniture', 'building'), '.example.com') AS email")
    names = C.contacts(spark, folder).where("identifier LIKE 'g:%'").groupBy(F.substr("identifier", F.lit(3)).alias("email")).agg(F.min("alias").alias("name"))
    return agenda.enrich_attendees(people, names, C.messages(spark, folder)).select("event", "email", "unread", "last_subject")
