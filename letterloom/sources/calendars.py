"""Calendar payloads: two JSON dialects and iCalendar text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.functions import dates
from letterloom.functions import patterns as P
from letterloom.functions.headers import either, lit_map, once, strip_mailto
from letterloom.operators.agenda import duration_minutes, pattern_text, rule_text
from letterloom.schema import EVENT_DETAILS, EVENTS, conform
from letterloom.sources.landing import EVENT_FORMS, first_where, form, prefixed, rows_of, text

MOMENT = "STRUCT<dateTime:STRING,date:STRING,timeZone:STRING>"
GOOGLE = (
    f"STRUCT<id:STRING,summary:STRING,start:{MOMENT},end:{MOMENT},location:STRING,status:STRING,"
    "recurringEventId:STRING,recurrence:ARRAY<STRING>,description:STRING,created:STRING,updated:STRING,"
    "organizer:STRUCT<email:STRING>,"
    "attendees:ARRAY<STRUCT<email:STRING,displayName:STRING,self:BOOLEAN,responseStatus:STRING>>,"
    "conferenceData:STRUCT<entryPoints:ARRAY<STRUCT<entryPointType:STRING,uri:STRING>>>>")
PLACE = "STRUCT<name:STRING,address:STRING>"
GRAPH = (
    f"STRUCT<id:STRING,subject:STRING,start:{MOMENT},end:{MOMENT},isAllDay:BOOLEAN,isCancelled:BOOLEAN,"
    "location:STRUCT<displayName:STRING>,responseStatus:STRUCT<response:STRING>,seriesMasterId:STRING,"
    f"organizer:STRUCT<emailAddress:{PLACE}>,body:STRUCT<content:STRING>,"
    f"attendees:ARRAY<STRUCT<emailAddress:{PLACE},status:STRUCT<response:STRING>>>,"
    "onlineMeeting:STRUCT<joinUrl:STRING>,createdDateTime:STRING,lastModifiedDateTime:STRING,"
    "recurrence:STRUCT<pattern:STRUCT<type:STRING,interval:INT,daysOfWeek:ARRAY<STRING>>>>")


def people_count(n: Column) -> Column:
    return F.when(n > 0, F.concat(n.cast("string"), F.lit(" people"))).otherwise("")


def _finish(df: DataFrame, detail: bool) -> DataFrame:
    timed = F.when(~F.col("all_day"), duration_minutes(F.col("start"), F.col("end")))
    return conform(df.withColumn("duration_minutes", timed), EVENT_DETAILS if detail else EVENTS)


@form("gcal", GOOGLE, lambda payload: F.from_json(payload, GOOGLE), events=True, one=True)
def _google_columns(df: DataFrame, item: str) -> tuple[DataFrame, dict[str, Column]]:
    e = F.col(item)
    all_day = e["start"]["date"].isNotNull() & e["start"]["dateTime"].isNull()

    def moment(side):
        zone = either(side["timeZone"], F.col("timezone"), F.lit("UTC"))
        return dates.to_utc_iso(text(side["dateTime"]), zone)

    mine = first_where(e["attendees"], lambda a: F.coalesce(a["self"], F.lit(False)))
    video = first_where(e["conferenceData"]["entryPoints"], lambda p: p["entryPointType"] == "video")
    rule = text(F.substr(first_where(e["recurrence"], lambda r: r.startswith("RRULE:")), F.lit(7)))
    return df, {
        "id": prefixed(F.col("source"), e["id"]),
        "title": F.coalesce(e["summary"], F.lit("(No title)")),
        "all_day": all_day,
        "start": F.when(all_day, e["start"]["date"]).otherwise(moment(e["start"])),
        "end": F.when(all_day, F.coalesce(e["end"]["date"], e["start"]["date"])).otherwise(moment(e["end"])),
        "location": text(e["location"]),
        "organizer": text(e["organizer"]["email"]),
        "attendees_summary": people_count(F.coalesce(F.size(e["attendees"]), F.lit(0))),
        "status": F.coalesce(e["status"], F.lit("confirmed")),
        "your_status": mine["responseStatus"],
        "recurring_event_id": F.when(text(e["recurringEventId"]) != "", prefixed(F.col("source"), e["recurringEventId"])),
        "attendees": F.transform(e["attendees"], lambda a: F.struct(
            F.coalesce(a["displayName"], a["email"], F.lit("")).alias("name"), text(a["email"]).alias("email"),
            F.coalesce(a["responseStatus"], F.lit("needsAction")).alias("status"))),
        "description": text(e["description"]),
        "meeting_link": text(video["uri"]),
        "recurrence": rule,
        "recurrence_summary": F.when(rule != "", rule_text(rule)).otherwise(""),
        "created": text(e["created"]),
        "updated": text(e["updated"]),
    }


def google_events(raw: DataFrame, detail: bool = False) -> DataFrame:
    """Events; a floating time is read in its own zone, else in the ``timezone`` of its source."""
    return _finish(rows_of(raw, EVENT_FORMS["gcal"]), detail)


@form("o365cal", GRAPH, lambda payload: F.from_json(payload, GRAPH), events=True, one=True)
def _graph_columns(df: DataFrame, item: str) -> tuple[DataFrame, dict[str, Column]]:
    e = F.col(item)
    all_day = F.coalesce(e["isAllDay"], F.lit(False))

    def moment(side):
        at = text(side["dateTime"])
        return F.when(all_day, F.substring_index(at, "T", 1)).otherwise(
            dates.to_utc_iso(F.regexp_replace(at, r"(\.\d{6})\d+", "$1"), F.coalesce(side["timeZone"], F.lit("UTC"))))

    answer = text(e["responseStatus"]["response"])
    pattern = e["recurrence"]["pattern"]
    words = pattern_text(F.when(pattern.isNotNull(), text(pattern["type"])), pattern["interval"], pattern["daysOfWeek"])
    return df, {
        "id": prefixed(F.col("source"), e["id"]),
        "title": F.coalesce(e["subject"], F.lit("(No title)")),
        "all_day": all_day,
        "start": moment(e["start"]),
        "end": moment(e["end"]),
        "location": text(e["location"]["displayName"]),
        "organizer": text(e["organizer"]["emailAddress"]["address"]),
        "attendees_summary": people_count(F.coalesce(F.size(e["attendees"]), F.lit(0))),
        "status": F.when(F.coalesce(e["isCancelled"], F.lit(False)), F.lit("cancelled")).otherwise("confirmed"),
        "your_status": F.when(~answer.isin("none", "organizer", ""), answer),
        "recurring_event_id": F.when(text(e["seriesMasterId"]) != "", prefixed(F.col("source"), e["seriesMasterId"])),
        "attendees": F.transform(e["attendees"], lambda a: F.struct(
            F.coalesce(a["emailAddress"]["name"], a["emailAddress"]["address"], F.lit("")).alias("name"),
            text(a["emailAddress"]["address"]).alias("email"),
            F.coalesce(a["status"]["response"], F.lit("none")).alias("status"))),
        "description": text(e["body"]["content"]),
        "meeting_link": text(e["onlineMeeting"]["joinUrl"]),
        "recurrence": F.to_json(e["recurrence"]),
        "recurrence_summary": words,
        "created": text(e["createdDateTime"]),
        "updated": text(e["lastModifiedDateTime"]),
    }


def graph_events(raw: DataFrame, detail: bool = False) -> DataFrame:
    """Events; the zone of a time stands beside it, all-day events keep their dates."""
    return _finish(rows_of(raw, EVENT_FORMS["o365cal"]), detail)


# iCalendar text

# The name and the parameters of a line, with the colon before the value.
HEAD = r'^[^:;]+(?:;[^=:;]+=(?:"[^"]*"|[^":;]*))*:'


def unfold(content: Column) -> Column:
    """One property per line: joined continuation lines, plain line ends."""
    return F.regexp_replace(F.regexp_replace(content, r"\r\n?", "\n"), r"\n[ \t]", "")


def properties(lines: Column) -> Column:
    """Lines as ``(name, params, value)``, taken apart once; lines without a name are dropped."""
    def cut(line):
        return F.struct(line.alias("line"), F.regexp_extract(line, HEAD, 0).alias("head"),
                        F.substring_index(F.substring_index(line, ":", 1), ";", 1).alias("name"))

    def parts(x):
        size, named = F.length(x["head"]), F.length(x["name"])
        return F.struct(F.upper(x["name"]).alias("name"), F.substr(x["head"], named + 1, size - named - 1).alias("params"),
                        F.substr(x["line"], size + 1).alias("value"))

    return F.transform(F.filter(F.transform(lines, cut), lambda x: x["head"] != ""), parts)


def first_named(name: str) -> Column:
    """The first property of a name."""
    return first_where(F.col("lines"), lambda p: p["name"] == name)


def _param(prop: Column, name: str) -> Column:
    return F.replace(F.regexp_extract(prop["params"], rf'(?i);{name}=("[^"]*"|[^;]*)', 1), F.lit('"'), F.lit(""))


def unescaped(value: Column) -> Column:
    r"""Resolve ``\,``, ``\;``, ``\\`` and ``\n`` from left to right."""
    tokens = F.regexp_extract_all(value, F.lit(r"(?s)\\.|\\$|[^\\]+"), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.when(t.isin("\\n", "\\N"), F.lit("\n")).when(
        t.startswith("\\"), F.substr(t, F.lit(2))).otherwise(t)), "")


def _moment(prop: Column, zone: Column) -> Column:
    """A date or a UTC time as ISO text; NULL where there is none."""
    def read(value):
        day = F.regexp_replace(value, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
        clock = F.regexp_replace(value, r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})(Z?)$", "$1-$2-$3T$4:$5:$6$7")
        own = either(_param(prop, "TZID"), zone, F.lit("UTC"))
        return F.when(value.rlike(r"^\d{8}$"), day).when(
            value.rlike(r"^\d{8}T\d{6}Z?$"), once(clock, lambda c: dates.to_utc_iso(c, own)))

    return once(prop["value"], read)


def _seconds(duration: Column) -> Column:
    """Seconds of a duration such as ``PT1H30M`` or ``P1D``."""
    total = F.lit(0).cast("bigint")
    for unit, size in (("W", 604800), ("D", 86400), ("H", 3600), ("M", 60), ("S", 1)):
        n = F.regexp_extract(duration, rf"(\d+){unit}", 1).try_cast("bigint")
        total = total + F.coalesce(n, F.lit(0)) * size
    return F.when(duration.startswith("-"), -total).otherwise(total)


def _blocks(payload: Column) -> Column:
    """The text of each event."""
    return F.filter(F.split(unfold(payload), r"(?im)^BEGIN:VEVENT\s*$"), lambda b: F.upper(b).contains("END:VEVENT"))


@form("caldav", "STRING", _blocks, events=True, json=False)
def _ical_columns(df: DataFrame, item: str) -> tuple[DataFrame, dict[str, Column]]:
    """An event is cut into lines; a property is the first line of its name.

    Alarms and other parts nested in an event are cut out first.
    """
    inner = F.regexp_replace(
        F.regexp_replace(item, r"(?is)\nEND:VEVENT.*$", "\n"), r"(?ims)^BEGIN:(\w+).*?^END:\1\s*$", "")
    events = df.withColumn("lines", properties(F.split(inner, "\n")))
    names = ("UID", "DTSTART", "DTEND", "DURATION", "SUMMARY", "STATUS", "LOCATION", "ORGANIZER",
             "RECURRENCE-ID", "DESCRIPTION", "URL", "RRULE", "CREATED", "LAST-MODIFIED")
    zone = F.col("timezone")
    events = events.withColumns({"ATTENDEE": F.filter("lines", lambda p: p["name"] == "ATTENDEE")} | {n: first_named(n) for n in names})
    events = events.withColumns({
        "begin": _moment(F.col("DTSTART"), zone), "stated_end": _moment(F.col("DTEND"), zone),
        "instance": _moment(F.col("RECURRENCE-ID"), zone), "length": _seconds(F.col("DURATION.value"))})
    begin, length, instance = F.col("begin"), F.col("length"), F.col("instance")
    all_day = F.coalesce(F.length(begin) == 10, F.lit(False))
    later = F.when(all_day, F.date_format(F.date_add(begin.try_cast("date"), (length / 86400).cast("int")), "yyyy-MM-dd")).otherwise(
        dates.iso_offset(F.timestamp_seconds(F.unix_seconds(dates.parse_iso(begin)) + length)))
    end = F.coalesce("stated_end", F.when(F.col("DURATION").isNotNull(), later), begin, F.lit(""))

    def address(prop):
        return strip_mailto(prop["value"])

    def answer(prop):
        status = F.upper(either(_param(prop, "PARTSTAT"), F.lit("NEEDS-ACTION")))
        return F.coalesce(F.try_element_at(lit_map(P.PARTSTAT), status), F.lower(status))

    def value(name):
        return text(F.col(f"`{name}`.value"))

    def shown(name):
        return F.when(value(name).contains("\\"), unescaped(value(name))).otherwise(value(name))

    mine = first_where(F.col("ATTENDEE"), lambda x: F.lower(address(x)) == F.lower("owner"))
    uid, rule = value("UID"), value("RRULE")
    return events, {
        "id": prefixed(F.col("source"), F.when(instance.isNotNull(), F.concat(uid, F.lit("::"), instance)).otherwise(uid)),
        "title": either(shown("SUMMARY"), F.lit("(No title)")),
        "all_day": all_day,
        "start": text(begin),
        "end": end,
        "location": shown("LOCATION"),
        "organizer": text(address(F.col("ORGANIZER"))),
        "attendees_summary": people_count(F.size("ATTENDEE")),
        "status": F.lower(either(value("STATUS"), F.lit("confirmed"))),
        "your_status": F.when(mine.isNotNull(), answer(mine)),
        "recurring_event_id": F.when(instance.isNotNull(), prefixed(F.col("source"), uid)),
        "attendees": F.transform("ATTENDEE", lambda x: F.struct(
            either(_param(x, "CN"), address(x)).alias("name"), address(x).alias("email"), answer(x).alias("status"))),
        "description": shown("DESCRIPTION"),
        "meeting_link": value("URL"),
        "recurrence": rule,
        "recurrence_summary": F.when(rule != "", rule_text(rule)).otherwise(""),
        "created": text(_moment(F.col("CREATED"), zone)),
        "updated": text(_moment(F.col("LAST-MODIFIED"), zone)),
    }


def ical_events(raw: DataFrame, detail: bool = False) -> DataFrame:
    """Events of iCalendar text. ``owner`` is the address whose answer counts."""
    return _finish(rows_of(raw, EVENT_FORMS["caldav"]), detail)
