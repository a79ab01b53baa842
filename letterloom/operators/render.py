"""Compact pipe, JSON and XML renderings, as text columns.

A rendering is a table of lines with the columns that order them, so it can be any size and
goes to a text sink as it is. What a whole set decides, such as whether any row has a
snippet, is read first as one row. ``document`` joins the lines of a bounded page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.functions import dates
from letterloom.functions.headers import flat_body, message_size, snippet_field, xml_attr, xml_text
from letterloom.operators import agenda, threads
from letterloom.operators.ordering import number_in_groups

FORMATS = {"p": "pipe", "pipe": "pipe", "j": "json", "json": "json", "x": "xml", "xml": "xml"}


def format_name(name: str) -> str:
    try:
        return FORMATS[name.lower().strip()]
    except KeyError:
        raise ValueError(f"unknown format {name!r}: pipe (p), json (j) or xml (x)") from None


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _pipe(*parts) -> Column:
    """Cells of a row; a missing one still takes its place."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def _mark() -> Column:
    return F.when(F.coalesce(F.col("unread"), F.lit(False)), F.lit("*")).otherwise(" ")


def _attrs(**values: Column) -> Column:
    return F.concat(*[F.concat(F.lit(f" {k.rstrip('_')}="), xml_attr(v)) for k, v in values.items()])


def _head(df: DataFrame, line: Column | str, *orders: str) -> DataFrame:
    """One line that sorts before all others."""
    line = F.lit(line) if isinstance(line, str) else line
    return df.sparkSession.range(1).select(*[F.lit(-1).cast("bigint").alias(o) for o in orders], line.alias("line"))


def _size() -> Column:
    return message_size(F.col("size"), F.col("body"), F.col("snippet"))


def _flags(rows: DataFrame, *date_columns: str) -> tuple[bool, str]:
    """Whether any row has a snippet, and the precision that the dates call for."""
    spans = rows.select("snippet", F.explode(F.array(*date_columns)).alias("date"))
    row = spans.agg(F.max(F.coalesce(F.col("snippet"), F.lit("")) != ""), dates.precision_of(
        F.nullif(F.col("date"), F.lit("")))).first()
    return bool(row[0]), row[1]


def _optional(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.lit(None).cast("string") for n in names if n not in df.columns})


def listing(rows: DataFrame, fmt: str = "pipe", precision: str | None = None) -> DataFrame:
    """``(place, part, line)`` of messages that carry their ``place``.

    With a ``ref`` column rows show it instead of the id, and a line with the date opens
    every run of rows of one day. ``precision``, ``day`` or ``year``, fixes how exact these
    dates are; without it the rows decide, and rows of a single day have no such lines.
    """
    fmt = format_name(fmt)
    rows = _optional(rows, "size", "body", "snippet")
    place = F.col("place").cast("bigint").alias("place")
    if fmt == "json":
        item = F.struct("source", _text("sender").alias("from"), _text("subject").alias("subject"),
                        _text("date").alias("date"), "id", _size().alias("size"), "unread")
        return rows.select(place, F.lit(1).cast("bigint").alias("part"), F.to_json(item).alias("line"))
    if fmt == "xml":
        line = F.concat(F.lit("<m"), _attrs(id=_text("id"), **{"from": _text("sender")}, subject=_text("subject"),
                                            date=_text("date"), size=_size()), F.lit("/>"))
        return rows.select(place, F.lit(1).cast("bigint").alias("part"), line.alias("line"))
    snippets, needed = _flags(rows, "date")
    precision = precision or needed
    tail = [snippet_field(_text("snippet"))] if snippets else []
    last = "|SNIPPET" if snippets else ""
    if "ref" not in rows.columns:
        line = _pipe(_mark(), F.col("source"), F.col("sender"), F.col("subject"), F.col("date"), F.col("id"), _size(), *tail)
        return _head(rows, " |SOURCE|FROM|SUBJECT|DATE|ID|SIZE" + last, "place", "part").unionByName(
            rows.select(place, F.lit(1).cast("bigint").alias("part"), line.alias("line")))
    grouped = precision != "time"
    stamp = dates.compact_stamp(_text("date"), F.lit("time"))
    line = _pipe(_mark(), F.coalesce("ref", F.lit(0)), F.col("source"), F.col("sender"), F.col("subject"), stamp, _size(), *tail)
    out = _head(rows, " |N|SOURCE|FROM|SUBJECT|DATE|SIZE" + last, "place", "part").unionByName(
        rows.select(place, F.lit(1).cast("bigint").alias("part"), line.alias("line")))
    if not grouped:
        return out
    runs = threads.date_runs(rows, ["place"], F.lit(precision)).groupBy("run", "label").agg(
        F.min("place").cast("bigint").alias("place"))
    return out.unionByName(runs.select("place", F.lit(0).cast("bigint").alias("part"), F.concat(F.lit("--- "), "label", F.lit(" ---")).alias("line")))


def thread_listing(rows: DataFrame, fmt: str = "pipe", senders: DataFrame | None = None) -> DataFrame:
    """``(place, line)`` of collapsed threads; ``senders`` adds the full lists of a page."""
    fmt = format_name(fmt)
    place = F.col("first_seq").cast("bigint").alias("place")
    if fmt == "pipe":
        snippets, precision = _flags(rows, "first_date", "date")
        ident = F.coalesce("ref", F.lit(0)) if "ref" in rows.columns else F.col("id")
        line = _pipe(_mark(), ident, F.col("source"), F.col("participants"), F.col("subject"),
                     dates.date_span(F.col("first_date"), F.col("date"), F.lit(precision)), F.col("message_count"),
                     *([snippet_field(_text("snippet"))] if snippets else []))
        title = f" |{'N' if 'ref' in rows.columns else 'ID'}|SOURCE|WHO|SUBJECT|DATES|MSGS" + ("|SNIPPET" if snippets else "")
        return _head(rows, title, "place").unionByName(rows.select(place, line.alias("line")))
    names = senders.groupBy("thread_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("ord", "sender"))), lambda x: x["sender"]).alias("names"))
    rows = rows.join(names, "thread_id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    shown = F.nullif(_text("snippet"), F.lit(""))
    if fmt == "json":
        line = F.to_json(F.struct("source", "subject", F.col("names").alias("participants"), "message_count",
                                  "first_date", "date", "id", shown.alias("snippet"), "unread"))
    else:
        line = F.concat(F.lit("<t"), _attrs(
            id=F.col("id"), subject=F.col("subject"), who=F.array_join("names", ","), n=F.col("message_count").cast("string"),
            **{"from": F.col("first_date")}, to=F.col("date")),
            F.coalesce(F.concat(F.lit(" snip="), xml_attr(shown)), F.lit("")), F.lit("/>"))
    return rows.select(place, line.alias("line"))


def message(fmt: str = "pipe") -> Column:
    """The text of one whole message, over a table with the message columns."""
    fmt = format_name(fmt)
    if fmt == "json":
        return F.to_json(F.struct(
            "source", _text("sender").alias("from"), _text("subject").alias("subject"), _text("date").alias("date"), "id",
            _size().alias("size"), _text("body").alias("body"), F.nullif("to", F.lit("")).alias("to"),
            F.nullif("cc", F.lit("")).alias("cc"), F.when(F.size("attachments") > 0, F.col("attachments")).alias("attachments")))
    if fmt == "xml":
        return F.concat(F.lit("<e"), _attrs(id=_text("id"), **{"from": _text("sender")}, subject=_text("subject"),
                                            date=_text("date"), size=_size()),
                        F.lit(">\n"), xml_text(_text("body")), F.lit("\n</e>"))
    head = _pipe(F.col("source"), F.col("sender"), F.col("subject"), F.col("date"), F.col("id"), _size())
    return F.concat_ws("\n\n", head, F.nullif("body", F.lit("")))


def _thread_heads(messages: DataFrame) -> DataFrame:
    heads = threads.thread_headers(messages)
    line = F.concat(_pipe(F.lit("THREAD"), F.col("thread_id"), F.col("subject"), F.col("message_count")), F.lit(" msgs"))
    return heads.select("thread_id", "subject", "message_count", F.lit(0).cast("bigint").alias("idx"), line.alias("line"))


def full_threads(messages: DataFrame, fmt: str = "pipe") -> DataFrame:
    """``(thread_id, idx, line)``: a head per thread and an entry per message.

    Entries are numbered by position, so a thread of any length is written in order without
    being gathered. XML ends with an entry past the last message.
    """
    fmt = format_name(fmt)
    rows = threads.in_thread(messages)
    idx = F.col("idx").cast("bigint").alias("idx")
    heads = _thread_heads(messages)
    if fmt == "pipe":
        entry = F.concat_ws("\n", F.lit("---"), _pipe(F.col("sender"), F.col("date")), F.nullif("body", F.lit("")))
        return heads.select("thread_id", "idx", "line").unionByName(rows.select("thread_id", idx, entry.alias("line")))
    if fmt == "json":
        entry = F.to_json(F.struct(_text("sender").alias("from"), _text("date").alias("date"), _text("body").alias("body"),
                                   F.nullif("subject", F.lit("")).alias("subject")))
        head = F.to_json(F.struct("thread_id", "subject", "message_count"))
        return heads.select("thread_id", "idx", head.alias("line")).unionByName(rows.select("thread_id", idx, entry.alias("line")))
    entry = F.concat(F.lit("<m"), _attrs(**{"from": _text("sender")}, date=_text("date")), F.lit(">\n"),
                     xml_text(_text("body")), F.lit("\n</m>"))
    head = F.concat(F.lit("<thread"), _attrs(id=F.col("thread_id"), subject=F.col("subject"),
                                             count=F.col("message_count").cast("string")), F.lit(">"))
    ends = heads.select("thread_id", (F.col("message_count") + 1).alias("idx"), F.lit("</thread>").alias("line"))
    return heads.select("thread_id", "idx", head.alias("line")).unionByName(
        rows.select("thread_id", idx, entry.alias("line"))).unionByName(ends)


def transcripts(messages: DataFrame) -> DataFrame:
    """``(thread_id, idx, line)``: one short line per message.

    The date shows on the first message of a day, with the year where the thread spans
    years; senders are tokens; bodies are one line.
    """
    marked = threads.day_marks(messages)
    years = marked.groupBy("thread_id").agg((dates.precision_of(F.col("date")) == "year").alias("years"))
    tokens = threads.sender_tokens(marked)
    rows = number_in_groups(marked, ["thread_id"], [F.coalesce("date", F.lit("")), F.col("seq")], "idx")
    rows = rows.withColumn("sender", _text("sender")).join(years, "thread_id").join(tokens, ["thread_id", "sender"])
    at = dates.parse_iso(F.col("date"))
    clock = F.date_format(at, "HH:mm")
    day = F.when(F.col("years"), F.date_format(at, "d MMM yy")).otherwise(F.date_format(at, "d MMM"))
    stamp = F.coalesce(F.when(F.col("new_day"), F.concat(day, F.lit(" "), clock)).otherwise(clock), _text("date"))
    line = F.concat(F.lit("|"), stamp, F.lit("|"), "token", F.lit("|"), flat_body(_text("body")), F.lit("|"))
    return _thread_heads(messages).select("thread_id", "idx", "line").unionByName(
        rows.select("thread_id", F.col("idx").cast("bigint").alias("idx"), line.alias("line")))


def _range() -> Column:
    return F.when(F.col("date_start") != "", F.concat("date_start", F.lit(".."), "date_end")).otherwise("")


def overview_top(sources: DataFrame, senders: DataFrame, fmt: str = "pipe") -> DataFrame:
    """``(source, part, line)`` of the top view; at most five senders per source are listed."""
    fmt = format_name(fmt)
    sep = ", " if fmt == "pipe" else " "
    listed = senders.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("rank", "name", "count"))).alias("s"))
    names = F.array_join(F.transform("s", lambda x: F.concat(x["name"], F.lit("("), x["count"].cast("string"), F.lit(")"))), sep)
    rows = sources.join(listed, "source", "left").withColumn("top", F.coalesce(names, F.lit("")))
    total, n = sources.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count_if(F.col("count") > 0)).first()
    none = F.lit(None).cast("array<struct<label:string,count:bigint,link:string>>")
    rows = rows if "meters" in rows.columns else rows.withColumn("meters", none)
    if fmt == "json":
        item = F.to_json(F.struct(F.col("source").alias("prefix"), "label", "count", "date_start", "date_end", F.transform(
            "s", lambda x: F.struct(x["name"].alias("name"), x["count"].alias("count"))).alias("top_senders"), "meters"))
        head = F.to_json(F.struct(F.lit("top").alias("level"), F.lit(total).alias("total"), F.lit(n).alias("source_count")))
        body = rows.select("source", F.lit(0).cast("bigint").alias("part"), item.alias("line"))
    elif fmt == "xml":
        meters = F.array_join(F.transform("meters", lambda m: F.concat(m["label"], F.lit("("), m["count"].cast("string"), F.lit(")"))), " ")
        line = F.concat(F.lit("<src"), _attrs(
            prefix=F.col("source"), label=F.col("label"), count=F.col("count").cast("string"),
            range=F.concat("date_start", F.lit(".."), "date_end"), top=F.col("top")),
            F.when(F.size("meters") > 0, F.concat(F.lit(" meters="), xml_attr(meters))).otherwise(""), F.lit("/>"))
        head = F.lit(f'<overview level="top" total="{total}" sources="{n}">')
        body = rows.select("source", F.lit(0).cast("bigint").alias("part"), line.alias("line"))
    else:
        line = _pipe(F.col("source"), F.col("label"), F.concat(F.col("count").cast("string"), F.lit(" msgs")), _range(),
                     F.concat(F.lit("top: "), "top"))
        head = F.lit(f"Overview: {n} sources, {total} messages cached")
        meter = rows.select("source", F.posexplode("meters").alias("p", "m")).select(
            "source", (F.col("p") + 1).cast("bigint").alias("part"), F.concat(
                F.lit("  meter: "), "m.label", F.lit("="), F.col("m.count").cast("string"),
                F.when(F.coalesce("m.link", F.lit("")) != "", F.concat(F.lit(" ("), "m.link", F.lit(")"))).otherwise("")).alias("line"))
        body = rows.select("source", F.lit(0).cast("bigint").alias("part"), line.alias("line")).unionByName(meter)
    top = sources.sparkSession.range(1).select(F.lit("").alias("source"), F.lit(-1).cast("bigint").alias("part"), head.alias("line"))
    return top.unionByName(body)


def overview_drill(parts: dict[str, DataFrame], name: str, fmt: str = "pipe") -> DataFrame:
    """``(part, rank, line)`` of a source or contact view, by the tables it comes with."""
    fmt = format_name(fmt)
    zero = F.lit(0).cast("bigint")
    by_contact = "periods" in parts
    sources = parts["sources"]

    def rows(df, part, rank, pipe, xml):
        return df.select(F.lit(part).cast("bigint").alias("part"), rank.cast("string").alias("rank"),
                         (F.to_json(F.struct(*df.columns)) if fmt == "json" else xml if fmt == "xml" else pipe).alias("line"))

    def tag(kind, **values):
        return F.concat(F.lit(f"<{kind}"), _attrs(**values), F.lit("/>"))

    n = F.col("count").cast("string") if "count" in sources.columns else zero
    total = sources.agg(F.coalesce(F.sum("count"), F.lit(0)).cast("string").alias("total"), F.count("*").cast("string").alias("n"),
                        F.max("label").alias("label"), F.min("date_start").alias("date_start"), F.max("date_end").alias("date_end"))
    msgs = F.concat(n, F.lit(" msgs"))
    level = "contact" if by_contact else "source"
    if fmt == "xml":
        head = F.concat(F.lit(f'<overview level="{level}"'), _attrs(**({"name": F.lit(name)} if by_contact else {
            "prefix": F.lit(name), "label": F.col("label")}), total=F.col("total")), F.lit(">"))
    elif by_contact:
        head = F.concat(F.lit(f"Overview: {name}, "), "total", F.lit(" messages across "), "n", F.lit(" sources"))
    else:
        head = F.concat(F.lit(f"Overview: {name} ("), "label", F.lit("), "), "total", F.lit(" messages, "), _range())
    out = rows(total, 0, F.lit("0"), head, head)
    if by_contact:
        span = F.when(_range() != "", F.concat(F.lit("|"), _range())).otherwise("")
        out = out.unionByName(rows(sources, 1, F.col("source"), F.concat(_pipe(F.col("source"), F.col("label"), msgs), span),
                                   tag("src", prefix=F.col("source"), label=F.col("label"), count=n)))
        out = out.unionByName(rows(parts["periods"], 2, F.col("period"), _pipe(F.col("period"), F.col("count")),
                                   tag("period", name=F.col("period"), count=F.col("count").cast("string"))))
        return out
    order = F.lpad(F.col("rank").cast("string"), 9, "0")
    out = out.unionByName(rows(parts["senders"], 1, order, _pipe(F.col("name"), msgs), tag("sender", name=F.col("name"), count=n)))
    return out.unionByName(rows(parts["threads"], 2, order, _pipe(F.col("subject"), msgs, F.col("thread_id")),
                                tag("thread", subject=F.col("subject"), count=n, id=F.col("thread_id"))))


def mailbox_stats(stats: DataFrame, sources: DataFrame, fmt: str = "pipe") -> DataFrame:
    """``(source, ord, line)`` of label counts; a source without any shows as offline."""
    fmt = format_name(fmt)
    known = sources.select(F.col("prefix").alias("source"), F.coalesce("provider", "prefix").alias("provider"))
    online = stats.groupBy("source").agg(F.count("*").alias("n"))
    heads = known.join(online, "source", "left")
    off = F.col("n").isNull()
    total, unread = F.col("total").cast("string"), F.col("unread").cast("string")
    if fmt == "json":
        head = F.when(off, F.to_json(F.struct("source", F.lit("offline").alias("error")))).otherwise(F.to_json(F.struct("source", "provider")))
        line = F.to_json(F.struct("name", "total", "unread"))
    elif fmt == "xml":
        head = F.concat(F.lit("<src"), _attrs(prefix=F.col("source")), F.when(off, F.lit(' error="offline"/>')).otherwise(
            F.concat(_attrs(provider=F.col("provider")), F.lit(">"))))
        line = F.concat(F.lit("<label"), _attrs(name=F.col("name"), total=total, unread=unread), F.lit("/>"))
    else:
        head = F.when(off, F.concat(F.lit("Mailbox ("), "source", F.lit("): (offline)"))).otherwise(
            F.concat(F.lit("Mailbox ("), "source", F.lit(", "), "provider", F.lit("):\n  LABEL|TOTAL|UNREAD")))
        line = F.concat(F.lit("  "), _pipe(F.col("name"), total, unread))
    return heads.select("source", F.lit(-1).alias("ord"), head.alias("line")).unionByName(stats.select("source", "ord", line.alias("line")))


def agenda_lines(events: DataFrame, tz: str, collapse: bool = False) -> DataFrame:
    """``(day, all_day_last, start, id, line)`` of an agenda, times as the reader's."""
    mode = events.agg(agenda.time_mode(tz)).first()[0]
    rows = agenda.collapse_recurring(events, tz) if collapse else events.withColumn("collapsed", F.lit(False))
    rows = _optional(rows, "recurrence_summary", "ref")
    clean = lambda c: F.translate(c, "|", "/")
    title = F.concat(clean(_text("title")), F.when(F.col("your_status") == "declined", F.lit(" (declined)")).otherwise(""))
    note = F.when(F.col("collapsed"), F.concat(F.lit("("), F.coalesce("recurrence_summary", F.lit("recurring")), F.lit(")")))
    people = F.concat_ws(" ", F.nullif("attendees_summary", F.lit("")), note)
    length = agenda.duration_text(F.col("all_day"), F.col("start"), F.col("end"), F.col("duration_minutes"))
    line = _pipe(F.coalesce(F.col("ref").cast("string"), F.lit("0")), F.col("source"), agenda.event_time(F.lit(mode), tz), length, title,
                 clean(_text("location")), people)
    order = [agenda.display_date(F.col("start"), tz).alias("day"), agenda.timed().cast("int").alias("clock"), "start", "id"]
    return rows.select(*order, line.alias("line"))


def event_detail(tz: str) -> Column:
    """One event in full, as small markup; empty parts are left out."""
    def part(name, value):
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>")))

    who = F.transform("attendees", lambda a: F.concat(F.lit("  "), F.coalesce(a["name"], a["email"], F.lit("")), F.lit(" ("), F.coalesce(a["status"], F.lit("")), F.lit(")")))
    people = F.when(F.size("attendees") > 0, F.concat(F.lit("<attendees>\n"), F.array_join(who, "\n"), F.lit("\n</attendees>")))
    return F.concat_ws(
        "\n", F.concat(F.lit('<ev ref="0" id="'), "id", F.lit('">')), F.concat(F.lit("<title>"), _text("title"), F.lit("</title>")),
        F.concat(F.lit("<when>"), agenda.when_detail(tz), F.lit("</when>")), part("where", F.col("location")),
        part("organizer", F.col("organizer")), part("your-status", F.col("your_status")), people,
        part("link", F.col("meeting_link")), part("recurrence", F.col("recurrence_summary")),
        part("description", F.col("description")), F.lit("</ev>"))


def document(lines: DataFrame, *order: str) -> DataFrame:
    """The lines of a bounded page as one text."""
    key = F.struct(*order, "line")
    return lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["line"]), "\n").alias("document"))


def write_lines(lines: DataFrame, path: str, *order: str) -> None:
    """Write lines in order to a text sink: the files, by name, follow each other."""
    lines.orderBy(*order).select("line").write.mode("overwrite").text(path)
