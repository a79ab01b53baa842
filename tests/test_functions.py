"""Text, header and date rules on single values."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from letterloom.functions import bodies, dates, headers
from letterloom.operators import agenda


def check(apply, function, table, kind="string"):
    assert apply(function, list(table), kind) == list(table.values())


def test_addresses(apply):
    check(apply, headers.address, {
        "Zoe <zoe@ACME.Example>": "zoe@acme.example", "zoe@ACME.org": "zoe@acme.org", "Zoe": "Zoe",
        '"<odd>" <Zoe@X.org>': "Zoe@x.org", "keep <>": "keep <>", "a <b@C.d> <>": "b@c.d", "a@b@C.d": "a@b@C.d",
        "open <zoe@x.org": "open <zoe@x.org", "< z@Y.org >": "z@y.org"})


def test_subjects(apply):
    check(apply, lambda c: headers.header("subject", c), {
        "Plan": "Plan", "RE: re:  Plan": "Re: Plan", "Fwd: Re: Plan": "Fwd: Plan", "fw:Plan": "Fwd: Plan",
        "Re: Fwd: Plan": "Re: Plan", "Regarding: Plan": "Regarding: Plan", "  two  words ": "two words", "Re:": "Re: "})


def test_mail_dates(apply):
    check(apply, dates.to_iso, {
        "Tue, 3 Mar 2026 09:05:00 +0100": "2026-03-03T08:05:00Z", "3 Mar 2026 09:05 GMT": "2026-03-03T09:05:00Z",
        "Tue, 03 Mar 2026 09:05:00 -0500 (EST)": "2026-03-03T14:05:00Z", "3 Mar 2026 09:05:00 PST": "2026-03-03T17:05:00Z",
        "2026-03-03T09:05:00+05:30": "2026-03-03T03:35:00Z", "2026-03-03 09:05:00": "2026-03-03T09:05:00Z",
        "2026-03-03": "2026-03-03T00:00:00Z", "2026-03-03T09:05:00Z": "2026-03-03T09:05:00Z", "next week": "next week", "": ""})


def test_zones_and_summer_time(spark):
    rows = [("2027-10-31T02:10:00", "Europe/Berlin", "2027-10-31T00:10:00+00:00"), ("2027-03-28T02:10:00", "Europe/Berlin", "2027-03-28T01:10:00+00:00"),
            ("2026-03-10T09:00:00", "America/New_York", "2026-03-10T13:00:00+00:00"),
            ("2026-03-10T09:00:00Z", "America/New_York", "2026-03-10T09:00:00+00:00"),
            ("2026-03-10T09:00:00.250000+02:00", "UTC", "2026-03-10T07:00:00.250000+00:00"), ("noon", "UTC", "noon")]
    df = spark.createDataFrame(rows, "v string, z string, want string")
    for row in df.withColumn("got", dates.to_utc_iso(F.col("v"), F.col("z"))).collect():
        assert row.got == row.want


def test_stamps(apply):
    day = F.lit("day")
    check(apply, lambda c: dates.compact_stamp(c, day), {"2026-02-03T22:23:00Z": "3Feb 22:23", "later": "later"})
    check(apply, lambda c: dates.compact_stamp(c, F.lit("year")), {"2026-02-23T22:23:00Z": "23Feb26 22:23"})
    check(apply, lambda c: dates.date_span(c, F.lit("2026-02-20T01:00:00Z"), day), {
        "2026-02-18T22:00:00Z": "18Feb-20Feb", "2026-02-20T00:30:00Z": "20Feb 01:00", "": "20Feb 01:00"})
    check(apply, dates.quarter_label, {"2025-03-01": "2025-Q1", "2025-12": "2025-Q4", "2025-00": "2025-Q0", "2025": None, "2025-xx": None})


@pytest.mark.parametrize("period,bounds", [
    ("2025", ("2025-01", "2026-01")), ("2025-q4", ("2025-10", "2026-01")), ("2025-Q1", ("2025-01", "2025-04")),
    ("2025-12", ("2025-12", "2026-01")), ("2024-11..2025-02", ("2024-11", "2025-03")), ("soon", ("soon", "9999-99"))])
def test_periods(period, bounds):
    assert dates.period_bounds(period) == bounds


@pytest.mark.parametrize("since,bound", [
    ("2d", "2026-01-08T00:00:00Z"), ("6h", "2026-01-09T18:00:00Z"), ("1w", "2026-01-03T00:00:00Z"), ("all", None), (None, None),
    ("2026-01-01T12:00:00-04:00", "2026-01-01T16:00:00Z"), ("2026-01-01", "2026-01-01"), ("junk", "junk")])
def test_since(since, bound):
    assert dates.resolve_since(since, datetime(2026, 1, 10, tzinfo=timezone.utc)) == bound


def test_phones(apply):
    ok = "31612345678@s.whatsapp.net"
    check(apply, headers.phone_to_chat, {
        "+31 6 1234 5678": ok, "0031612345678": ok, "tel:+31-6-12345678": ok, "TEL:+31612345678;phone-context=x": ok,
        "0612345678": None, "tel:+31612345678;ext=9": None, "+31612345678 ext. 9": None, "+31612345678 x12": None,
        "+123456": None, "+1234567890123456": None, "": None})


def test_sizes(apply):
    check(apply, headers.human_size, {0: "0b", 999: "999b", 1000: "1kb", 2560: "2kb", 3584: "4kb", 999_999: "977kb", 1_000_000: "1mb", 2_621_440: "2mb"}, "long")


def test_pipe_fields(apply):
    check(apply, headers.snippet_field, {" a|b\r\nc ": "a/b c", "x" * 80: "x" * 80, "x" * 76 + "     yy": "x" * 76 + "..."})
    check(apply, headers.flat_body, {" a\n\n b|c ": "a b/c", "y" * 78: "y" * 77 + "..."})
    check(apply, headers.xml_attr, {'a"b': "'a\"b'", "a'b": '"a\'b"', "a\"'b": '"a&quot;\'b"', "<&>\n": '"&lt;&amp;&gt;&#10;"'})


def clean(spark, text, stage=bodies.clean_text):
    return stage(spark.createDataFrame([(text,)], "body string"), "body").first()[0]


@pytest.mark.parametrize("body,want", [
    ("Hi\n\nOn Mon, Jan 5, 2026 at 9:00 Bob wrote:\n> old", "Hi"),
    ("Hi\n**On Tue Jan 6 Bob wrote:**\nold", "Hi"),
    ("Hi\n-----Original Message-----\nold", "Hi"),
    ("Hi\nFrom: Bob\nSent: now\nTo: me\nSubject: x\nold", "Hi"),
    ("On call today, nobody wrote\nbye", "On call today, nobody wrote\nbye"),
    ("a\n> q\n>> q\n\nb", "a\n\nb"),
    ("Hi\n\nThanks,\nAnn", "Hi"),
    ("Hi\n-- \nAnn\nACME", "Hi"),
    ("Hi\nSent from my phone", "Hi"),
    ("Thanks for the fish", "Thanks for the fish"),
    ("Hi\nThis email is confidential and so on", "Hi"),
    ("\n".join(["Thanks,"] + [f"line {i}" for i in range(40)]), "\n".join(["Thanks,"] + [f"line {i}" for i in range(40)])),
    ("a\nTo unsubscribe click\nb", "a\n\nb"),
    ("a   \n\n\n\n\nb\t\n\n", "a\n\nb"),
    ("   \n ", ""),
])
def test_body_stages(spark, body, want):
    assert clean(spark, body) == want


def test_clean_up_is_idempotent(spark):
    text = "Hello\n\n\n\n> q\nbody  \n\nBest regards,\nAnn\n"
    once = clean(spark, text)
    assert clean(spark, once) == once == "Hello\n\nbody"


def test_html_detection(apply):
    check(apply, bodies.is_html, {"<p>x</p>": True, "from <ann@x.org>": False, "<A HREF='x'>y</A>": True, "1 < 2": False, "<!-- c -->": True})


def test_rules_in_words(apply):
    check(apply, agenda.rule_text, {"FREQ=DAILY": "daily", "FREQ=WEEKLY;BYDAY=MO,WE": "weekly on Mon+Wed", "FREQ=WEEKLY": "weekly",
                                    "FREQ=HOURLY": "FREQ=HOURLY", "": ""})
