"""Address-book text (vCard) as cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.functions.headers import address, either, strip
from letterloom.session import spread
from letterloom.sources.calendars import unescaped, unfold


def _values(name: str) -> Column:
    """Values of a property: any group prefix and parameters are looked past."""
    lines = F.filter("lines", lambda x: x.rlike(rf"(?i)^(?:[^:;]*\.)?{name}(?:;[^:]*)?:\s*\S"))
    return F.transform(lines, lambda x: F.substr(x, F.instr(x, F.lit(":")) + 1))


def _structured_name(value: Column) -> Column:
    """``prefix given additional family suffix`` of a structured name."""
    parts = F.regexp_extract_all(value, F.lit(r"(?s)((?:[^;\\]++|\\.|\\$)*)(?:;|$)"), F.lit(1))
    parts = F.transform(parts, lambda x: strip(unescaped(x)))
    ordered = F.array(*[F.coalesce(F.get(parts, F.lit(i)), F.lit("")) for i in (3, 1, 2, 0, 4)])
    return F.array_join(F.filter(ordered, lambda x: x != ""), " ")


def parse_cards(raw: DataFrame) -> DataFrame:
    """Cards of address-book text, each closed by its end line, numbered in payload order.

    ``seq`` of a card is ``seq`` of its payload and its place there.
    """
    chunks = F.split(unfold(F.col("payload")), r"(?im)^[ \t]*BEGIN:VCARD[ \t]*$")
    chunks = F.slice(chunks, F.lit(2), F.size(chunks))
    cards = spread(raw).select("seq", F.posexplode(chunks).alias("pos", "card")).where(
        F.col("card").rlike(r"(?im)^[ \t]*END:VCARD[ \t]*$"))
    body = F.regexp_replace("card", r"(?ims)^[ \t]*END:VCARD[ \t]*$.*", "")
    cards = cards.withColumn("lines", F.transform(F.split(body, "\n"), strip)).drop("card")
    full_name = strip(unescaped(F.try_element_at(_values("FN"), F.lit(-1))))
    names = F.filter(F.transform(_values("N"), _structured_name), lambda x: x != "")
    emails = F.transform(_values("EMAIL"), lambda x: address(strip(unescaped(x))))
    return cards.select(
        "seq", "pos", either(full_name, F.get(names, F.lit(0))).alias("display_name"),
        F.array_distinct(F.transform(_values("TEL"), strip)).alias("phones"),
        F.array_distinct(F.filter(emails, lambda x: x != "")).alias("emails"))
