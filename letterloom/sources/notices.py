"""Generic JSON notifications and the meters that come with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.functions import dates
from letterloom.functions.headers import either
from letterloom.schema import METERS, struct
from letterloom.sources.landing import FORMS, form, prefixed, rows_of, text

NOTICE = "STRUCT<id:STRING,date:STRING,source:STRING,subject:STRING,link:STRING,unread:BOOLEAN>"


def synthetic_id(source: Column, date: Column, subject: Column, link: Column) -> Column:
    """A stable id for a notice that has none."""
    basis = F.concat_ws("|", text(source), text(date), text(subject), text(link))
    return F.substring(F.sha2(basis, 256), 1, 12)


@form("http", NOTICE, lambda payload: F.from_json(payload, f"STRUCT<notifications:ARRAY<{NOTICE}>>")["notifications"])
def _item_columns(df: DataFrame, item: str) -> tuple[DataFrame, dict[str, Column]]:
    n = F.col(item)
    id_ = prefixed(F.col("source"), either(n["id"], synthetic_id(n["source"], n["date"], n["subject"], n["link"])))
    subject = F.when(text(n["source"]) != "", F.concat(n["source"], F.lit(": "), text(n["subject"]))).otherwise(text(n["subject"]))
    link = text(n["link"])
    return df, {
        "id": id_, "thread_id": id_, "sender": text(n["source"]), "subject": subject, "date": dates.to_iso(text(n["date"])),
        "link": link, "body": F.concat_ws("\n\n", subject, F.nullif(link, F.lit(""))), "snippet": F.lit(""),
        "unread": F.coalesce(n["unread"], F.lit(False))}


def notifications(raw: DataFrame) -> DataFrame:
    """Notices; each is a thread of its own, its body is its subject and link."""
    return rows_of(raw, FORMS["http"])


def meters(raw: DataFrame, polled_at: str = "polled_at") -> DataFrame:
    """One snapshot per poll; a payload whose meters are no list counts as an empty one."""
    kind = struct(METERS)["meters"].dataType.simpleString()
    value = F.get_json_object("payload", "$.meters")
    listed = F.from_json(F.when(F.ltrim(value).startswith("["), value), kind)
    return raw.select("source", F.col(polled_at).alias("polled_at"), F.coalesce(listed, F.from_json(F.lit("[]"), kind)).alias("meters"))
