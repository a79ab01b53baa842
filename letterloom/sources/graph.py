"""Office mail payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.functions.headers import either
from letterloom.sources.landing import FORMS, form, prefixed, rows_of, text

PERSON = "STRUCT<emailAddress:STRUCT<name:STRING,address:STRING>,name:STRING,address:STRING>"
MESSAGE = (
    f"STRUCT<id:STRING,conversationId:STRING,subject:STRING,`from`:{PERSON},"
    f"toRecipients:ARRAY<{PERSON}>,ccRecipients:ARRAY<{PERSON}>,receivedDateTime:STRING,"
    "bodyPreview:STRING,body:STRUCT<content:STRING>,hasAttachments:BOOLEAN,isRead:BOOLEAN,"
    "internetMessageId:STRING,categories:ARRAY<STRING>>")


def person(who: Column) -> Column:
    """``Name <address>``, or whichever of the two there is."""
    name = either(who["emailAddress"]["name"], who["name"])
    address = either(who["emailAddress"]["address"], who["address"])
    return F.when((name != "") & (address != ""), F.concat(name, F.lit(" <"), address, F.lit(">"))).otherwise(
        either(address, name))


def people(recipients: Column) -> Column:
    return F.nullif(F.array_join(F.transform(recipients, person), ", "), F.lit(""))


def _columns(m: Column) -> dict[str, Column]:
    return {
        "id": prefixed(F.col("source"), m["id"]),
        "thread_id": F.when(text(m["conversationId"]) != "", prefixed(F.col("source"), m["conversationId"])).otherwise(""),
        "sender": person(m["from"]),
        "subject": text(m["subject"]),
        "date": text(m["receivedDateTime"]),
        "snippet": text(m["bodyPreview"]),
        "has_attachments": F.coalesce(m["hasAttachments"], F.lit(False)),
        "unread": ~F.coalesce(m["isRead"], F.lit(True)),
    }


def headers(raw: DataFrame) -> DataFrame:
    """Header rows of list payloads, wrapped in ``value`` or bare; anything else is empty."""
    inner = F.coalesce(F.get_json_object("payload", "$.value"), F.col("payload"))
    lists = raw.withColumn("_list", F.when(F.ltrim(inner).startswith("["), inner))
    items = lists.select("source", "seq", F.posexplode(F.from_json("_list", f"ARRAY<{MESSAGE}>")).alias("pos", "m"))
    return items.select("source", "seq", "pos", *[c.alias(n) for n, c in _columns(F.col("m")).items()])


def _messages(payload: Column) -> Column:
    """The message of a payload, wrapped or not, as an array of one; none without an id."""
    def read(wrapped):
        return F.from_json(F.when(F.ltrim(wrapped).startswith("{"), wrapped).otherwise(payload), MESSAGE)

    one = F.transform(F.array(F.get_json_object(payload, "$.value")), read)
    return F.filter(one, lambda m: m["id"].isNotNull())


@form("o365", MESSAGE, _messages)
def _item_columns(df: DataFrame, item: str) -> tuple[DataFrame, dict[str, Column]]:
    m = F.col(item)
    return df, _columns(m) | {
        "body": either(m["body"]["content"], m["bodyPreview"]), "to": people(m["toRecipients"]), "cc": people(m["ccRecipients"]),
        "message_id": F.nullif(text(m["internetMessageId"]), F.lit("")), "labels": m["categories"]}


def messages(raw: DataFrame) -> DataFrame:
    """Full messages, each a payload of its own, wrapped or not."""
    return rows_of(raw, FORMS["o365"]).drop("pos")
