"""Chat payloads: newline-delimited JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.functions.headers import either
from letterloom.functions.patterns import GROUP_DOMAIN
from letterloom.operators.lookups import aliases
from letterloom.sources.landing import form, prefixed, text

MESSAGE = ("STRUCT<id:STRING,timestamp:STRING,sender_jid:STRING,sender_name:STRING,chat_jid:STRING,"
           "chat_name:STRING,content:STRING,is_from_me:BOOLEAN,media_type:STRING>")
CHAT = "STRUCT<jid:STRING,name:STRING,last_message_time:STRING,last_message:STRING>"


def _lines(payload: Column) -> Column:
    """The lines that are JSON."""
    return F.filter(F.split(payload, r"\r?\n"), lambda line: (F.trim(line) != "") & F.try_parse_json(line).isNotNull())


def items(raw: DataFrame, kind: str) -> DataFrame:
    """The values of every line; arrays are spread, blank and broken lines dropped."""
    lines = raw.select("source", "seq", F.posexplode(F.split("payload", r"\r?\n")).alias("line_no", "line"))
    valid = lines.where((F.trim("line") != "") & F.try_parse_json("line").isNotNull())
    return valid.select("source", "seq", "line_no",
                        F.posexplode(F.from_json("line", f"ARRAY<{kind}>")).alias("pos", "m"))


def iso(stamp: Column) -> Column:
    stamp = text(stamp)
    return F.when(stamp.contains("T"), stamp).otherwise(F.regexp_replace(stamp, "^([^ ]*) ", "$1T"))


def _columns(m: Column) -> dict[str, Column]:
    return {
        "id": prefixed(F.col("source"), m["id"]), "sender": text(m["sender_name"]), "sender_jid": text(m["sender_jid"]),
        "subject": text(m["chat_name"]), "date": iso(m["timestamp"]), "body": text(m["content"]),
        "is_from_me": F.coalesce(m["is_from_me"], F.lit(False)), "chat_jid": F.nullif(text(m["chat_jid"]), F.lit("")),
        "media_type": m["media_type"]}


def _rows(found: DataFrame, *keep: str) -> DataFrame:
    return found.select("source", "seq", "line_no", "pos", *keep, *[c.alias(n) for n, c in _columns(F.col("m")).items()])


def _name(sender: Column, jid: Column, chat: Column, alias: Column) -> Column:
    """The sender, or what stands for a missing one: alias, chat name of a two-person chat, identifier."""
    fallback = F.when((chat != "") & ~jid.endswith(GROUP_DOMAIN), chat).otherwise(jid)
    return F.when((sender == "") & (jid != ""), F.coalesce(alias, fallback)).otherwise(sender)


def named(rows: DataFrame, contacts: DataFrame | None = None) -> DataFrame:
    """Fill in missing sender names; aliases come from the contact map, if there is one."""
    jid = F.col("sender_jid")
    alias = F.lit(None).cast("string")
    if contacts is not None:
        known = aliases(contacts).select(F.col("identifier").alias("_key"), F.col("alias").alias("_alias"))
        rows = rows.join(known, F.concat("source", F.lit(":"), jid) == F.col("_key"), "left")
        alias = F.col("_alias")
    return rows.withColumn("sender", _name(F.col("sender"), jid, F.col("subject"), alias)).drop("_key", "_alias")


def messages(raw: DataFrame, contacts: DataFrame | None = None) -> DataFrame:
    return named(_rows(items(raw, MESSAGE)), contacts)


def _items(payload: Column) -> Column:
    lists = F.transform(_lines(payload), lambda line: F.from_json(line, f"ARRAY<{MESSAGE}>"))
    return F.flatten(F.filter(lists, lambda found: found.isNotNull()))


@form("whatsapp", MESSAGE, _items, json=False)
def _item_columns(df: DataFrame, item: str) -> tuple[DataFrame, dict[str, Column]]:
    """Messages without a contact map at hand, in payload order."""
    c = _columns(F.col(item))
    return df, c | {"sender": _name(c["sender"], c["sender_jid"], c["subject"], F.lit(None).cast("string"))}


def chats(raw: DataFrame) -> DataFrame:
    """Chats as rows."""
    m = F.col("m")
    name = either(m["name"], m["jid"])
    return items(raw, CHAT).select(
        "source", "seq", prefixed(F.col("source"), m["jid"]).alias("id"), name.alias("sender"), name.alias("subject"),
        iso(m["last_message_time"]).alias("date"), text(m["last_message"]).alias("body"),
        text(m["jid"]).endswith(GROUP_DOMAIN).alias("is_group"))


def contexts(raw: DataFrame) -> DataFrame:
    """Messages of context payloads: those before in reverse, the target, those after."""
    kind = f"STRUCT<message:{MESSAGE},before:ARRAY<{MESSAGE}>,after:ARRAY<{MESSAGE}>>"
    none = F.array().cast(f"ARRAY<{MESSAGE}>")
    found = raw.withColumn("c", F.from_json("payload", kind)).where("c.message IS NOT NULL")
    ordered = F.concat(F.reverse(F.coalesce("c.before", none)), F.array("c.message"), F.coalesce("c.after", none))
    rows = found.select("source", "seq", F.lit(0).alias("line_no"), F.posexplode(ordered).alias("pos", "m"),
                        prefixed(F.col("source"), F.col("c.message.chat_jid")).alias("thread_id"))
    return named(_rows(rows, "thread_id")).withColumn("idx", F.col("pos") + 1)
