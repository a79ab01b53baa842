"""Mail payloads with a MIME tree."""

from __future__ import annotations

import base64
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.functions import dates
from letterloom.functions.headers import human_size
from letterloom.schema import ATTACHMENTS
from letterloom.session import spread
from letterloom.sources.landing import first_where, form, prefixed, text

# Levels of nested parts that column expressions walk; the few deeper trees are walked row by row.
DEPTH = 6
HEADERS = "headers:ARRAY<STRUCT<name:STRING,value:STRING>>"
BODY = "body:STRUCT<data:STRING,size:BIGINT,attachmentId:STRING>"


def _part(depth: int) -> str:
    parts = f"parts:ARRAY<{_part(depth - 1)}>" if depth else "parts:STRING"
    return f"STRUCT<mimeType:STRING,filename:STRING,{HEADERS},{BODY},{parts}>"


def message_type(depth: int = DEPTH) -> str:
    return (f"STRUCT<id:STRING,threadId:STRING,internalDate:STRING,labelIds:ARRAY<STRING>,"
            f"snippet:STRING,sizeEstimate:BIGINT,payload:{_part(depth)}>")


def header(headers: Column, name: str) -> Column:
    """The first header of that name, whatever its case; empty where there is none."""
    return text(first_where(headers, lambda h: F.lower(h["name"]) == name.lower())["value"])


# The tree is walked by nested array functions, written as SQL: one level per depth.

def _attached(part: str) -> str:
    disposition = f"get(filter({part}.headers, h -> lower(h.name) = 'content-disposition'), 0).value"
    return f"(coalesce({part}.filename, '') <> '' OR coalesce(lower({disposition}) LIKE 'attachment%', false))"


def _container(part: str) -> str:
    return f"(coalesce({part}.mimeType, '') LIKE '%multipart%' AND NOT {_attached(part)})"


def _decoded(part: str) -> str:
    return f"nullif(make_valid_utf8(CAST(unbase64(translate({part}.body.data, '-_', '+/')) AS STRING)), '')"


def _first(items: str) -> str:
    return f"get(filter({items}, x -> x IS NOT NULL), 0)"


def _pick(parts: str, mime: str, found, depth: int) -> str:
    """What ``found`` gives for the first part of a type: this level first, then its containers."""
    here = _first(f"transform(filter({parts}, p -> p.mimeType = '{mime}' AND NOT {_attached('p')}), p -> {found('p')})")
    if not depth:
        return here
    below = _first(f"transform(filter({parts}, c -> {_container('c')}), c -> {_pick('c.parts', mime, found, depth - 1)})")
    return f"coalesce({here}, {below})"


def body_text(payload: str, prefer_html: bool = False, depth: int = DEPTH) -> Column:
    """The body of a MIME tree: the preferred type anywhere in it, else the other one."""
    types = ("text/html", "text/plain") if prefer_html else ("text/plain", "text/html")
    leaf = f"CASE WHEN coalesce({payload}.mimeType, '') NOT LIKE '%multipart%' THEN {_decoded(payload)} END"
    picks = ", ".join(_pick(f"{payload}.parts", t, _decoded, depth - 1) for t in types)
    return F.expr(f"coalesce({leaf}, {picks}, '')")


def external_body(payload: str, mime: str, depth: int = DEPTH) -> Column:
    """Id of the part that holds the body of a type when its data was left out."""
    def found(part):
        return f"CASE WHEN {part}.body.data IS NOT NULL OR {part}.body.attachmentId IS NOT NULL THEN struct({part}.body.data, {part}.body.attachmentId AS ref) END"

    return F.expr(f"transform(array({_pick(f'{payload}.parts', mime, found, depth - 1)}), x -> if(x.data IS NULL, x.ref, NULL))[0]")


def attachments(parts: str, depth: int = DEPTH - 1) -> str:
    """Name, type and size of every named part, in document order."""
    none = f"CAST(array() AS {ATTACHMENTS})"
    own = (f"if(coalesce(a.filename, '') <> '', array(struct(a.filename AS filename, coalesce(a.mimeType, '') AS mime_type, "
           f"coalesce(a.body.size, 0L) AS size)), {none})")
    if depth:
        inside = f"if(coalesce(a.mimeType, '') LIKE '%multipart%', {attachments('a.parts', depth - 1)}, {none})"
        own = f"concat({own}, {inside})"
    return f"coalesce(flatten(transform({parts}, a -> {own})), {none})"


def overflow(parts: str, depth: int = DEPTH - 1) -> str:
    """Whether parts lie deeper than the levels that are looked into."""
    inside = f"coalesce({overflow('o.parts', depth - 1)}, false)" if depth else "o.parts IS NOT NULL"
    return f"coalesce(exists({parts}, o -> {inside}), false)"


def _parts(part: dict) -> list[dict]:
    """The parts of a part; those below ``DEPTH`` are still JSON text."""
    parts = part.get("parts") or []
    return json.loads(parts) if isinstance(parts, str) else parts


def _is_attached(part: dict) -> bool:
    disposition = next((h.get("value") for h in part.get("headers") or [] if (h.get("name") or "").lower() == "content-disposition"), None)
    return bool(part.get("filename")) or (disposition or "").lower().startswith("attachment")


def walk_deep(payload: str | None, prefer_html: bool) -> dict | None:
    """Body and attachments of one tree of any depth, by the order of the expressions above."""
    if payload is None:
        return None
    tree, body = json.loads(payload), None
    for kind in ("text/html", "text/plain") if prefer_html else ("text/plain", "text/html"):
        levels = [_parts(tree)]
        while levels and body is None:
            level = levels.pop()
            for part in level:
                data = (part.get("body") or {}).get("data")
                if part.get("mimeType") == kind and data and not _is_attached(part):
                    body = base64.urlsafe_b64decode(data + "=" * (-len(data) % 4)).decode("utf-8", "replace") or None
                    if body is not None:
                        break
            levels += [_parts(c) for c in reversed(level) if "multipart" in (c.get("mimeType") or "") and not _is_attached(c)]
    found, waiting = [], _parts(tree)[::-1]
    while waiting:
        part = waiting.pop()
        if part.get("filename"):
            found.append({"filename": part["filename"], "mime_type": part.get("mimeType") or "", "size": (part.get("body") or {}).get("size") or 0})
        if "multipart" in (part.get("mimeType") or ""):
            waiting += _parts(part)[::-1]
    return {"body": body or "", "attachments": found}


def deep(payload: Column, prefer_html: bool) -> Column:
    """``walk_deep`` in Arrow batches; rows that pass NULL cost nothing there."""
    @F.pandas_udf(f"STRUCT<body: STRING, attachments: {ATTACHMENTS}>")
    def walk(trees: pd.Series) -> pd.DataFrame:
        rows = [walk_deep(t, prefer_html) or {"body": None, "attachments": None} for t in trees]
        return pd.DataFrame(rows, columns=["body", "attachments"], dtype=object)

    return walk(payload)


def _columns(item: str, full: bool, prefer_html: bool, depth: int) -> dict[str, Column]:
    message = F.col(item)
    headers = message["payload"]["headers"]
    size = message["sizeEstimate"]
    out = {
        "id": prefixed(F.col("source"), message["id"]),
        "thread_id": prefixed(F.col("source"), message["threadId"]),
        "sender": header(headers, "from"),
        "subject": header(headers, "subject"),
        "date": dates.epoch_ms_iso(message["internalDate"]),
        "snippet": text(message["snippet"]),
        "unread": F.coalesce(F.array_contains(message["labelIds"], "UNREAD"), F.lit(False)),
        "labels": F.coalesce(message["labelIds"], F.array().cast("array<string>")),
        "size": F.when(size != 0, human_size(size)),
    }
    if full:
        out |= {
            "to": F.nullif(header(headers, "to"), F.lit("")),
            "cc": F.nullif(header(headers, "cc"), F.lit("")),
            "message_id": F.nullif(header(headers, "message-id"), F.lit("")),
            "body": F.coalesce("_deep.body", body_text(f"{item}.payload", prefer_html, depth)),
            "attachments": F.coalesce("_deep.attachments", F.expr(attachments(f"{item}.payload.parts", depth - 1))),
        }
    return out


def _with_deep(df: DataFrame, item: str, prefer_html: bool, depth: int) -> DataFrame:
    beyond = F.expr(overflow(f"{item}.payload.parts", depth - 1))
    return df.withColumn("_deep", deep(F.when(beyond, F.to_json(f"{item}.payload")), prefer_html))


def _select(df: DataFrame, full: bool, prefer_html: bool, depth: int, *keep: str) -> DataFrame:
    if full:
        df = _with_deep(df, "m", prefer_html, depth)
    return df.select("source", "seq", *keep, *[c.alias(n) for n, c in _columns("m", full, prefer_html, depth).items()])


def headers(raw: DataFrame) -> DataFrame:
    """Header rows; the part tree is not read."""
    kind = message_type(0)
    return _select(spread(raw).withColumn("m", F.from_json("payload", kind)), False, False, 0)


@form("gmail", message_type(), lambda payload: F.from_json(payload, message_type()), one=True)
def _item_columns(df: DataFrame, item: str) -> tuple[DataFrame, dict[str, Column]]:
    return _with_deep(df, item, False, DEPTH), _columns(item, True, False, DEPTH)


def messages(raw: DataFrame, prefer_html: bool = False, depth: int = DEPTH) -> DataFrame:
    """Full messages."""
    return _select(spread(raw).withColumn("m", F.from_json("payload", message_type(depth))), True, prefer_html, depth)


def thread_messages(raw: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Messages of thread payloads, numbered from 1, under the subject of the first."""
    kind = f"STRUCT<id:STRING,messages:ARRAY<{message_type(depth)}>>"
    threads = spread(raw).withColumn("t", F.from_json("payload", kind))
    rows = threads.select(
        "source", "seq", F.col("t.id").alias("_thread"), F.col("t.messages")[0]["payload"]["headers"].alias("_first"),
        F.size("t.messages").cast("bigint").alias("message_count"), F.posexplode("t.messages").alias("pos", "m"))
    return _select(rows, True, False, depth, "_thread", "_first", "pos", "message_count").withColumns({
        "thread_id": prefixed(F.col("source"), F.col("_thread")),
        "thread_subject": header(F.col("_first"), "subject"),
        "idx": (F.col("pos") + 1).cast("bigint"),
    }).drop("_thread", "_first", "pos")
