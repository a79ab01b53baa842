"""Secrets in texts, also where they are wrapped in other encodings.

Each text starts a list of layers to look at. A layer is scanned for secrets, and whatever
can be unwrapped in it becomes a further layer: percent escapes, Unicode escapes, base64
runs, and compressed data inside either. That goes on until nothing new comes up; a layer
that stands at the same place with the same content as one seen before is not opened again,
so data that unpack to themselves end. Every layer knows, for each of its characters, the
stretch of the text that it came from, so that what is found in it is a span of the text.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.llm.tables import pick

#: The kinds of secrets in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: A text without any of these has no assignment; looked for first, as that is quick.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Data that may be unpacked from one document, in bytes. Unpacking can grow without end, so it
#: needs a bound; what is left closed is counted in ``n_closed``.
OPEN_BYTES = 16 << 20

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPES = re.compile(
    r"\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}"
    r"|%u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|&\#[0-9]{1,7};|&\#[xX][0-9A-Fa-f]{1,6};|[！-～]")
#: An escape of an escape of an escape ...: all its levels but the last two say nothing more.
DEEP = re.compile(r"%(?:25){2,}|\\u005[cC](?:u005[cC])+|\\x5[cC](?:x5[cC])+|&\#38;(?:\#38;)+")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:\r?\n[A-Za-z0-9+/_-]{16,})*={0,2}")
LINES = re.compile(r"\r?\n")
PACKED_PERCENT = re.compile(r"(?:%1[fF]%8[bB]|(?:x|%78)%(?:01|5[eE]|9[cC]|[dD][aA]))(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~/+-])*")


@dataclass
class Layer:
    """A text, and for each character where its source begins and ends; None for the text itself."""

    text: str
    low: np.ndarray | None
    high: np.ndarray | None
    path: str

    def source(self, start: int, end: int) -> tuple[int, int]:
        if self.low is None:
            return start, end
        return int(self.low[start]), int(self.high[end - 1])

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        if self.low is None:
            return np.arange(len(self.text)), np.arange(1, len(self.text) + 1)
        return self.low, self.high


def matches(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the secrets that stand in a text as they are."""
    low = text.lower()
    if any(name in low for name in NAMES):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= ASSIGN_LEAST:
                yield "assign", *m.span()
    for m in ACCESS.finditer(text):
        yield "access", *m.span()
    for m in HEX.finditer(text):
        yield "hex", *m.span()


def _percent(found: str) -> list[tuple[str, int, int]]:
    """Characters of a run of percent escapes with their place in it: UTF-8 if valid, else bytes."""
    data = bytes.fromhex(found.replace("%", ""))
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return [(chr(b), 3 * i, 3 * i + 3) for i, b in enumerate(data)]
    out, at = [], 0
    for c in text:
        size = 3 * len(c.encode())
        out.append((c, at, at + size))
        at += size
    return out


def _escape(found: str) -> list[tuple[str, int, int]]:
    if len(found) == 1:
        code = ord(found) - 0xFEE0
    elif len(found) == 12 and found.startswith("\\u") and found[6:8] == "\\u":
        code = 0x10000 + ((int(found[2:6], 16) - 0xD800) << 10) + int(found[8:12], 16) - 0xDC00
    elif found.startswith("&"):
        code = int(found[3:-1], 16) if found[2] in "xX" else int(found[2:-1])
    else:
        code = int(found[2:].strip("{}"), 16)
    if code > 0x10FFFF or 0xD800 <= code < 0xE000:
        return [(c, i, i + 1) for i, c in enumerate(found)]
    return [(chr(code), 0, len(found))]


def _deep(found: str) -> list[tuple[str, int, int]]:
    size = {"%": 3, "\\": 6 if found[1] == "u" else 4, "&": 5}[found[0]]
    return [(c, i, len(found) if i == size - 1 else i + 1) for i, c in enumerate(found[:size])]


def _replaced(layer: Layer, pattern: re.Pattern, decode, name: str) -> Layer | None:
    """The layer with all that ``pattern`` finds decoded; None if that changes nothing."""
    texts, lows, highs, at = [], [], [], 0
    low, high = layer.bounds()
    for m in pattern.finditer(layer.text):
        chars = decode(m[0])
        texts += [layer.text[at:m.start()], "".join(c for c, _, _ in chars)]
        lows += [low[at:m.start()], low[np.array([a for _, a, _ in chars], np.int64) + m.start()]]
        highs += [high[at:m.start()], high[np.array([b for _, _, b in chars], np.int64) + m.start() - 1]]
        at = m.end()
    if not texts:
        return None
    texts.append(layer.text[at:])
    text = "".join(texts)
    if text == layer.text:
        return None
    return Layer(text, np.concatenate([*lows, low[at:]]), np.concatenate([*highs, high[at:]]), f"{layer.path}>{name}" if layer.path else name)


def _packed(data: bytes) -> str | None:
    """How the data are compressed, by their first bytes."""
    if data[:3] == b"\x1f\x8b\x08":
        return "gzip"
    if len(data) > 2 and data[0] == 0x78 and (data[0] << 8 | data[1]) % 31 == 0:
        return "zlib"
    if data[:3] == b"BZh" and data[3:4].isdigit():
        return "bzip2"
    return "xz" if data[:6] == b"\xfd7zXZ\x00" else None


class _Room:
    """What a document may still unpack, and what did not fit."""

    def __init__(self, size: int):
        self.left, self.closed = size, 0

    def unpack(self, data: bytes, kind: str) -> bytes | None:
        """The content of compressed data; None if they are damaged or do not fit."""
        machine = {"gzip": lambda: zlib.decompressobj(31), "zlib": lambda: zlib.decompressobj(15), "bzip2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor}[kind]()
        try:
            out = machine.decompress(data, self.left + 1)
        except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
            return None
        if len(out) > self.left:
            self.closed += 1
            return None
        if not machine.eof:
            return None
        self.left -= len(out)
        return out


def _legible(data: bytes) -> str | None:
    """The data as text, if they are UTF-8 without control characters other than white space."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return None if re.search(r"[\x00-\x08\x0E-\x1F\x7F]", text) else text


def _contents(data: bytes, place: tuple[int, int], room: _Room, path: str, seen: set) -> Iterator[tuple[str, str, bool]]:
    """(text, path, whether it was packed) of data that are text, or become so when unpacked."""
    packed = False
    while kind := _packed(data):
        mark = (*place, hashlib.sha256(data).digest())
        if mark in seen:
            return
        seen.add(mark)
        inner = room.unpack(data, kind)
        if inner is None:
            break
        data, path, packed = inner, f"{path}>{kind}", True
    text = _legible(data)
    if text:
        yield text, path, packed


def _at_place(text: str, place: tuple[int, int], path: str) -> Layer:
    """Unpacked text: each of its characters comes from all of the packed data."""
    low, high = (np.broadcast_to(np.int64(x), len(text)) for x in place)
    return Layer(text, low, high, path)


def _base64_layers(layer: Layer, room: _Room, seen: set) -> Iterator[Layer]:
    low, high = layer.bounds()
    for m in BASE64.finditer(layer.text):
        runs = [m.span()]
        if LINES.search(m[0]):
            # Several lines: one wrapped run, or runs that happen to follow each other.
            runs += [(m.start() + a.start(), m.start() + a.end()) for a in re.finditer(r"[^\r\n]+", m[0])]
        for start, end in runs:
            run = layer.text[start:end]
            inside = [i for i, c in enumerate(run) if c not in "\r\n="]
            body = "".join([run[i] for i in inside])
            if len(body) % 4 == 1 or (("-" in body or "_" in body) and ("+" in body or "/" in body)):
                continue
            try:
                data = base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4))
            except (binascii.Error, ValueError):
                continue
            place = layer.source(start, end)
            for text, path, packed in _contents(data, place, room, f"{layer.path}>base64" if layer.path else "base64", seen):
                if packed:
                    yield _at_place(text, place, path)
                    continue
                # Byte i of the data lies in the characters from 4i/3 to 4(i+1)/3.
                sizes = np.array([len(c.encode()) for c in text])
                last = np.cumsum(sizes)
                first = last - sizes
                at = np.array(inside) + start
                yield Layer(text, low[at[first * 4 // 3]], high[at[np.minimum(-(-last * 4 // 3), len(at)) - 1]], path)


def _packed_layers(layer: Layer, room: _Room, seen: set) -> Iterator[Layer]:
    for m in PACKED_PERCENT.finditer(layer.text):
        data = re.sub(rb"%([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), m[0].encode())
        place = layer.source(*m.span())
        for text, path, packed in _contents(data, place, room, f"{layer.path}>url" if layer.path else "url", seen):
            if packed:
                yield _at_place(text, place, path)


def _unwrapped(layer: Layer, room: _Room, seen: set) -> Iterator[Layer]:
    """All layers directly under one."""
    text = layer.text
    if DEEP.search(text):
        layer = _replaced(layer, DEEP, _deep, "same") or layer
        layer.path = layer.path.removesuffix("same").removesuffix(">")
        text = layer.text
    if "%" in text:
        yield from _packed_layers(layer, room, seen)
        if found := _replaced(layer, PERCENT, _percent, "url"):
            yield found
    if found := _replaced(layer, ESCAPES, _escape, "unicode"):
        yield found
    yield from _base64_layers(layer, room, seen)


def find(text: str, open_bytes: int = OPEN_BYTES) -> tuple[list[tuple[str, int, int, str, str]], int]:
    """(kind, start, end, layers, value) of all secrets of one text, and the number of data left closed.

    ``layers`` is empty for what stands in the text as it is. A span found in several layers
    is listed once, by the layer that was opened first. In the order of start, kind and end.
    """
    room, seen, found = _Room(open_bytes), set(), {}
    waiting = deque([Layer(text, None, None, "")])
    while waiting:
        layer = waiting.popleft()
        for kind, start, end in matches(layer.text):
            found.setdefault((kind, *layer.source(start, end)), (layer.path, layer.text[start:end]))
        for inner in _unwrapped(layer, room, seen):
            if not inner.text:
                continue
            mark = (int(inner.low[0]), int(inner.high[-1]), hashlib.sha256(inner.text.encode("utf-8", "surrogatepass")).digest())
            if mark not in seen:
                seen.add(mark)
                waiting.append(inner)
    ordered = sorted(found.items(), key=lambda x: (x[0][1], KINDS.index(x[0][0]), x[0][2]))
    return [(*key, *value) for key, value in ordered], room.closed


SECRETS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("layers", pa.string()), ("value", pa.string())]))


def _scan(open_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, closed = [], []
            for text in batch.column("text"):
                secrets, n = find(text.as_py() or "", open_bytes)
                lists.append([dict(zip(("kind", "start", "end", "layers", "value"), s)) for s in secrets])
                closed.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lists, SECRETS), pa.array(closed, pa.int64())], names=["doc_id", "secrets", "n_closed"])

    return run


def secrets(docs: DataFrame, open_bytes: int = OPEN_BYTES) -> DataFrame:
    """(doc_id, secrets, n_closed) of every row of ``docs``.

    ``secrets`` lists kind, start, end (code points of the whole text, end exclusive), the
    layers it was found under, outermost first, and the secret as it reads there. ``n_closed``
    counts compressed data that would have unpacked to more than ``open_bytes`` a document.
    Null and empty texts have no secrets. Rows without doc_id and repeated rows are scanned
    like all others. Other columns are ignored; an empty table gives an empty result.
    """
    return pick(docs, "doc_id", "text").mapInArrow(
        _scan(open_bytes), "doc_id long, secrets array<struct<kind: string, start: long, end: long, layers: string, value: string>>, n_closed long")


def count_of(kind: str) -> Column:
    """Secrets of a kind that stand in the text as they are."""
    return F.size(F.filter("secrets", lambda s: (s["layers"] == "") & (s["kind"] == kind))).cast("long")


def spans(plain: bool = False) -> Column:
    """``kind:start:end`` of all secrets, or of those that stand in the text as they are."""
    chosen = F.filter("secrets", lambda s: s["layers"] == "") if plain else F.col("secrets")
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(docs: DataFrame, label: str = "[secret]", open_bytes: int = OPEN_BYTES) -> DataFrame:
    """(doc_id, text) with every secret's span replaced; spans that overlap are replaced as one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text"):
                text = text.as_py()
                parts, at = [], 0
                for _, start, end, _, _ in find(text or "", open_bytes)[0]:
                    if start >= at:
                        parts += [text[at:start], label]
                    at = max(at, end)
                out.append(text if text is None else "".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, text string")
