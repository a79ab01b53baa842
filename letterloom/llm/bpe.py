"""Byte-level BPE: whole texts to token ids and back.

A text is cut into pieces by a pattern, and each piece is merged on its own. A segment tree
over the byte positions of a piece holds, at leaf i, the rank of the pair that begins at i
together with i, so its root is the leftmost pair of least rank. A merge changes three leaves
(the pair itself, the token that went, and the pair before) and their ancestors, which is
logarithmic in the length of the piece. Short pieces of a run are worked on side by side, a
row of one array each; long ones have a tree to themselves.

Pieces seen before are looked up. The table of a worker is emptied when it is full, which
costs time only.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from letterloom.llm import words as W
from letterloom.llm.tables import pick

#: Fixed value: the pattern of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same for texts of ASCII and Latin-1 letters only, where the classes are short lists.
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_OTHER = re.compile(f"[^\\t-\\r -~{_LATIN}]")
_FAST = re.compile(f" ?[{_LATIN}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\\t-\\r 0-9{_LATIN}]+|[\\t-\\r ]+(?![^\\t-\\r ])|[\\t-\\r ]+")

CACHE = 300_000
ROW_BYTES = 64


class Coder:
    """Ranks with their pair table, and the pieces known so far."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        self.tokens: dict[int, bytes] = {}
        for line in ranks.splitlines():
            if line.strip():
                token, rank = line.split()
                self.tokens[int(rank)] = base64.b64decode(token)
        self.ranks = {t: i for i, t in self.tokens.items()}
        pairs = [(self.ranks[t[:k]] << 32 | self.ranks[t[k:]], i) for t, i in self.ranks.items()
                 for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        self.pairs = dict(pairs)
        table = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.pair_keys, self.pair_ranks = np.ascontiguousarray(table[:, 0]), np.ascontiguousarray(table[:, 1])
        self.bytes = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.plain = pattern == PATTERN
        self.pattern = regex.compile(pattern)
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        if self.plain and not _OTHER.search(text):
            return _FAST.findall(text)
        return self.pattern.findall(text)

    def learn(self, pieces: Iterable[list[str]]) -> None:
        """Encode all pieces that are not known yet."""
        new = set().union(*pieces)
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for piece in new.difference(self.known):
            raw = piece.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                self.known[piece] = rank.to_bytes(4, "little")
            elif len(raw) > ROW_BYTES:
                self.known[piece] = np.array(self._merge_one(raw), "<u4").tobytes()
            else:
                groups.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append((piece, raw))
        for width, rows in groups.items():
            for at in range(0, len(rows), 16_384):
                part = rows[at:at + 16_384]
                ids, ends = self._merge_rows([r for _, r in part], width)
                flat, begin = ids.astype("<u4").tobytes(), 0
                for (piece, _), end in zip(part, (4 * ends).tolist()):
                    self.known[piece] = flat[begin:end]
                    begin = end

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.pieces(t) for t in texts]
        self.learn(cut)
        return [b"".join(map(self.known.__getitem__, c)) for c in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, -1 where they do not merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def _merge_rows(self, raws: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and where each ends."""
        n = len(raws)
        sizes = np.array([len(r) for r in raws])
        data = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raws), np.uint8).reshape(n, width)
        place = np.arange(width)
        ids = np.where(place < sizes[:, None], self.bytes[data], -1)
        # One position more at the right, where the last token finds nothing to merge with.
        after = np.tile(np.arange(1, width + 1), (n, 1))
        before = np.tile(np.arange(-1, width), (n, 1))
        ids = np.concatenate([ids, np.full((n, 1), -1)], axis=1)
        none = np.iinfo(np.int64).max
        tree = np.full((n, 2 * width), none)
        tree[:, width:2 * width - 1] = self._keys(self._rank(ids[:, :-2], ids[:, 1:-1]), place[:-1], ids[:, 1:-1] >= 0)
        level = width // 2
        while level:
            tree[:, level:2 * level] = np.minimum(tree[:, 2 * level:4 * level:2], tree[:, 2 * level + 1:4 * level:2])
            level //= 2
        rows = np.flatnonzero(tree[:, 1] != none)
        while len(rows):
            key = tree[rows, 1]
            at = key & 0xFFFF
            gone = after[rows, at]
            follow = after[rows, gone]
            ids[rows, at] = key >> 16
            ids[rows, gone] = -1
            after[rows, at] = follow
            before[rows, follow] = at
            prior = before[rows, at]
            self._set(tree, rows, gone, np.full(len(rows), none), width)
            self._set(tree, rows, at, self._keys(self._rank(ids[rows, at], ids[rows, follow]), at, ids[rows, follow] >= 0), width)
            some = np.flatnonzero(prior >= 0)
            if len(some):
                r, p = rows[some], prior[some]
                self._set(tree, r, p, self._keys(self._rank(ids[r, p], ids[r, at[some]]), p, True), width)
            rows = rows[tree[rows, 1] != none]
        live = ids[:, :width] >= 0
        return ids[:, :width][live], np.cumsum(live.sum(axis=1))

    @staticmethod
    def _keys(rank: np.ndarray, place: np.ndarray, there: np.ndarray | bool) -> np.ndarray:
        return np.where((rank >= 0) & there, rank << 16 | place, np.iinfo(np.int64).max)

    @staticmethod
    def _set(tree: np.ndarray, rows: np.ndarray, leaf: np.ndarray, key: np.ndarray, width: int) -> None:
        """Point update of one leaf in each of the rows."""
        node = leaf + width
        tree[rows, node] = key
        while width > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            width >>= 1

    def _merge_one(self, raw: bytes) -> list[int]:
        """The same for one long piece."""
        n = len(raw)
        width = 1 << (n - 1).bit_length()
        shift = width.bit_length()
        mask, none, pairs = (1 << shift) - 1, 1 << 62, self.pairs
        ids = self.bytes[np.frombuffer(raw, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * width)

        def leaf(i: int) -> int:
            rank = pairs.get(ids[i] << 32 | ids[after[i]]) if after[i] < n else None
            return none if rank is None else rank << shift | i

        for i in range(n):
            tree[width + i] = leaf(i)
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, key: int) -> None:
            i += width
            tree[i] = key
            while i > 1:
                i >>= 1
                best = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == best:
                    return
                tree[i] = best

        while tree[1] != none:
            at = tree[1] & mask
            ids[at] = tree[1] >> shift
            gone = after[at]
            after[at] = after[gone]
            if after[at] < n:
                before[after[at]] = at
            put(gone, none)
            put(at, leaf(at))
            if before[at] >= 0:
                put(before[at], leaf(before[at]))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out


_CODERS: dict[bytes, Coder] = {}


def coder(ranks: bytes, pattern: str) -> Coder:
    """One coder a worker process; its tables take longer to make than a batch."""
    key = hashlib.sha256(ranks + pattern.encode()).digest()
    if key not in _CODERS:
        _CODERS[key] = Coder(ranks, pattern)
    return _CODERS[key]


def read_ranks(path: str) -> bytes:
    """A rank file: a token in base64 and its rank a line."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, ranks: bytes, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row; ``ids`` are little-endian unsigned 32-bit integers.

    Whole texts, without special tokens. A null or empty text has no tokens. Rows are judged
    one by one, so null ids and repeated rows need no rule; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(held.value, pattern)
        for batch in batches:
            for rows, _, _ in W.runs(batch):
                out = c.encode([t or "" for t in rows.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array([len(x) // 4 for x in out], pa.int64()), pa.array(out, pa.binary())],
                    names=["doc_id", "n_tokens", "ids"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks: bytes) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): the bytes of the tokens of each row; null ids are none."""
    held = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(held.value, PATTERN)
        for batch in batches:
            for at in range(0, len(batch), 256):
                rows = batch.slice(at, 256)
                out = pa.array([c.decode(x or b"") for x in rows.column("ids").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*rows.columns, out], names=["doc_id", "n_tokens", "ids", "decoded"])

    return pick(encoded, "doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")
