"""Token counts that follow edits.

Each document has a segment tree over its pre-token pieces: leaves hold the length and the
token count of a piece, inner nodes the sums below them. Leaves are kept in a table, and the
trees of documents that are edited are built from there. An edit replaces a stretch of
characters. The piece that it begins in is found by walking down the tree, the pieces from a
little before it are cut and counted again until a cut of the old text is met, and only these
leaves and their ancestors change. Leaves sit in blocks, so that pieces can be put in and
taken out without moving the rest.

The pieces of the default pattern depend on a bounded context: what stands before a cut never
matters, and a piece reads at most one character past its end. Edits therefore begin again at
the piece before the one they touch, or further back where white space runs on.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterloom.llm import bpe
from letterloom.llm import words as W
from letterloom.llm.tables import pick, stored

BLOCK = 64


class Tree:
    """Pieces of one text with their token counts; sums of characters and tokens by subtree."""

    def __init__(self, coder: bpe.Coder, text: str, leaves: tuple[list[int], list[int]] | None = None):
        """The tree of a text; from its stored ``leaves`` without cutting or encoding anything."""
        self.coder, self.text = coder, text
        if leaves is None:
            pieces = coder.pieces(text)
            coder.learn([pieces])
            leaves = [len(p) for p in pieces], [len(coder.known[p]) // 4 for p in pieces]
        self.lengths, self.tokens = leaves
        self._build()

    def leaves(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of all pieces in order."""
        return [x for a, _ in self.blocks for x in a], [x for _, c in self.blocks for x in c]

    def _build(self) -> None:
        """Blocks of leaves, and a tree of sums over the blocks."""
        self.blocks = [(self.lengths[k:k + BLOCK], self.tokens[k:k + BLOCK]) for k in range(0, len(self.lengths), BLOCK)] or [([], [])]
        self.size = 1 << (len(self.blocks) - 1).bit_length()
        self.chars, self.sums = [0] * (2 * self.size), [0] * (2 * self.size)
        for k, (a, b) in enumerate(self.blocks):
            self.chars[self.size + k], self.sums[self.size + k] = sum(a), sum(b)
        for k in range(self.size - 1, 0, -1):
            self.chars[k], self.sums[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.sums[2 * k] + self.sums[2 * k + 1]
        del self.lengths, self.tokens

    @property
    def total(self) -> int:
        return self.sums[1]

    def _find(self, at: int) -> tuple[int, int]:
        """Block that holds character ``at``, and where the block begins."""
        node, begin = 1, 0
        while node < self.size:
            node *= 2
            if at - begin >= self.chars[node] and self.chars[node + 1]:
                begin += self.chars[node]
                node += 1
        return node - self.size, begin

    def _put(self, block: int) -> None:
        node = block + self.size
        self.chars[node], self.sums[node] = sum(self.blocks[block][0]), sum(self.blocks[block][1])
        node >>= 1
        while node:
            self.chars[node], self.sums[node] = self.chars[2 * node] + self.chars[2 * node + 1], self.sums[2 * node] + self.sums[2 * node + 1]
            node >>= 1

    def _cuts(self, at: int) -> Iterator[tuple[int, int, int]]:
        """(block, leaf, first character) of each piece from the block of ``at`` on."""
        block, begin = self._find(at)
        for b in range(block, len(self.blocks)):
            for leaf, size in enumerate(self.blocks[b][0]):
                yield b, leaf, begin
                begin += size

    def replace(self, start: int, end: int, new: str) -> None:
        """Characters ``start`` to ``end`` become ``new``."""
        old = self.text
        start = min(max(start, 0), len(old))
        end = min(max(end, start), len(old))
        # Begin at a cut before the edit: where the piece before the touched one begins and no
        # white space lies right before it.
        back = max(start - 1, 0)
        while True:
            block, begin = self._find(back)
            for size in self.blocks[block][0]:
                if begin + size > back:
                    break
                begin += size
            if begin == 0 or not old[begin - 1].isspace():
                break
            back = begin - 1
        if begin:
            back, (block, first) = begin - 1, self._find(begin - 1)
            begin = first
            for size in self.blocks[block][0]:
                if begin + size > back:
                    break
                begin += size
        first_block, leaf0, shift = block, None, len(new) - (end - start)
        cuts = self._cuts(begin)
        place = next(((b, k, at) for b, k, at in cuts if at >= begin), None)
        if place is not None:
            first_block, leaf0 = place[0], place[1]
        self.text = old[:start] + new + old[end:]
        # Cut the new text from there in growing stretches until a new cut meets an old one.
        reach = end + shift + 64
        while True:
            stretch = self.text[begin:reach]
            pieces = self.coder.pieces(stretch)
            whole = begin + len(stretch) >= len(self.text)
            ends, at = [], begin
            for p in pieces:
                at += len(p)
                ends.append(at)
            # The last pieces of a stretch that goes on may be cut short, or be white space
            # whose end depends on what follows.
            usable = len(ends) if whole else max(len(ends) - 3, 0)
            olds = set()
            for _, _, at in self._cuts(begin):
                if at > end and at > begin:
                    olds.add(at)
                if at > reach - shift:
                    break
            meet = next((k for k in range(usable) if ends[k] >= start + len(new) + 1 and ends[k] - shift in olds), None)
            if meet is not None or whole:
                break
            reach = begin + 2 * (reach - begin)
        if meet is not None:
            pieces, stop = pieces[:meet + 1], ends[meet] - shift
        else:
            stop = len(old)
        self.coder.learn([pieces])
        fresh = ([len(p) for p in pieces], [len(self.coder.known[p]) // 4 for p in pieces])
        # Leaves from ``begin`` to ``stop`` go; the new ones take the place of the first.
        if leaf0 is None:
            first_block, leaf0 = len(self.blocks) - 1, len(self.blocks[-1][0])
        at, b, k = begin, first_block, leaf0
        touched = {first_block}
        while at < stop:
            sizes, counts = self.blocks[b]
            n = k
            while n < len(sizes) and at < stop:
                at += sizes[n]
                n += 1
            del sizes[k:n], counts[k:n]
            touched.add(b)
            b, k = b + 1, 0
        sizes, counts = self.blocks[first_block]
        sizes[leaf0:leaf0], counts[leaf0:leaf0] = fresh
        if len(sizes) > 4 * BLOCK:
            # A block that has grown is dealt out anew, with the tree over it.
            self.lengths = [x for a, _ in self.blocks for x in a]
            self.tokens = [x for _, c in self.blocks for x in c]
            self._build()
        else:
            for b in touched:
                self._put(b)


LEAVES = "n_pieces long, n_tokens long, lengths array<int>, tokens array<int>"
VALID = "edits, e -> e.start IS NOT NULL AND e.length IS NOT NULL"


def _leaves(counts: list[int], lengths: np.ndarray, tokens: np.ndarray) -> list[pa.Array]:
    """The columns of LEAVES, from the leaves of all trees one after the other and how many each has."""
    at = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    total = np.concatenate([[0], np.cumsum(tokens, dtype=np.int64)])
    begin = pa.array(at, pa.int32())
    return [pa.array(np.diff(at)), pa.array(np.diff(total[at])),
            pa.ListArray.from_arrays(begin, pa.array(lengths, pa.int32())), pa.ListArray.from_arrays(begin, pa.array(tokens, pa.int32()))]


def _key(docs: DataFrame) -> DataFrame:
    """Documents with ``key``, which tells texts apart and spreads the copies of one by their ids."""
    return docs.withColumn("key", F.struct(
        F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2")))


def grown(docs: DataFrame, ranks: bytes, pattern: str = bpe.PATTERN, texts_with: str | None = None) -> DataFrame:
    """``docs`` (doc_id, text and whatever else) with ``key`` and the leaves of its tree instead of the text.

    Written to a table it is what later edits start from: counts and lengths, no text. Only rows
    whose array ``texts_with``, if it is named, has elements keep their text as well.
    """
    held = docs.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary, whatever the corpus
    keep = [f for f in _key(docs).schema if f.name != "text" or texts_with]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.coder(held.value, pattern)
        for batch in batches:
            for rows, _, _ in W.runs(batch):
                texts = rows.column("text").to_pylist()
                cut = [coder.pieces(t or "") for t in texts]
                coder.learn(cut)
                counts = list(map(len, cut))
                n = sum(counts)
                lengths = np.fromiter(map(len, chain.from_iterable(cut)), np.int32, n)
                tokens = np.fromiter(map(len, map(coder.known.__getitem__, chain.from_iterable(cut))), np.int32, n) // 4
                columns = {f.name: rows.column(f.name) for f in keep}
                if texts_with:
                    sizes = pc.list_value_length(columns[texts_with]).to_pylist()
                    columns["text"] = pa.array([t if n else None for t, n in zip(texts, sizes)], pa.string())
                yield pa.RecordBatch.from_arrays([*columns.values(), *_leaves(counts, lengths, tokens)],
                                                 names=[*columns, "n_pieces", "n_tokens", "lengths", "tokens"])

    return _key(docs).mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", " + LEAVES)


def edited(docs: DataFrame, trees: DataFrame, ranks: bytes, pattern: str = bpe.PATTERN) -> DataFrame:
    """(doc_id, text, n_edits, n_pieces_before, n_tokens_before) of ``docs`` after their edits, with LEAVES.

    ``docs`` has doc_id, text and ``edits``; rows without edits are left out, and their trees
    are not opened. Trees come from ``grown``; what is given back, without the text and with a
    key of its own, can take the place of the trees it came from. A text without a tree in
    ``trees`` is left out.
    """
    todo = stored(_key(pick(docs, "doc_id", "text", "edits").withColumn("edits", F.expr(f"filter({VALID})")).where("size(edits) > 0")), "token-edits")
    stored_ = trees.select("key", "lengths", "tokens").join(todo.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    return _edited(todo.join(stored_, "key"), ranks, pattern)


def _edited(rows: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """What ``edited`` gives, of rows that have a text, its edits and its leaves."""
    held = rows.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.coder(held.value, pattern)
        for batch in batches:
            for part, _, _ in W.runs(batch):
                after, texts, before = [], [], []
                for row in part.select(["text", "edits", "lengths", "tokens"]).to_pylist():
                    before.append((len(row["lengths"]), sum(row["tokens"])))
                    tree = Tree(coder, row["text"] or "", (row["lengths"], row["tokens"]))
                    for e in row["edits"]:
                        tree.replace(e["start"], e["start"] + e["length"], e["new"] or "")
                    texts.append(tree.text)
                    after.append(tree.leaves())
                lengths, tokens = (np.array([x for leaves in after for x in leaves[k]], np.int32) for k in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(texts, pa.string()), pa.array([len(e) for e in part.column("edits").to_pylist()], pa.int64()),
                     pa.array([n for n, _ in before], pa.int64()), pa.array([n for _, n in before], pa.int64()),
                     *_leaves([len(a) for a, _ in after], lengths, tokens)],
                    names=["doc_id", "text", "n_edits", "n_pieces_before", "n_tokens_before", "n_pieces", "n_tokens", "lengths", "tokens"])

    return rows.select("doc_id", "text", "edits", "lengths", "tokens").mapInArrow(
        run, f"doc_id long, text string, n_edits long, n_pieces_before long, n_tokens_before long, {LEAVES}")


def counted(docs: DataFrame, ranks: bytes, pattern: str = bpe.PATTERN) -> DataFrame:
    """(doc_id, n_pieces, n_tokens, n_edits, n_tokens_after) of every row of ``docs``.

    ``docs`` has doc_id, text and ``edits``, an array of (start, length, new): ``length``
    characters from ``start``, counted from 0 in the text as the edits before have left it,
    become ``new``. Edits are taken in their order; those beyond the end are cut to it. A null
    text is empty, null edits are none, and so is an edit with a NULL place; a null ``new``
    is empty. NULL ids and repeated rows are rows like others; other columns are ignored.
    """
    # Edits are made once and go along with the trees; so do the texts that they change, and no others.
    docs = pick(docs, "doc_id", "text", "edits").withColumn("edits", F.expr(f"filter({VALID})"))
    trees = stored(grown(docs, ranks, pattern, "edits"), "token-trees")
    asked = F.coalesce(F.size("edits") > 0, F.lit(False))
    plain = trees.where(~asked).select(
        "doc_id", "n_pieces", "n_tokens", F.lit(0).cast("long").alias("n_edits"), F.col("n_tokens").alias("n_tokens_after"))
    return plain.unionAll(_edited(trees.where(asked), ranks, pattern).select(
        "doc_id", "n_pieces_before", "n_tokens_before", "n_edits", "n_tokens"))


def redactions(docs: DataFrame, pattern: str, new: str) -> DataFrame:
    """``docs`` (doc_id, text) with the edits that put ``new`` for every match of a pattern.

    Places count for the text as the edits before have left it, as ``counted`` takes them.
    """
    # Splitting at the matches gives what stands between them; lengths add up to places.
    docs = pick(docs, "doc_id", "text")
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), F.lit(0))
    between = F.split(F.coalesce("text", F.lit("")), pattern, -1)
    docs = docs.withColumn("found", found).withColumn("between", F.when(F.size("found") > 0, between))
    edits = F.expr(f"""zip_with(found, aggregate(slice(between, 1, size(found)), cast(array() AS ARRAY<INT>), (a, x) ->
        array_append(a, if(size(a) = 0, 0, a[greatest(size(a) - 1, 0)] + {len(new)}) + length(x))), (f, s) -> struct(s AS start, length(f) AS length, '{new}' AS new))""")
    return docs.select("doc_id", "text", F.when(F.size("found") > 0, edits).alias("edits"))
