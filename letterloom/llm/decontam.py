"""Benchmark decontamination: items found in documents up to a share of edited words.

Words are the symbols. The CGK embedding walks along a text: step j writes down the word it
stands on, and a random function of j and that word says whether it moves on. Texts a few
edits apart soon walk in step again, so edit distance becomes Hamming distance between the
words written down. A locality-sensitive hash samples a few steps of a walk; a document's
window and an item's window with equal samples make a candidate, and an exact edit distance
over the words around it settles that.

Windows are as long as items are, by size class, and begin at every ``stride``-th word of a
document and at every word of an item, so some document window begins where an item window
does, however the passage lies. Walks and samples repeat until passages with ``rate`` of
their words edited are found with the recall that the tests measure (0.95 and more).

Items are taken in blocks of bounded size; each block goes to all tasks, and every document
is read whole within one task, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterloom.llm import words as W
from letterloom.llm.tables import pick

STRIDE = 4
#: Steps of a walk and fewest words of an item. A walk moves on at about half its steps; windows
#: begin at all words of an item but the last ``least - STRIDE``.
CLASSES = ((32, 35), (16, 19), (12, 11))
WALKS, SAMPLES = 3, 4
#: Steps sampled, by class.
WIDTH = {32: 5, 16: 6, 12: 7}
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20
FILTER_BITS = 22

_RNG = np.random.default_rng(5)
_MOVES = _RNG.integers(1, 2**32, size=(WALKS, max(c[0] for c in CLASSES)), dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_STEPS = {steps: [[np.sort(_RNG.choice(steps, WIDTH[steps], replace=False)) for _ in range(SAMPLES)] for _ in range(WALKS)] for steps, _ in CLASSES}


def keys(symbols: np.ndarray, starts: np.ndarray, walk: int, classes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(class, sampled key of each start) for every sample of a walk; ``symbols`` end in padding."""
    at = starts.copy()
    # The samples that step j belongs to.
    takes: list[list[tuple[int, int]]] = [[] for _ in range(max(classes))]
    state = {}
    for steps in classes:
        for k, sample in enumerate(_STEPS[steps][walk]):
            state[steps, k] = [np.zeros(len(starts), np.uint64), WIDTH[steps]]
            for j in sample:
                takes[j].append((steps, k))
    for j, owners in enumerate(takes):
        word = symbols[at]
        for owner in owners:
            held = state[owner]
            held[0] *= np.uint64(W.BASE)
            held[0] += word
            held[1] -= 1
            if not held[1]:
                yield owner[0], W.mix(state.pop(owner)[0] + np.uint64(1 + owner[0] + 64 * owner[1]))
        at += (word * _MOVES[walk, j]) >> np.uint32(31)


def symbols_of(hashes: np.ndarray) -> np.ndarray:
    """Words as 32-bit symbols, with zeros behind for walks that run over the end."""
    out = np.zeros(len(hashes) + max(c[0] for c in CLASSES) + 1, np.uint32)
    out[:len(hashes)] = hashes >> np.uint64(32)
    return out


@dataclass
class Block:
    """Some items: their words, and the sampled keys of all their windows."""
    ids: list[int]
    words: list[np.ndarray]
    classes: list[int]
    keys: list[np.ndarray]      # by walk: sorted keys, and item and offset of each
    items: list[np.ndarray]
    offsets: list[np.ndarray]
    filters: list[np.ndarray]
    tiny: dict[int, dict[bytes, list[int]]]  # items of few words, by number of words


def size_class(n: int) -> int:
    return next((steps for steps, least in CLASSES if n >= least), 0)


def make_block(rows: list[tuple[int, str]]) -> Block:
    column = pa.array([t for _, t in rows], pa.string())
    raw, offsets = W.text_bytes(column)
    hashes, _, bounds = W.words(raw, offsets, W.LETTERS)
    texts = [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    tiny: dict[int, dict[bytes, list[int]]] = {}
    groups: dict[int, list[int]] = {}
    for i, text in enumerate(texts):
        steps = size_class(len(text))
        if steps:
            groups.setdefault(steps, []).append(i)
        elif len(text):
            tiny.setdefault(len(text), {}).setdefault(text.tobytes(), []).append(i)
    found: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(WALKS)]
    for steps, members in groups.items():
        symbols = symbols_of(np.concatenate([texts[i] for i in members]))
        lengths = np.array([len(texts[i]) for i in members])
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        room = lengths - dict(CLASSES)[steps] + STRIDE
        offset = np.concatenate([np.arange(r) for r in room])
        starts = np.repeat(first, room) + offset
        item = np.repeat(np.array(members), room)
        for walk in range(WALKS):
            for _, key in keys(symbols, starts, walk, [steps]):
                found[walk].append((key, item, offset))
    block = Block([i for i, _ in rows], texts, sorted(groups), [], [], [], [], tiny)
    for parts in found:
        key, item, offset = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t) for k, t in ((0, np.uint64), (1, np.int64), (2, np.int64)))
        order = np.argsort(key, kind="stable")
        block.keys.append(key[order])
        block.items.append(item[order])
        block.offsets.append(offset[order])
        bits = np.zeros(1 << FILTER_BITS, bool)
        bits[key >> np.uint64(64 - FILTER_BITS)] = True
        block.filters.append(bits)
    return block


def edits_within(item: np.ndarray, text: np.ndarray, most: int) -> int | None:
    """Fewest word edits between ``item`` and any stretch of ``text``; None if over ``most``."""
    n = len(item)
    # Columns by end in the text; a stretch may begin anywhere, so row 0 is free.
    row = np.zeros(len(text) + 1, np.int64)
    along = np.arange(len(text) + 1)
    for i in range(1, n + 1):
        new = np.empty_like(row)
        new[0] = i
        np.minimum(row[:-1] + (text != item[i - 1]), row[1:] + 1, out=new[1:])
        # Insertions run to the right: a running minimum once slopes are taken out.
        row = np.minimum.accumulate(new - along) + along
        if row.min() > most:
            return None
    best = int(row.min())
    return best if best <= most else None


def matches(block: Block, hashes: np.ndarray, bounds: np.ndarray, rate: float, stride: int = STRIDE) -> dict[tuple[int, int], int]:
    """Fewest edits of each (text, item) found; texts are runs of ``hashes``."""
    out: dict[tuple[int, int], int] = {}
    if not len(hashes):
        return out
    near: set[tuple[int, int, int]] = set()
    if block.classes:
        symbols = symbols_of(hashes)
        starts = np.arange(0, len(hashes), stride)
        for walk in range(WALKS):
            for _, key in keys(symbols, starts, walk, block.classes):
                hit = np.flatnonzero(block.filters[walk][key >> np.uint64(64 - FILTER_BITS)])
                lo = np.searchsorted(block.keys[walk], key[hit], "left")
                hi = np.searchsorted(block.keys[walk], key[hit], "right")
                some = hi > lo
                for h, a, b in zip(hit[some].tolist(), lo[some].tolist(), hi[some].tolist()):
                    for e in range(a, b):
                        near.add((int(block.items[walk][e]), int(starts[h]), int(block.offsets[walk][e])))
    done: set[tuple[int, int, int]] = set()
    for item, start, offset in sorted(near):
        text = int(np.searchsorted(bounds, start, "right")) - 1
        words = block.words[item]
        n, most = len(words), int(rate * len(words))
        begin = start - offset
        # Candidates a few words apart are settled by one look over a wider stretch.
        zone = begin // (most + 4)
        if out.get((text, item)) == 0 or (text, item, zone) in done:
            continue
        done.add((text, item, zone))
        lo = max(int(bounds[text]), zone * (most + 4) - most)
        hi = min(int(bounds[text + 1]), (zone + 1) * (most + 4) + n + most)
        edits = edits_within(words, hashes[lo:hi], most)
        if edits is not None and edits < out.get((text, item), n + 1):
            out[text, item] = edits
    for n, index in block.tiny.items():
        # Too short for an edit to leave anything: these are compared word for word.
        if len(hashes) >= n:
            runs = W.windows(hashes, n)
            want = np.array([W.windows(np.frombuffer(k, np.uint64), n)[0] for k in index])
            for at in np.flatnonzero(np.isin(runs, want)).tolist():
                text = int(np.searchsorted(bounds, at, "right")) - 1
                if at + n <= bounds[text + 1]:
                    for item in index.get(hashes[at:at + n].tobytes(), ()):
                        out[text, item] = 0
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.2) -> DataFrame:
    """(doc_id, item_id, item_words, edits) of each item that a document contains.

    A document contains an item when some stretch of its words is at most
    ``floor(rate * item words)`` word edits away. Words are runs of ASCII letters, digits and
    all other characters beyond ASCII, A-Z in lower case. Items under 11 words match word for
    word only. Null and empty texts contain nothing and are contained nowhere; items without
    item_id count like others, and so do documents without doc_id; a repeated row is reported
    again. Other columns are ignored.
    """
    plain = pick(docs, "doc_id", "text")
    out = None
    for block in _blocks(benchmark):
        found = plain.mapInArrow(_reporter(plain, block, rate), "doc_id long, item_id long, item_words long, edits long")
        out = found if out is None else out.unionAll(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = 0.2) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns."""
    for block in _blocks(benchmark):
        docs = docs.mapInArrow(_filter(docs, block, rate), docs.schema)
    return docs


def _blocks(benchmark: DataFrame) -> Iterator[Block]:
    items = pick(benchmark, "item_id", "text").where("text IS NOT NULL")
    size = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    count = max(1, -(-size[0] // BLOCK_ITEMS), -(-(size[1] or 0) // BLOCK_BYTES))
    for k in range(count):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k) if count > 1 else items
        yield make_block([tuple(r) for r in part.collect()])


def _found(batches: Iterator[pa.RecordBatch], block: Block, rate: float) -> Iterator[tuple[pa.RecordBatch, dict[tuple[int, int], int]]]:
    for batch in batches:
        for rows, raw, offsets in W.runs(batch):
            hashes, _, bounds = W.words(raw, offsets, W.LETTERS)
            yield rows, matches(block, hashes, bounds, rate)


def _reporter(docs: DataFrame, block: Block, rate: float):
    held = docs.sparkSession.sparkContext.broadcast(block)  # bounded by BLOCK_ITEMS and BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        for rows, hits in _found(batches, block, rate):
            found = sorted(hits.items())
            yield pa.RecordBatch.from_arrays([
                rows.column("doc_id").take(pa.array([t for (t, _), _ in found], pa.int64())),
                pa.array([block.ids[i] for (_, i), _ in found], pa.int64()),
                pa.array([len(block.words[i]) for (_, i), _ in found], pa.int64()),
                pa.array([e for _, e in found], pa.int64())], names=["doc_id", "item_id", "item_words", "edits"])

    return run


def _filter(docs: DataFrame, block: Block, rate: float):
    held = docs.sparkSession.sparkContext.broadcast(block)  # bounded by BLOCK_ITEMS and BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, hits in _found(batches, held.value, rate):
            good = np.ones(len(rows), bool)
            good[[t for t, _ in hits]] = False
            yield rows.filter(pa.array(good))

    return run
