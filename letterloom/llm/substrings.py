"""Substring dedup: words covered by a long passage that a smaller document also has.

A difference cover of a period is a set of residues such that, for any two positions, some
shift below the period takes both into the set. Short windows are hashed at cover positions
only (6 of 31). Two equal passages of 50 words hold an equal short window at the same place
in both, so a passage without a shared short window is repeated nowhere. Matches are then
extended: around shared anchors all 50-word windows are hashed, in 128 bits, and each goes
by whether a smaller document has it.

Rows of one hash that meet in a batch are settled there, and one of them goes on, with all
places where the batch's smallest document has the hash, so a passage in any share of the
documents reaches a task as one row a batch at most. Texts with the same words are settled
by a hash of the whole sequence before any window is looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from letterloom.llm import words as W
from letterloom.llm.tables import pick, stored

#: Perfect difference sets by their period.
COVERS = {31: (1, 5, 11, 24, 25, 27), 13: (0, 1, 3, 9), 7: (1, 2, 4)}
OTHER_BASE = 0xC2B2AE3D27D4EB4F
MORE = "more array<struct<row: long, pos: int>>"


def period_of(window: int) -> int:
    """The longest period that leaves short windows of at least a third of ``window`` words."""
    if window < 10:
        raise ValueError("windows have 10 words or more")
    return max(p for p in COVERS if window - p + 1 >= window / 3)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, raw, offsets in W.runs(batch):
            hashes, _, at = W.words(raw, offsets, W.PLAIN)
            counts = np.diff(at)
            keys = np.zeros((2, len(rows)), np.uint64)
            full = np.flatnonzero(counts)
            if len(full):
                place = np.arange(len(hashes)) - np.repeat(at[:-1], counts)
                for row, base in zip(keys, (W.BASE, OTHER_BASE)):
                    row[full] = W.mix(np.add.reduceat(hashes * W.powers(base, int(place.max()) + 1)[place], at[full]))
            data = raw.tobytes()
            digest = [hashlib.sha256(b" ".join(data[a:b].split())).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("row"), pa.array(counts), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), pa.array(digest)],
                names=["doc_id", "row", "n_words", "k1", "k2", "digest"])


def _local(hashes: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the rows by hash and document; in that order, whether each stands for its
    hash, as the first row does, and whether the batch has its hash in a smaller document."""
    order = np.lexsort((doc, *hashes[::-1]))
    new = np.ones(len(doc), bool)
    new[1:] = np.any([h[order][1:] != h[order][:-1] for h in hashes], axis=0)
    return order, new, doc[order] > doc[order][new][np.cumsum(new) - 1]


def _more(order: np.ndarray, stands: np.ndarray, settled: np.ndarray, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Which rows, in ``order``, go on, and what else waits for the hash that each stands for:
    the further places of the smallest document. ``settled`` rows wait for no other batch."""
    goes = stands | settled
    group = np.cumsum(stands) - 1
    size = np.where(stands, np.bincount(group[~goes], minlength=group[-1] + 1)[group], 0)[goes]
    waits = order[~goes]
    places = pa.StructArray.from_arrays([pa.array(row[waits]), pa.array(place[waits].astype(np.int32))], names=["row", "pos"])
    return goes, pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), places, mask=pa.array(size == 0))


def _anchors(window: int):
    period = period_of(window)
    cover = np.zeros(period, bool)
    cover[list(COVERS[period])] = True
    short = window - period + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for rows, raw, offsets in W.runs(batch):
                hashes, _, at = W.words(raw, offsets, W.PLAIN)
                counts = np.diff(at)
                grams = W.windows(hashes, short)
                if not len(grams):
                    continue
                text = np.repeat(np.arange(len(rows)), counts)[:len(grams)]
                place = np.arange(len(grams)) - at[text]
                good = cover[place % period] & (place + short <= counts[text]) & (counts[text] >= window)
                text = text[good]
                parts.append((grams[good], rows.column("doc_id").to_numpy()[text], rows.column("row").to_numpy()[text], place[good]))
            if not any(len(p[0]) for p in parts):
                continue
            gram, doc, row, place = (np.concatenate(p) for p in zip(*parts))
            order, stands, later = _local([gram], doc)
            # The smallest document of a shared hash is a hit as well.
            shared = np.logical_or.reduceat(later, np.flatnonzero(stands))[np.cumsum(stands) - 1]
            goes, more = _more(order, stands, shared, row, place)
            sent = order[goes]
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram[sent].view(np.int64)), pa.array(stands[goes]), pa.array(shared[goes]), pa.array(doc[sent]), pa.array(row[sent]), pa.array(place[sent].astype(np.int32)), more],
                names=["gram", "stands", "shared", "doc_id", "row", "pos", "more"])

    return run


def _extend(window: int):
    period = period_of(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for rows, raw, offsets in W.runs(batch):
                hashes, _, at = W.words(raw, offsets, W.PLAIN)
                counts = np.diff(at)
                first, second = W.windows(hashes, window), W.windows(hashes, window, OTHER_BASE)
                if not len(first):
                    continue
                hits = rows.column("hits")
                owner = np.repeat(np.arange(len(rows)), pa.compute.list_value_length(hits).to_numpy())
                p = hits.flatten().to_numpy()
                # Windows that hold an anchor begin up to period - 1 words before it.
                mark = np.zeros(len(hashes) + 1, np.int32)
                np.add.at(mark, at[owner] + np.maximum(p - period + 1, 0), 1)
                np.add.at(mark, at[owner] + p + 1, -1)
                text = np.repeat(np.arange(len(rows)), counts)[:len(first)]
                place = np.arange(len(first)) - at[text]
                good = (np.cumsum(mark)[:len(first)] > 0) & (place + window <= counts[text])
                text = text[good]
                parts.append((first[good], second[good], rows.column("doc_id").to_numpy()[text], rows.column("row").to_numpy()[text], place[good]))
            if not any(len(p[0]) for p in parts):
                continue
            first, second, doc, row, place = (np.concatenate(p) for p in zip(*parts))
            order, stands, later = _local([first, second], doc)
            goes, more = _more(order, stands, later, row, place)
            sent = order[goes]
            yield pa.RecordBatch.from_arrays(
                [pa.array(first[sent].view(np.int64)), pa.array(second[sent].view(np.int64)), pa.array(stands[goes]), pa.array(later[goes]), pa.array(doc[sent]), pa.array(row[sent]), pa.array(place[sent].astype(np.int32)), more],
                names=["w1", "w2", "stands", "later", "doc_id", "row", "pos", "more"])

    return run


def _places(df: DataFrame, name: str) -> DataFrame:
    """(doc_id, row) and the set of its places, those in ``more`` counted."""
    each = df.select("doc_id", F.expr("inline(concat(array(struct(row, pos)), coalesce(more, array())))"))
    return each.groupBy("doc_id", "row").agg(F.collect_set("pos").alias(name))


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for text, starts in zip(batch.column("text").to_pylist(), batch.column("starts")):
                words = text.encode().split()
                mark = np.zeros(len(words) + 1, np.int32)
                at = starts.values.to_numpy()
                np.add.at(mark, at, 1)
                np.add.at(mark, at + window, -1)
                stay = np.cumsum(mark)[:-1] == 0
                removed.append(len(words) - int(stay.sum()))
                kept.append(b" ".join([words[i] for i in np.flatnonzero(stay).tolist()]).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "row", "n_removed", "kept"])

    return run


def substring_dedup(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of ``docs``.

    Words are [^\\x20\\x09-\\x0D]+ of the whole text. A word goes when a window of ``window``
    words over it also begins in a document of smaller doc_id, judged on the input; what stays
    is joined by single spaces. Null and empty texts have no words. Rows without doc_id neither
    lose words nor take any; rows of one doc_id do not take words from each other. Other
    columns are ignored.
    """
    plain = pick(docs, "doc_id", "text").withColumn("row", F.coalesce(F.xxhash64("text"), F.lit(0)))
    rows = stored(plain.mapInArrow(_whole, "doc_id long, row long, n_words long, k1 long, k2 long, digest string"), "word-rows")
    long_ = rows.where(f"doc_id IS NOT NULL AND n_words >= {window}")
    firsts = long_.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.count("*").alias("size")).where("size > 1").drop("size")
    copies = stored(long_.join(firsts, ["k1", "k2"]).where("first < doc_id").select("doc_id", "row").distinct(), "word-copies")

    fresh = plain.where("doc_id IS NOT NULL AND text IS NOT NULL").join(copies, ["doc_id", "row"], "left_anti")
    anchors = fresh.mapInArrow(_anchors(window), f"gram long, stands boolean, shared boolean, doc_id long, row long, pos int, {MORE}")
    # Rows that stand for no hash are settled; a key of their own keeps them out of its group.
    anchors = anchors.withColumn("gram", F.when(F.col("stands"), F.col("gram")).otherwise(F.xxhash64("doc_id", "row", "pos")))
    met = Window.partitionBy("gram", "stands")
    hits = anchors.withColumn("held", F.count("*").over(met)).where("shared OR (stands AND held > 1)")
    near = stored(plain.join(_places(hits, "hits"), ["doc_id", "row"]).dropDuplicates(["doc_id", "row"]).select("doc_id", "row", "text", "hits"), "anchored-texts")

    spans = near.mapInArrow(_extend(window), f"w1 long, w2 long, stands boolean, later boolean, doc_id long, row long, pos int, {MORE}")
    spans = spans.withColumn("w1", F.when(F.col("stands"), F.col("w1")).otherwise(F.xxhash64("doc_id", "row", "pos")))
    least = F.min("doc_id").over(Window.partitionBy("w1", "w2", "stands"))
    covered = spans.withColumn("least", least).where("later OR (stands AND least < doc_id)")
    cut = near.select("doc_id", "row", "text").join(_places(covered, "starts"), ["doc_id", "row"]).mapInArrow(
        _cut(window), "doc_id long, row long, n_removed long, kept string")
    cut = cut.select("doc_id", "row", "n_removed", F.sha2("kept", 256).alias("cut_digest")).unionAll(
        copies.select("doc_id", "row", F.lit(-1).cast("long").alias("n_removed"), F.sha2(F.lit(""), 256).alias("cut_digest")))
    return rows.join(cut, ["doc_id", "row"], "left").select(
        "doc_id", "n_words",
        F.when(F.col("n_removed") < 0, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.coalesce("cut_digest", "digest").alias("kept_sha256"))
