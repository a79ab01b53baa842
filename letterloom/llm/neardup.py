"""Near-duplicates by MinHash bands with sequential Bayesian verification.

A document's set holds its distinct five-word shingles. Texts with the same words are one
class from the start, and only classes take part in the search. Each class gets 400 minimum
hashes; the first 200 are banded by five: a pair of similarity 0.75 shares no band with
probability (1 - 0.75**5)**40 = 2e-5. Candidates compare their minimum hashes batch by batch; after each
batch a pair goes when the posterior probability that its similarity reaches the bound is
below ``miss``. Survivors are settled on their full sets.

A band shared by m classes does not give m*m pairs. First its members are compared with one
hub, the most connected of them; members that are in one component by then need no further
pairs. Pairs across components that share a band are all tested too, so components are those
of all candidate pairs; sizes and signatures are compared within the join, which lets only
survivors through, once each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterloom.llm import words as W
from letterloom.llm.components import components
from letterloom.llm.tables import pick, stored

SHINGLE = 5
BANDS, ROWS = 40, 5
#: Minimum hashes that candidates are compared by, and how many at a time; bands use the first.
HASHES, BATCH = 400, 80
_SEEDS = np.random.default_rng(71).integers(1, 2**32, size=(HASHES, 2), dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def _text_shingles(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, and where each text's begin."""
    counts = np.diff(bounds)
    grams = W.windows(hashes, SHINGLE)
    text = np.repeat(np.arange(len(counts)), counts)
    whole = text[:len(grams)] == text[SHINGLE - 1:] if len(grams) else np.zeros(0, bool)
    grams, owner = grams[whole], text[:len(whole)][whole]
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        lone = np.array([W.mix(np.uint64(n) + W.powers(W.BASE, 8)[:1] * (hashes[b:b + n] * W.powers(W.BASE, n)).sum(dtype=np.uint64))[0]
                         for b, n in zip(bounds[short], counts[short])], np.uint64)
        grams, owner = np.concatenate([grams, lone]), np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[new], np.searchsorted(owner[new], np.arange(len(counts) + 1))


def _minima(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Minimum hashes, a row for each text with shingles."""
    full = np.flatnonzero(np.diff(bounds))
    x = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(full), len(_SEEDS)), np.uint32)
    at = bounds[full]
    for k, (flip, odd) in enumerate(_SEEDS):
        out[:, k] = np.minimum.reduceat((x ^ flip) * odd, at)
    return out


_SIGNED = "doc_id long, k1 long, k2 long, n_shingles long, bands array<long>, sig array<long>"
#: Minimum hashes are compared by their last 8 bits, eight to a 64-bit number.
LANES = 8


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, raw, offsets in W.runs(batch):
            hashes, _, at = W.words(raw, offsets, W.FOLDED)
            n = len(rows)
            keys = np.zeros((2, n), np.uint64)
            full = np.flatnonzero(np.diff(at))
            if len(full):
                place = np.arange(len(hashes)) - np.repeat(at[:-1], np.diff(at))
                for row, base in zip(keys, (W.BASE, 0xC2B2AE3D27D4EB4F)):
                    row[full] = W.mix(np.add.reduceat(hashes * W.powers(base, int(place.max()) + 1)[place], at[full]))
            grams, bounds = _text_shingles(hashes, at)
            bands, sigs = [None] * n, [None] * n
            if len(full):
                low = _minima(grams, bounds)
                band = W.mix((low[:, :BANDS * ROWS].astype(np.uint64).reshape(len(full), BANDS, ROWS) * W.powers(W.BASE, ROWS)).sum(axis=2, dtype=np.uint64)
                             + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                lanes = np.ascontiguousarray(low.astype(np.uint8)).view(np.int64)
                for i, r in enumerate(full):
                    bands[r], sigs[r] = band[i], lanes[i]
            yield pa.RecordBatch.from_arrays([
                rows.column("doc_id"), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)),
                pa.array(np.diff(bounds)), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.list_(pa.int64()))],
                names=["doc_id", "k1", "k2", "n_shingles", "bands", "sig"])


def batch_bounds(similarity: float, miss: float, n: int = HASHES, batch: int = BATCH) -> list[int]:
    """Fewest equal hashes, after each batch, at which a pair goes on.

    With a uniform prior the posterior of the similarity after m of n equal hashes is
    Beta(m + 1, n - m + 1); a pair goes when its tail above ``similarity`` is below ``miss``.
    The tail is a binomial sum: P(Binomial(n + 1, similarity) <= m).
    """
    from math import comb

    bounds = []
    for size in range(batch, n + 1, batch):
        tail, least = 0.0, 0
        for m in range(size + 2):
            tail += comb(size + 1, m) * similarity**m * (1 - similarity)**(size + 1 - m)
            if tail >= miss:
                least = m
                break
        bounds.append(least)
    return bounds


def survives(a: str, b: str, bounds: list[int]) -> str:
    """SQL: no batch rules out the pair of signatures ``a`` and ``b``."""
    # Eight lanes at once: the bits of each lane of x ^ y are folded into its lowest one.
    tests = []
    for k, least in enumerate(bounds):
        part = f"slice({{}}, 1, {(k + 1) * BATCH // LANES})"
        folded = (f"zip_with({part.format(a)}, {part.format(b)}, (x, y) -> "
                  f"((x ^ y) | shiftrightunsigned(x ^ y, 4)) & {0x0F0F0F0F0F0F0F0F}L)")
        folded = f"transform({folded}, v -> (v | shiftrightunsigned(v, 2)) & {0x0303030303030303}L)"
        unequal = f"aggregate({folded}, 0, (n, v) -> n + bit_count((v | shiftrightunsigned(v, 1)) & {0x0101010101010101}L))"
        tests.append(f"{unequal} <= {(k + 1) * BATCH - least}")
    return " AND ".join(tests)


def _linked(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (hub, doc_id), as (a, b), whose full shingle sets meet the bound; further numbers of a pair go along."""
    pairs = pairs.withColumnsRenamed({"hub": "a", "doc_id": "b"})
    carried = pairs.columns

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_set = None, None
        for batch in batches:
            left = batch.column("text_a").to_pylist()
            keep = []
            for i, (a, x) in enumerate(zip(batch.column("a").to_pylist(), left)):
                if a != held or held_set is None:
                    held, held_set = a, shingles(x)
                other = shingles(batch.column("text_b")[i].as_py())
                both = len(np.intersect1d(held_set, other, assume_unique=True))
                if 100 * both >= percent * (len(held_set) + len(other) - both):
                    keep.append(i)
            yield batch.select(carried).take(pa.array(keep, pa.int64()))

    right = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    whole = right.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return whole.select(*carried, "text_a", "text_b").mapInArrow(test, ", ".join(f"{c} long" for c in carried))


def shingles(text: str) -> np.ndarray:
    """Distinct shingle hashes of one text, in order."""
    raw = np.frombuffer(text.encode(), np.uint8)
    hashes, _, at = W.words(raw, np.array([0, len(raw)]), W.FOLDED)
    return _text_shingles(hashes, at)[0]


def near_duplicates(docs: DataFrame, percent: int = 75, miss: float = 1e-4) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``.

    Words are [^\\x20\\x09-\\x0D]+ of the whole text with A-Z in lower case. Documents are
    linked when 100 * intersection >= percent * union. A text of fewer than five words has its
    whole sequence as its only shingle; a null or empty text has none and is linked with
    nothing. Rows without ``doc_id`` are linked with nothing either, get no component and are
    kept; repeated rows get the same answer. Other columns are ignored.
    """
    plain = pick(docs, "doc_id", "text")
    rows = stored(plain.mapInArrow(_sign, _SIGNED), "signatures")
    classes = rows.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")).where("rep IS NOT NULL")
    classes = stored(classes, "classes")
    reps = classes.select(F.col("rep").alias("doc_id"), "k1", "k2")
    signed = stored(rows.join(reps, ["doc_id", "k1", "k2"]).dropDuplicates(["doc_id"]), "class-signatures")

    members = signed.select(F.explode("bands").alias("band"), "doc_id", "n_shingles")
    shared = members.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(members.join(shared, "band"), "band-members")
    # How often a class meets others: the original of many edited copies meets most.
    weight = members.groupBy("doc_id").agg(F.sum("size").alias("weight"))
    members = stored(members.join(weight, "doc_id").select("band", "doc_id", "n_shingles", "weight"), "weighted-members")
    texts = stored(plain.join(weight.select("doc_id"), "doc_id").dropDuplicates(["doc_id"]), "candidate-texts")

    near = f"100 * least(n_a, n_shingles) >= {percent} * greatest(n_a, n_shingles)"
    alive = survives("sig_a", "sig", batch_bounds(percent / 100, miss))
    left = signed.select(F.col("doc_id").alias("hub"), F.col("sig").alias("sig_a"))
    right = signed.select("doc_id", "sig")

    # A star a band: its hub is the most connected member.
    best = F.max(F.struct("weight", F.col("doc_id").alias("hub"), F.col("n_shingles").alias("n_a"))).alias("h")
    hubs = members.groupBy("band").agg(best).select("band", "h.hub", "h.n_a")
    pairs = members.join(hubs, "band").where(f"hub <> doc_id AND {near}").select("hub", "doc_id").distinct()
    pairs = stored(pairs.join(left, "hub").join(right, "doc_id").where(alive).select("hub", "doc_id"), "star-pairs")
    links = stored(_linked(pairs, texts, percent), "star-links")
    found = stored(components(links), "star-components")

    # What no star has joined: all pairs across components, in the first band they share.
    held = members.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    split = held.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band")
    open_ = held.join(split, "band").join(signed.select("doc_id", "bands", "sig"), "doc_id")
    open_ = stored(open_.select("band", "doc_id", "n_shingles", "root", "sig", F.expr("transform(bands, x -> cast(x & 2147483647L AS INT))").alias("bands"),
                                F.expr("array_position(bands, band)").alias("at")), "open-members")
    other = open_.select("band", F.col("doc_id").alias("hub"), F.col("n_shingles").alias("n_a"), F.col("root").alias("root_a"),
                         F.col("sig").alias("sig_a"), F.col("bands").alias("bands_a"))
    first = "NOT exists(zip_with(slice(bands, 1, int(at) - 1), slice(bands_a, 1, int(at) - 1), (x, y) -> x = y), x -> x)"
    across = open_.join(other, (open_["band"] == other["band"]) & F.expr(f"root_a < root AND {near} AND {alive} AND {first}"))
    pairs = stored(across.select("hub", "doc_id", "root_a", "root"), "cross-pairs")

    named = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", F.coalesce("root", "rep").alias("component"))
    if not pairs.isEmpty():
        # A component is one node by now, its root, so what is left are few nodes and links.
        crossed = stored(_linked(pairs, texts, percent), "cross-links").select(F.col("root_a").alias("a"), F.col("root").alias("b"))
        merged = stored(components(crossed), "components").withColumnRenamed("node", "component")
        named = named.join(merged, "component", "left").select("k1", "k2", F.coalesce("root", "component").alias("component"))
    out = rows.select("doc_id", "k1", "k2", "n_shingles").join(named, ["k1", "k2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
