"""Importance resampling: draw the documents that look most like a target, with noise.

Texts are bags of hashed words and word pairs. How much more often the target has a bucket
than the corpus is its gain; the gains of all buckets are one short array, which every task
gets, so a document is scored by looking its features up. Its weight, the mean gain, plus
Gumbel noise that follows from its id is its score, and the highest scores are a draw
without replacement in proportion to the weights.

The scores are written once. The lowest score drawn is found by counting: each job counts
the rows at or above a few thresholds that split what is left of the range, and so for the
ids that tie at that score. Nothing is sorted but the drawn rows, which are ranged by score.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.llm import words as W
from letterloom.llm.tables import pick, stored
from letterloom.operators.ordering import number_rows

#: Thresholds that one counting job looks at.
SPLITS = 15
#: Words longer than this are hashed one by one, all others side by side.
LONG = 64


def _steps() -> np.ndarray:
    """The change of a CRC-32 by one byte, for all 256 bytes."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, out >> 1 ^ np.uint32(0xEDB88320), out >> 1).astype(np.uint32)
    return out


_STEPS = _steps()


def _run_on(state: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 states after the further bytes raw[start:end] of each."""
    state = state.copy()
    sizes = ends - starts
    for i in np.flatnonzero(sizes > LONG).tolist():
        state[i] = zlib.crc32(raw[starts[i]:ends[i]], int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    live = np.flatnonzero(sizes <= LONG)
    k = 0
    while len(live := live[sizes[live] > k]):
        now = state[live]
        state[live] = _STEPS[(now ^ raw[starts[live] + k]) & 0xFF] ^ now >> np.uint32(8)
        k += 1
    return state


def features(raw: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each feature of a run of texts, its text, and the number of words of each text."""
    folded = raw.copy()
    upper = (raw >= 65) & (raw <= 90)
    folded[upper] += 32
    _, starts, at = W.words(raw, offsets, W.LETTERS)
    counts = np.diff(at)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), counts
    ends = W.word_ends(raw, offsets, W.LETTERS)
    owner = np.repeat(np.arange(len(counts)), counts)
    state = _run_on(np.full(len(starts), 0xFFFFFFFF, np.uint32), folded, starts, ends)
    first = np.flatnonzero(owner[:-1] == owner[1:])
    spaced = state[first]
    spaced = _STEPS[(spaced ^ np.uint32(32)) & 0xFF] ^ spaced >> np.uint32(8)
    pairs = _run_on(spaced, folded, starts[first + 1], ends[first + 1])
    crc = np.r_[state, pairs] ^ np.uint32(0xFFFFFFFF)
    return (crc % np.uint32(buckets)).astype(np.int64), np.r_[owner, owner[first]], counts


def bucket_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n): features of all texts by bucket; a task sends each bucket once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, raw, offsets in W.runs(batch):
                total += np.bincount(features(raw, offsets, buckets)[0], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    return pick(texts, "text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of every bucket, in thousandths of a natural logarithm, rounded down.

    Both tables are counted in full; what comes to the driver is at most one row a bucket.
    """
    counts = np.zeros((2, buckets), np.int64)
    for row, texts in zip(counts, (docs, target)):
        found = bucket_counts(texts, buckets).toPandas()
        row[found["bucket"].to_numpy()] = found["n"].to_numpy()
    (have, want), (total, aim) = counts.tolist(), counts.sum(axis=1).tolist()
    return np.array([
        math.floor(1000 * math.log(float(t + 1) * float(total + buckets) / (float(s + 1) * float(aim + buckets))))
        for s, t in zip(have, want)], np.int64)


def _weigh(gain: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, offsets in W.runs(batch):
                bucket, owner, counts = features(raw, offsets, len(gain))
                size = np.bincount(owner, minlength=len(rows))
                total = np.zeros(len(rows), np.int64)
                np.add.at(total, owner, gain[bucket])
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("same"), pa.array(counts), pa.array(size), pa.array(total // np.maximum(size, 1))],
                    names=["doc_id", "same", "n_words", "n_features", "weight"])

    return run


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from 32 bits of a hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def scores(docs: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """(doc_id, same, n_words, n_features, weight, score); ``same`` tells texts of one id apart."""
    rows = pick(docs, "doc_id", "text").withColumn("same", F.xxhash64("text")).mapInArrow(
        _weigh(gain), "doc_id long, same long, n_words long, n_features long, weight long")
    return rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def _least(rows: DataFrame, key: Column, count: int) -> int:
    """The least value that ``count`` rows or more do not exceed in ``key``.

    ``count`` is at least 1 and at most the number of rows. Each job counts the rows up to
    SPLITS values, which cut what is left of the range into equal parts.
    """
    low, top = rows.agg(F.min(key), F.max(key)).first()
    while low < top:
        cuts = sorted({low + (top - low) * i // (SPLITS + 1) for i in range(SPLITS + 1)})
        held = rows.agg(*[F.count_if(key <= c) for c in cuts]).first()
        top = min((c for c, n in zip(cuts, held) if n >= count), default=top)
        low = max((c + 1 for c, n in zip(cuts, held) if n < count), default=low)
    return low


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, buckets: int = 10_000, seed: int = 7) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs``.

    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the whole text after A-Z are lower-cased.
    ``rank`` counts from 1 by falling score, then doc_id, over the floor(percent * N / 100)
    rows drawn of the N that have at least ``min_words`` words; it is null for all others.
    Null and empty texts have no features and weight 0. Rows without doc_id count for the
    gains like any other, have a null score and are never drawn. Repeated rows are rows of
    their own; of rows with one id and score those of smaller text hash go first. Empty
    tables give gains from no counts and an empty result. Other columns are ignored.
    """
    gain = gains(docs, target, buckets)
    all_rows = stored(scores(docs, gain, seed), "resample-scores")
    open_ = (F.col("n_words") >= min_words) & F.col("doc_id").isNotNull()
    rows = all_rows.where(open_)
    drawn = rows.count() * percent // 100
    out = ["doc_id", "n_words", "n_features", "weight", "score"]
    if not drawn:
        return all_rows.select(*out, F.lit(None).cast("long").alias("rank"))
    score = -_least(rows, -F.col("score"), drawn)
    above = rows.where(F.col("score") > score).count()
    last = _least(rows.where(F.col("score") == score), F.col("doc_id"), drawn - above)
    taken = open_ & ((F.col("score") > score) | ((F.col("score") == score) & (F.col("doc_id") <= last)))
    # Rows repeated in full are dealt by a number of their own, so they fill partitions like others.
    ranked = number_rows(
        all_rows.where(taken).withColumn("copy", F.monotonically_increasing_id()),
        [F.desc("score"), "doc_id", "same", "copy"], "rank")
    # Only rows that repeat the last drawn id can be too many.
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).cast("long").alias("rank")
    return ranked.select(*out, rank).unionAll(
        all_rows.where(F.coalesce(~taken, F.lit(True))).select(*out, F.lit(None).cast("long").alias("rank")))


#: CRC-32 of distinct features and the rest of the method in DuckDB.
RESAMPLE_SQL = r"""
WITH RECURSIVE bits(i, k, v) AS (SELECT i, 0, i::BIGINT FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
steps AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
texts AS (SELECT 0 AS side, row_number() OVER () AS row, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
w AS (SELECT side, row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
f AS (SELECT side, row, unnest(list_concat(ws, [ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))])) AS x FROM w),
d AS (SELECT x, hex(encode(x)) AS h FROM (SELECT DISTINCT x FROM f)),
c AS (SELECT x, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], [('0x' || h[2*i+1:2*i+2])::BIGINT for i in range(length(h)//2)]),
   lambda a, v: xor(a >> 8, t[xor(a & 255, v) + 1]))) % 10000 AS bucket FROM d, steps),
n AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM f JOIN c USING (x) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM n) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM n) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM n),
m AS (SELECT row, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS total FROM f JOIN c USING (x) JOIN g USING (bucket) WHERE side = 0 GROUP BY row),
z AS (SELECT w.row, doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features,
   CASE WHEN n_features IS NULL THEN 0 WHEN total < 0 THEN -((n_features - 1 - total) // n_features) ELSE total // n_features END AS weight,
   ('0x' || sha256('7:' || doc_id)[1:8])::BIGINT::DOUBLE AS h FROM w LEFT JOIN m USING (row) WHERE side = 0),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM z),
r AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM y WHERE n_words >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
   CASE WHEN rank <= (SELECT count(*) FROM r) * 25 // 100 THEN rank END AS rank FROM y LEFT JOIN r USING (row)
"""
