"""Quality by ordinal regression with a cumulative logit link on hashed words.

Grades are ordered; P(grade > j) is the logistic function of (w.x - t_j), with one vector of
weights for all grades and rising thresholds t_j. Features are hashed words, once as bare
letters in lower case and once as they stand, and the shape of the text; a text
weighs each by one over the fourth root of their number. The fit is on a bounded sample of
rated documents; features are made and texts are scored where the documents are.
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

BITS = 18


@dataclass
class Model:
    weights: np.ndarray     # by hashed feature
    thresholds: np.ndarray  # between neighbouring grades


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts one after the other, and where each text's begin."""
    bare, _, at = W.words(raw, offsets, W.LETTERS)
    full, _, to = W.words(raw, offsets, W.PLAIN)
    n = len(offsets) - 1
    texts = np.arange(n)
    by_bare, by_full = np.repeat(texts, np.diff(at)), np.repeat(texts, np.diff(to))
    # The shape of a text: how many words, how many of them differ, how many bytes are letters.
    counts = np.diff(to)
    order = np.lexsort((full, by_full))
    fresh = np.ones(len(full), bool)
    fresh[1:] = (full[order][1:] != full[order][:-1]) | (by_full[order][1:] != by_full[order][:-1])
    kinds = np.bincount(by_full[order][fresh], minlength=n)
    marks = np.concatenate([[0], np.cumsum(W.LETTERS[raw] != 0)])
    letters = (marks[offsets[1:]] - marks[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)
    shapes = np.stack([np.log2(counts + 1).astype(np.int64), 32 + (20 * kinds / np.maximum(counts, 1)).astype(np.int64),
                       64 + (40 * letters).astype(np.int64)], axis=1).astype(np.uint64)
    # Each shape as often as makes it weigh about one.
    often = np.repeat(texts, np.sqrt(np.diff(at) + counts).astype(np.int64) + 1)
    shift = np.uint64(64 - BITS)
    number = np.concatenate([bare >> shift, W.mix(full + np.uint64(1)) >> shift, *[W.mix(x[often] + np.uint64(12345)) >> shift for x in shapes.T]])
    owner = np.concatenate([by_bare, by_full, *[often] * 3])
    order = np.argsort(owner, kind="stable")
    return number[order].astype(np.int64), np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])


def _linear(weights: np.ndarray, number: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    size = np.diff(bounds)
    total = np.concatenate([[0.0], np.cumsum(weights[number], dtype=np.float64)])
    return (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(size, 1) ** 0.25


def fit(number: np.ndarray, bounds: np.ndarray, grade: np.ndarray, grades: int, rounds: int = 12, rate: float = 0.4,
        decay: float = 5e-5, least: int = 8, batch: int = 128) -> Model:
    """Weights and thresholds by stochastic gradient steps of adaptive length.

    Features in fewer than ``least`` texts keep weight 0.
    """
    texts = np.zeros(1 << BITS, np.int64)
    for a, b in zip(bounds[:-1], bounds[1:]):
        texts[np.unique(number[a:b])] += 1
    common = texts >= least
    weights, seen = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6)
    share = np.array([(grade > j).mean() for j in range(grades - 1)]).clip(1e-3, 1 - 1e-3)
    thresholds = -np.log(share / (1 - share))
    steps = np.full(grades - 1, 1e-6)
    rng = np.random.default_rng(17)
    scale = 1 / np.maximum(np.diff(bounds), 1) ** 0.25
    for _ in range(rounds):
        deal = rng.permutation(len(grade))
        for k in range(0, len(grade), batch):
            docs = deal[k:k + batch]
            sizes = bounds[docs + 1] - bounds[docs]
            at = np.repeat(bounds[docs] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            columns = number[at]
            row = np.repeat(np.arange(len(docs)), sizes)
            z = np.bincount(row, weights[columns], minlength=len(docs)) * scale[docs]
            # P(grade = g) = s(z - t_{g-1}) - s(z - t_g); the slope of its logarithm is
            # 1 - s(z - t_{g-1}) - s(z - t_g).
            above = 1 / (1 + np.exp(-(z[:, None] - thresholds[None, :])))
            edge = np.concatenate([np.ones((len(docs), 1)), above, np.zeros((len(docs), 1))], axis=1)
            g = grade[docs]
            up, down = edge[np.arange(len(docs)), g], edge[np.arange(len(docs)), g + 1]
            slope = (1 - up - down) / len(docs)
            grad = np.bincount(columns, (slope * scale[docs])[row], minlength=1 << BITS) - decay * weights
            grad[~common] = 0
            seen += grad * grad
            weights += rate * grad / np.sqrt(seen)
            chance = np.maximum(up - down, 1e-9)
            push = np.zeros(grades - 1)
            np.add.at(push, g[g > 0] - 1, -(up * (1 - up) / chance)[g > 0])
            np.add.at(push, g[g < grades - 1], (down * (1 - down) / chance)[g < grades - 1])
            push /= len(docs)
            steps += push * push
            thresholds = np.maximum.accumulate(thresholds + 0.1 * push / np.sqrt(steps))
    return Model(weights.astype(np.float32), thresholds)


def train(docs: DataFrame, ratings: DataFrame, grades: int, limit: int = 8_000) -> Model | None:
    """A model of ``ratings`` (doc_id, grade), fitted on about ``limit`` rated documents at most.

    The sample is by a hash of doc_id. Rows of NULL doc_id, grade or text are not used; of
    several grades of a document the lowest counts. None without two different grades.
    """
    rated = pick(ratings, "doc_id", "grade").where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    count = rated.count()
    if count > limit:
        rated = rated.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(limit / count * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, offsets in W.runs(batch):
                number, bounds = features(raw, offsets)
                small = number.astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("grade"), pa.array([small[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())], names=["grade", "numbers"])

    texts = pick(docs, "doc_id", "text").where("text IS NOT NULL").join(F.broadcast(rated), "doc_id")  # ``limit`` rows of two numbers
    sample = texts.select(F.col("grade").cast("int").alias("grade"), "text").mapInArrow(run, "grade int, numbers binary").toArrow()
    grade = sample.column("grade").to_numpy()
    if len(np.unique(grade)) < 2:
        return None
    sizes = np.array([len(b) // 4 for b in sample.column("numbers").to_pylist()])
    number = np.frombuffer(b"".join(sample.column("numbers").to_pylist()), np.int32)
    return fit(number, np.concatenate([[0], np.cumsum(sizes)]), grade, grades)


def rate(docs: DataFrame, model: Model | None, grades: int) -> DataFrame:
    """(doc_id, expected_grade, tail_1 .. tail_{grades - 1}) of every row; tail_j is P(grade >= j).

    A null or empty text has no words and gets what the thresholds alone say. Without a model
    all are NULL. NULL ids and repeated rows are rows like others; other columns are ignored.
    """
    plain = pick(docs, "doc_id", "text")
    names = ["expected_grade", *[f"tail_{j}" for j in range(1, grades)]]
    if model is None:
        return plain.select("doc_id", *[F.lit(None).cast("double").alias(n) for n in names])
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for rows, raw, offsets in W.runs(batch):
                z = _linear(model.weights, *features(raw, offsets))
                tails = 1 / (1 + np.exp(-(z[:, None] - model.thresholds[None, :])))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(tails.sum(axis=1)), *[pa.array(np.ascontiguousarray(t)) for t in tails.T]], names=["doc_id", *names])

    return plain.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in names))


def selected(rated: DataFrame, grade: int, chance: float = 0.5) -> DataFrame:
    """``rated`` with ``kept``: whether P(grade >= ``grade``) is at least ``chance``."""
    return rated.withColumn("kept", F.coalesce(F.col(f"tail_{grade}") >= chance, F.lit(False)))


def grades_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of a table of labels: 0 toxic, 1 of low quality, 2 good."""
    return pick(labels, "doc_id", "quality", "toxic").select(
        "doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade"))
