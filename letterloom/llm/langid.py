"""Language identification by prediction by partial matching (PPM) over bytes.

Each language has a tree of byte contexts up to ``ORDER`` bytes. A byte costs -log2 of its
probability under the longest context that the tree holds; a byte new to that context costs
an escape first and is then coded one order lower among the bytes not yet ruled out, down to
a uniform order. Statistics are frozen after training, so the cost of each byte after each
context is fixed and laid out once in a table; the cost of a text is a sum of look-ups, and
the language with the shortest code wins.

Each language's tree is learned by itself, in a group of its own, from a bounded sample of
its labelled documents, about ``per_lang`` by a hash of their ids, whole texts. Contexts that
the language has fewer than ``least`` times, and any past its ``contexts`` most frequent of
each length, are cut; their bytes are coded by the next shorter one. There is no bound on the
number of languages: tasks hold the tables of a block of them at a time.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.llm import words as W
from letterloom.llm.tables import pick, stored

ORDER = 3
PAD = 10  # texts begin as after line breaks
#: A-Z count as a-z, so that texts in capitals are known by the same contexts.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] = FOLD[97:123]
UNKNOWN = "und"
#: Tables that a task holds at a time; languages past this are a further block.
BLOCK_BYTES = 128 << 20
PART_BYTES = 1 << 20


@dataclass
class Model:
    langs: list[str]
    symbols: np.ndarray   # byte -> symbol; bytes never seen share the last one
    context: np.ndarray   # code of the last ORDER symbols -> row of the context in use
    bits: np.ndarray      # (context, symbol) -> cost in each language


@dataclass
class Trained:
    """The models of all languages, as a table; ``blocks`` has their names, in order."""
    parts: DataFrame
    blocks: list[list[str]]

    def block(self, k: int) -> list[Model]:
        parts: dict[str, dict[int, bytes]] = {name: {} for name in self.blocks[k]}
        for r in self.parts.where(F.col("lang").isin(self.blocks[k])).toLocalIterator():
            parts[r["lang"]][r["part"]] = bytes(r["data"])
        return [pickle.loads(b"".join(parts[name][i] for i in range(len(parts[name])))) for name in self.blocks[k]]


def held_out(doc_id: Column) -> Column:
    """Documents kept apart from training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, raw, offsets in W.runs(batch):
            raw = FOLD[raw]
            code = _history(raw.astype(np.int64), offsets, 256, PAD) << 8 | raw
            lang = rows.column("lang").dictionary_encode()
            owner = np.repeat(lang.indices.to_numpy(), np.diff(offsets)).astype(np.int64)
            keys, counts = np.unique(owner << 32 | code, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [lang.dictionary.take(pa.array(keys >> 32)), pa.array(keys & 0xFFFFFFFF), pa.array(counts)], names=["lang", "gram", "n"])


def _history(symbols: np.ndarray, offsets: np.ndarray, base: int, pad: int) -> np.ndarray:
    """The ORDER symbols before each, as one number; what lies before a text is ``pad``."""
    out = np.zeros(len(symbols), symbols.dtype)
    starts = offsets[:-1][np.diff(offsets) > 0]
    for back in range(ORDER, 0, -1):
        prior = np.empty_like(symbols)
        prior[back:] = symbols[:-back]
        for k in range(back):
            at = starts + k
            prior[at[at < len(symbols)]] = pad
        out *= base
        out += prior
    # A text shorter than ORDER lets pads of one text reach into the next; those were written
    # after its own symbols were read, so mend the first positions of every text in turn.
    short = np.flatnonzero((np.diff(offsets) > 0) & (np.diff(offsets) < ORDER))
    for t in short:
        for text in (t, t + 1, t + 2, t + 3):
            if text >= len(offsets) - 1:
                break
            a, b = offsets[text], offsets[text + 1]
            for i in range(a, min(b, a + ORDER)):
                past = [pad] * ORDER + symbols[a:i].tolist()
                value = 0
                for s in past[-ORDER:]:
                    value = value * base + s
                out[i] = value
    return out


def train(docs: DataFrame, per_lang: int = 1500, contexts: int = 20_000, least: int = 3) -> Trained | None:
    """Trees of every language with labelled documents; None when there are no labels.

    Rows of NULL id, text or lang and held-out documents are never learned from.
    """
    known = pick(docs, "doc_id", "text", "lang").where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL AND lang <> ''")
    known = known.where(~held_out(F.col("doc_id")))
    # A row a language reaches the driver. Languages of no more than ``per_lang`` are learned whole.
    large = [F.lit(x) for r in known.groupBy("lang").count().where(F.col("count") > per_lang).collect() for x in (r["lang"], per_lang / r["count"])]
    share = F.coalesce(F.element_at(F.create_map(*large), F.col("lang")), F.lit(1.0)) if large else F.lit(1.0)
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    grams = sample.select("lang", "text").mapInArrow(_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        model = fit(rows["lang"].to_numpy(), rows["gram"].to_numpy(np.int64), rows["n"].to_numpy(np.float64), contexts, least)
        data = pickle.dumps(model)
        data = [data[i:i + PART_BYTES] for i in range(0, len(data), PART_BYTES)]
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "part": range(len(data)), "data": data})

    # A group has what about ``per_lang`` documents hold, however large the language.
    parts = stored(grams.groupBy("lang").applyInPandas(learn, "lang string, part int, data binary"), "language-models")
    blocks, held = [], BLOCK_BYTES + 1
    for name, size in sorted(tuple(r) for r in parts.groupBy("lang").agg(F.sum(F.octet_length("data"))).collect()):
        if held + size > BLOCK_BYTES:
            blocks.append([])
            held = 0
        blocks[-1].append(name)
        held += size
    return Trained(parts, blocks) if blocks else None


def fit(lang: np.ndarray, gram: np.ndarray, n: np.ndarray, contexts: int, least: int) -> Model:
    """The table of costs from counts of ORDER + 1 bytes in each language."""
    names, owner = np.unique(lang.astype(str), return_inverse=True)
    parts = np.stack([gram >> (8 * k) & 255 for k in range(ORDER, -1, -1)])
    seen = np.union1d(np.unique(parts), [PAD])
    size = len(seen) + 1
    symbols = np.full(256, size - 1, np.int64)
    symbols[seen] = np.arange(len(seen))
    parts = symbols[parts]
    count = len(names)
    # Order -1: all 256 bytes alike; the last symbol stands for every byte never seen.
    below = np.full((1, count, size), 1 / 256)
    below[:, :, -1] = max(1, 256 - len(seen)) / 256
    below_code = np.zeros(1, np.int64)
    chosen = np.zeros(1, np.int64)  # row of each code of the order in hand
    rows, total = [], 0
    for order in range(ORDER + 1):
        code = np.zeros(len(gram), np.int64)
        for k in range(order):
            code = code * size + parts[ORDER - order + k]
        known, at = np.unique(code, return_inverse=True)
        weight = np.bincount(at, n)
        good = np.flatnonzero(weight >= (least if order else 0))
        if len(good) > contexts:
            good = np.sort(good[np.argsort(-weight[good], kind="stable")[:contexts]])
        place = np.full(len(known), -1)
        place[good] = np.arange(len(good))
        use = place[at] >= 0
        table = np.zeros((len(good), count, size))
        np.add.at(table, (place[at][use], owner[use], parts[ORDER][use]), n[use])
        # The context one shorter drops the oldest symbol.
        shorter = known[good] % size**(order - 1) if order else np.zeros(len(good), np.int64)
        low = below[chosen[shorter]] if order else np.repeat(below, len(good), axis=0)
        events, kinds = table.sum(axis=2, keepdims=True), (table > 0).sum(axis=2, keepdims=True)
        rest = np.where(table > 0, 0, low)
        left = rest.sum(axis=2, keepdims=True)
        escape = np.where(left > 0, kinds / np.maximum(events + kinds, 1) / np.maximum(left, 1e-300), 0)
        prob = np.where(events > 0, np.where(table > 0, table / np.maximum(events + kinds, 1), rest * escape), low)
        rows.append(prob)
        # Codes without a context of this order keep the row of the shorter one.
        if order:
            index = np.arange(size**order) % size**(order - 1)
            chosen = chosen[index]
            below = np.concatenate([below, prob])
            chosen[known[good]] = total + np.arange(len(good))
        else:
            below = prob
        total += len(good)
    bits = -np.log2(np.maximum(below, 1e-12)).transpose(0, 2, 1)
    spread = np.zeros(size)
    spread[-1] = np.log2(max(1, 256 - len(seen)))  # which of the unseen bytes it was
    bits = bits + spread[None, :, None]
    return Model(names.tolist(), symbols.astype(np.int32), chosen.astype(np.int32), np.ascontiguousarray(bits.reshape(-1, count), np.float32))


def code_lengths(model: Model, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits that each text takes in each language."""
    size = int(model.symbols.max()) + 1
    s = model.symbols[FOLD[raw]]
    row = model.context[_history(s, offsets, size, int(model.symbols[PAD]))]
    row *= size
    row += s
    out = np.zeros((len(offsets) - 1, len(model.langs)))
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(model.bits[row], offsets[full], axis=0, dtype=np.float64)
    return out


def predict(docs: DataFrame, model: Trained | None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry``, lang_pred, score and bits_per_byte of every row, whole texts.

    ``score`` is the probability of the language that wins, all being as likely beforehand;
    the first by name wins a tie. A null text or one without letters is ``und`` with score 0;
    so are all texts where nothing was learned.
    """
    texts = pick(docs, *dict.fromkeys((*carry, "text")))
    worded = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    if model is None:
        return texts.select(*carry, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
    # So far: the best language, its bits, and the sum of 2 ** (those bits - bits) of all languages.
    schema = ", ".join(f"`{c}` {t}" for c, t in texts.dtypes) + ", _best string, _bits double, _sum double"
    for k in range(len(model.blocks)):
        texts = texts.mapInArrow(_coded(docs.sparkSession.sparkContext.broadcast(model.block(k)), k > 0), schema)
        if k < len(model.blocks) - 1:
            texts = stored(texts, "language-costs")  # or the tasks of all blocks would run, and hold their tables, at once
    return texts.select(*carry, F.when(worded, F.col("_best")).otherwise(UNKNOWN).alias("lang_pred"), F.when(worded, 1 / F.col("_sum")).otherwise(0.0).alias("score"),
                        F.when(F.octet_length("text") > 0, F.col("_bits") / F.octet_length("text")).alias("bits_per_byte"))


def _coded(held, further: bool):
    """Code lengths by the models ``held``; ``further`` batches have those of earlier ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = held.value
        names = np.array([m.langs[0] for m in models], object)
        for batch in batches:
            for rows, raw, offsets in W.runs(batch):
                bits = np.column_stack([code_lengths(m, raw, offsets)[:, 0] for m in models])
                best = bits.argmin(axis=1)
                least = bits[np.arange(len(bits)), best]
                total = np.exp2(least[:, None] - bits).sum(axis=1)
                best = names[best]
                if further:
                    past, least_past, total_past = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("_best", "_bits", "_sum"))
                    best = np.where(least_past <= least, past, best)
                    both = np.minimum(least, least_past)
                    total = total * np.exp2(both - least) + total_past * np.exp2(both - least_past)
                    least = both
                    rows = rows.select([c for c in rows.schema.names if c not in ("_best", "_bits", "_sum")])
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(best, pa.string()), pa.array(least), pa.array(total)],
                                                 names=[*rows.schema.names, "_best", "_bits", "_sum"])

    return run


def recognised(docs: DataFrame, model: Trained | None, carry: tuple[str, ...], most_bits: float = 6.5) -> DataFrame:
    """The columns ``carry`` of the rows in a language that was learned.

    Texts without letters go, and those that no tree brings below ``most_bits`` a byte: prose
    takes about 2, bytes in no learned script 8 and more.
    """
    return predict(docs, model, carry).where(f"lang_pred <> '{UNKNOWN}' AND bits_per_byte <= {most_bits}").select(*carry)
