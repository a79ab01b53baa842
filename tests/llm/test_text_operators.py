"""The operators on text against brute force, with the awkward rows that any table may have."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from letterloom.llm import decontam, langid, lines, neardup, quality, substrings, urls
from letterloom.llm import words as W

WORDS = [a + b for a in ("ka", "lo", "mi", "ru", "te", "so") for b in ("n", "ra", "vel", "x", "dim", "ot", "pa", "gri")]
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(rng):
    """Texts with copies, edited copies, shared lines and passages, and rows that break things."""
    rows = []
    line = prose(rng, 12)
    passage = prose(rng, 60)
    base = prose(rng, 200)
    for i in range(40):
        text = prose(rng, rng.choice([1, 3, 8, 40, 120]))
        if i % 3 == 0:
            text += "\n \t" + (line.upper() if i % 2 else line) + "\r\nend"
        if i % 5 == 0:
            text += "\n" + passage + " " + prose(rng, 4)
        rows.append((i, text))
    for i in range(40, 60):
        words = base.split()
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((i, " ".join(words)))
    rows += [(60, rows[3][1]), (61, rows[3][1].upper()), (62, None), (63, ""), (64, " \n\n "), (65, "É" * 50 + "\n" + line), (66, "word " * 30_000)]
    rows += [(None, base), (None, None), rows[41]]
    return rows


@pytest.fixture(scope="module", params=[1, 2])
def case(request, spark):
    rows = corpus(random.Random(request.param))
    df = spark.createDataFrame([(i, t, "x", 7, "y") for i, t in rows], "doc_id long, text string, component_id string, n_words int, top string")
    return rows, df.repartition(5)


def checked(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_words_match_the_pattern():
    import pyarrow as pa
    texts = ["a  b\tc", None, "", "É é\x0bx", " lead ", "same same Same", "x"]
    for _, raw, offsets in W.runs(pa.record_batch({"text": pa.array(texts)})):
        hashes, starts, bounds = W.words(raw, offsets, W.PLAIN)
        ends = W.word_ends(raw, offsets, W.PLAIN)
        got = [raw[a:b].tobytes().decode() for a, b in zip(starts, ends)]
        assert got == [w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        assert len(set(hashes.tolist())) == len(set(got))
        assert list(bounds) == [0, 3, 3, 3, 6, 7, 10, 11]


def test_line_dedup(case, spark):
    rows, df = case
    split = [((t or "").split("\n"), i) for i, t in rows]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    holders = collections.defaultdict(set)
    for ls, i in split:
        for x in ls:
            if i is not None and len(key(x)) >= 40:
                holders[key(x)].add(i)
    want = []
    for ls, i in split:
        left = [x for x in ls if i is None or len(holders.get(key(x), ())) < 5 or i == max(holders[key(x)])]
        want.append((i, len(ls), len(ls) - len(left), "\n".join(left)))
    assert any(w[2] for w in want)
    assert checked(lines.line_dedup(df), ["doc_id", "n_lines", "n_dropped", "kept"]) == sorted(want, key=repr)


def test_line_dedup_of_a_key_over_many_partitions(spark):
    line = "a line that a third of all rows of the table hold"
    docs = spark.range(3000).selectExpr("id AS doc_id", f"if(id % 3 = 0, '{line}', concat('own line number ', id, ' which is long enough to be judged')) AS text")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = lines.line_dedup(docs).where("n_dropped > 0")
        assert got.count() == 999 and got.agg(F.max("doc_id")).first()[0] == 2994
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def brute_components(rows):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
        sets.append(frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b, (j, _) in enumerate(rows[:a]):
            both = len(sets[a] & sets[b])
            if None not in (i, j) and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(i, len(s), None if i is None else find(i), i is None or find(i) == i) for (i, _), s in zip(rows, sets)]


def test_near_duplicates(case):
    rows, df = case
    want = brute_components(rows)
    assert len({w[2] for w in want}) < 60
    assert checked(neardup.near_duplicates(df), ["doc_id", "n_shingles", "component_id", "kept"]) == sorted(want, key=repr)


def test_near_duplicates_in_a_group_of_edited_copies(spark):
    """Copies of one text with 0 to 9 edits: some are near the original only, some near none."""
    rng = random.Random(4)
    base, rows = prose(rng, 120).split(), []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(10)):
            words[rng.randrange(120)] = f"w{rng.randrange(9999)}"
        rows.append((i, " ".join(words)))
    got = checked(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), ["doc_id", "n_shingles", "component_id", "kept"])
    assert got == sorted(brute_components(rows), key=repr)


def test_signature_comparison_in_sql(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (60, neardup.HASHES), dtype=np.uint8)
    b = np.where(rng.random((60, neardup.HASHES)) < rng.random((60, 1)), a, rng.integers(0, 256, (60, neardup.HASHES), dtype=np.uint8))
    bounds = neardup.batch_bounds(0.75, 1e-4)
    want = [all((x[:neardup.BATCH * (k + 1)] == y[:neardup.BATCH * (k + 1)]).sum() >= n for k, n in enumerate(bounds)) for x, y in zip(a, b)]
    rows = [(x.view(np.int64).tolist(), y.view(np.int64).tolist()) for x, y in zip(a, b)]
    got = [r[0] for r in spark.createDataFrame(rows, "a array<long>, b array<long>").selectExpr(neardup.survives("a", "b", bounds)).collect()]
    assert got == want and any(want) and not all(want)


def test_batch_bounds_keep_what_is_similar():
    """The chance that a pair right at the bound is ruled out stays near ``miss``."""
    import numpy as np
    bounds = neardup.batch_bounds(0.75, 1e-2)
    same = (np.random.default_rng(1).random((20_000, neardup.HASHES)) < 0.75).cumsum(axis=1)
    lost = np.any([same[:, neardup.BATCH * (k + 1) - 1] < n for k, n in enumerate(bounds)], axis=0).mean()
    assert lost < 5e-2 and bounds == sorted(bounds)


def test_substring_dedup(case):
    rows, df = case
    first, texts = {}, [(i, (t or "").split(None) if t and t.isascii() else re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, w in texts:
        for k in range(len(w) - 49):
            if i is not None:
                run = tuple(w[k:k + 50])
                first[run] = min(first.get(run, i), i)
    want = []
    for i, w in texts:
        gone = set()
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k:k + 50])] < i:
                gone.update(range(k, k + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert any(0 < x[2] < x[1] for x in want)
    assert checked(substrings.substring_dedup(df), ["doc_id", "n_words", "n_removed", "kept_sha256"]) == sorted(want, key=repr)


def removed_by_brute_force(rows):
    """(doc_id, n_words, n_removed, kept_sha256) of each (doc_id, text)."""
    first, want = {}, []
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 49):
            run = tuple(w[k:k + 50])
            first[run] = min(first.get(run, i), i)
    for i, t in rows:
        w, gone = t.split(), set()
        for k in range(len(w) - 49):
            if first[tuple(w[k:k + 50])] < i:
                gone.update(range(k, k + 50))
        want.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(want, key=repr)


def test_substring_dedup_of_a_passage_repeated_in_one_document(spark):
    """The smaller document is in another batch than the one that has the passage several times."""
    rng = random.Random(17)
    passage, looped = prose(rng, 75), prose(rng, 60)
    rows = [(1, f"{prose(rng, 20)} {passage} {prose(rng, 9)}"), (2, f"{looped} {prose(rng, 31)}"),
            (7, " ".join(f"{prose(rng, 5 + 13 * k)} {passage}" for k in range(4)) + f" {looped} {prose(rng, 3)} {looped}"),
            # One doc_id with two texts, and a later document in the batch of the repeating one.
            (9, f"{passage} {prose(rng, 40)} {passage}"), (9, f"{prose(rng, 2)} {passage}"), (12, f"{prose(rng, 66)} {passage}")]
    docs, size = spark.createDataFrame(rows, "doc_id long, text string"), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        for rows_a_batch in (1, 2, 100):
            spark.conf.set(size, rows_a_batch)
            got = checked(substrings.substring_dedup(docs), ["doc_id", "n_words", "n_removed", "kept_sha256"])
            assert got == removed_by_brute_force(rows)
    finally:
        spark.conf.set(size, before)
    assert min(x[2] for x in removed_by_brute_force(rows) if x[0] == 7) >= 4 * 75 + 2 * 60


def test_difference_covers():
    for period, cover in substrings.COVERS.items():
        for i in range(period):
            assert any((i + d) % period in cover and d % period in cover for d in range(period))


def test_decontamination(spark):
    rng = random.Random(9)
    items = [(k, prose(rng, n)) for k, n in enumerate([5, 11, 14, 19, 25, 36, 60, 120] * 6)] + [(None, prose(rng, 30)), (900, None), (901, ""), (902, items_text := prose(rng, 20)), (903, items_text)]
    docs, want = [], set()
    for k, (item, text) in enumerate(items[:48]):
        words = text.split()
        edits = (0, 0, len(words) // 10, len(words) * 3 // 20)[k % 4]
        for _ in range(edits):
            words[rng.randrange(len(words))] = "other"
        docs.append((k, prose(rng, rng.randrange(50)) + " " + " ".join(words).upper() + ", " + prose(rng, 40)))
        want.add((k, item))
    docs += [(100, items[48][1]), (101, None), (102, ""), (103, items_text), (None, items_text), (104, prose(rng, 3000))]
    want |= {(100, None), (103, 902), (103, 903), (None, 902), (None, 903)}
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, edits int").repartition(3)
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    found = decontam.contaminated(d, b).collect()
    pairs = {(r.doc_id, r.item_id) for r in found}
    # Short items may turn up in random prose of few words; what was planted must be there.
    assert len(want & pairs) >= 0.95 * len(want) and (103, 902) in pairs and (100, None) in pairs
    texts, bench = dict(docs), dict(items)
    for r in found:
        if r.doc_id is not None and r.item_id is not None:
            assert r.edits == brute_edits(bench[r.item_id], texts[r.doc_id]) <= r.item_words * 0.2
    left = decontam.clean(d, b)
    assert left.columns == d.columns
    assert {r.doc_id for r in left.collect()} == {i for i, _ in docs} - {i for i, _ in pairs}
    assert decontam.clean(d, b.limit(0)).count() == len(docs) and decontam.contaminated(d.limit(0), b).count() == 0


def brute_edits(item, text):
    norm = lambda t: re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", t.translate(FOLD))
    a, b = norm(item), norm(text)
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination_recall_at_the_rate_limit():
    import pyarrow as pa
    rng = random.Random(21)
    items = [(k, prose(rng, rng.randrange(11, 70))) for k in range(150)]
    block, texts = decontam.make_block(items), []
    for _, text in items:
        words = text.split()
        for _ in range(int(0.2 * len(words))):
            words[rng.randrange(len(words))] = f"q{rng.randrange(999)}"
        texts.append(prose(rng, rng.randrange(30, 60)) + " " + " ".join(words) + " " + prose(rng, 50))
    raw, offsets = W.text_bytes(pa.array(texts))
    hashes, _, bounds = W.words(raw, offsets, W.LETTERS)
    found = decontam.matches(block, hashes, bounds, 0.2)
    assert sum((k, k) in found for k in range(150)) >= 0.93 * 150


def test_decontamination_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    items = [(k, prose(rng, 30)) for k in range(20)]
    d = spark.createDataFrame([(k, "x " + t) for k, t in items], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 3)
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(d, b).collect()} >= {(k, k) for k in range(20)}
    assert decontam.clean(d, b).count() == 0


def test_language_costs_are_those_of_ppm():
    """The table against PPM with exclusion, one byte at a time."""
    import numpy as np
    text = {"a": b"abracadabra abba", "b": b"bcbcbcaab cc"}
    counts = collections.Counter()
    for lang, t in text.items():
        padded = b"\n\n\n" + t
        for i in range(3, len(padded)):
            counts[lang, int.from_bytes(padded[i - 3:i + 1], "big")] += 1
    keys = list(counts)
    model = langid.fit(np.array([k[0] for k in keys], object), np.array([k[1] for k in keys]), np.array([counts[k] for k in keys], float), 10_000, 0)

    def prob(lang, context, order):
        """Probabilities of all 256 bytes after ``context``, as PPM with exclusion codes them."""
        below = [1 / 256] * 256 if order == 0 else prob(lang, context, order - 1)
        after = collections.Counter()
        for (l, g), n in counts.items():
            gram = g.to_bytes(4, "big")
            if l == lang and gram[3 - order:3] == context[3 - order:]:
                after[gram[3]] += n
        if not after:
            return below
        total, kinds = sum(after.values()), len(after)
        left = sum(p for b, p in enumerate(below) if b not in after)
        return [after[b] / (total + kinds) if b in after else kinds / (total + kinds) * p / left for b, p in enumerate(below)]

    data = b"abcab?zabra"
    got = langid.code_lengths(model, np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]
    for k, lang in enumerate(model.langs):
        padded = b"\n\n\n" + data
        want = -sum(np.log2(prob(lang, padded[i - 3:i], 3)[padded[i]]) for i in range(3, len(padded)))
        assert abs(got[k] - want) < 1e-3
    assert got[0] < got[1]


def test_language_id(spark):
    rng = random.Random(8)
    other = [w[::-1] + "ü" for w in WORDS]
    rows = []
    for i in range(400):
        vocabulary, lang = (WORDS, "aa") if i % 2 else (other, "bb")
        rows.append((i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 5, 60]))), None if i % 7 == 0 else lang, "s"))
    rows += [(500, None, "aa", "s"), (501, "", "aa", "s"), (502, "12 34 --", "bb", "s"), (None, "kan lora", "aa", "s"), rows[1], (503, "x" * 200_000, "aa", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(4)
    model = langid.train(docs)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert langid.predict(docs, model).count() == len(rows)
    right = [got[i].lang_pred == ("aa" if i % 2 else "bb") for i in range(400) if len(rows[i][1]) > 10]
    assert sum(right) >= 0.98 * len(right)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (500, 501, 502))
    assert all(0 <= r.score <= 1 for r in got.values())
    import zlib
    held = docs.where("doc_id IS NOT NULL").select("doc_id", langid.held_out(F.col("doc_id"))).collect()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in held) and any(h for _, h in held)
    nothing = docs.where("lang = 'zz'")
    assert langid.train(nothing) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_no_language_pays_for_the_size_of_another(spark):
    """A rare language costs the same beside a large one as alone, when table bounds are reached."""
    rng = random.Random(21)
    other = [w[::-1] + "ü" for w in WORDS]
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(60)), "aa") for i in range(300)]
    rows += [(i, " ".join(rng.choice(other) for _ in range(9)), "bb") for i in range(300, 312)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    rare = docs.where("lang = 'bb'")
    alone, beside = (checked(langid.predict(rare, langid.train(d, contexts=10)), ["doc_id", "lang_pred", "bits_per_byte"]) for d in (rare, docs))
    assert [x[:2] for x in beside] == [(i, "bb") for i in range(300, 312)]
    assert all(abs(a[2] - b[2]) < 1e-4 for a, b in zip(alone, beside))


def test_more_languages_than_a_block_holds(spark, monkeypatch):
    rng = random.Random(22)
    rows = []
    for k in range(205):
        vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(4)]
        rows += [(10 * k + j, " ".join(rng.choice(vocabulary) for _ in range(30)), f"l{k:03}") for j in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").where(~langid.held_out(F.col("doc_id")))
    whole = langid.train(docs)
    size = whole.parts.agg(F.sum(F.octet_length("data"))).first()[0]
    monkeypatch.setattr(langid, "BLOCK_BYTES", size // 2)
    split = langid.train(docs)
    assert len(whole.blocks) == 1 and len(split.blocks) in (2, 3)
    columns = ["doc_id", "lang_pred", "score", "bits_per_byte"]
    one, more = (checked(langid.predict(docs, m), columns) for m in (whole, split))
    names = {i: lang for i, _, lang in rows}
    assert len({names[x[0]] for x in one}) > 200
    assert all(x[1] == names[x[0]] for x in one)
    assert [x[:2] for x in one] == [x[:2] for x in more] and all(abs(a[k] - b[k]) < 1e-9 for a, b in zip(one, more) for k in (2, 3))


def test_quality(spark):
    rng = random.Random(6)
    docs, ratings = [], []
    for i in range(900):
        grade = rng.choice([0, 1, 2])
        text = prose(rng, 60).split()
        if grade == 0:
            text[rng.randrange(60)] = "vile"
            text[rng.randrange(60)] = "vile"
        if grade == 1:
            text = [w + "***" for w in text]
        docs.append((i, " ".join(text), "x"))
        ratings.append((i, grade, 1))
    docs += [(2000, None, "x"), (2001, "", "x"), (None, "kan", "x"), docs[0]]
    ratings += [(None, 1, 1), (3, None, 1), ratings[5]]
    d = spark.createDataFrame(docs, "doc_id long, text string, grade string")
    r = spark.createDataFrame(ratings, "doc_id long, grade int, text int")
    model = quality.train(d, r.where("doc_id % 5 <> 0"), 3)
    assert list(model.thresholds) == sorted(model.thresholds)
    out = quality.selected(quality.rate(d, model, 3), 2).collect()
    assert len(out) == len(docs)
    truth = {i: g for i, g, _ in ratings if g is not None}
    held = [x for x in out if x.doc_id is not None and x.doc_id < 2000 and x.doc_id % 5 == 0]
    assert sum(x.kept == (truth[x.doc_id] == 2) for x in held) >= 0.9 * len(held)
    assert all(x.tail_1 >= x.tail_2 and abs(x.expected_grade - x.tail_1 - x.tail_2) < 1e-9 for x in out)
    assert quality.train(d, r.where("grade = 1"), 3) is None
    assert not any(x.kept for x in quality.selected(quality.rate(d, None, 3), 2).collect())


def test_ordinal_fit_climbs_the_likelihood_to_its_top():
    """The fit against plain gradient ascent on the likelihood, written out document by document."""
    import math

    import numpy as np
    rng = random.Random(12)
    numbers, grades = [], []
    for _ in range(400):
        grade = rng.choice([0, 1, 2])
        kinds = [5, 6, 7, 8][: 2 + grade] if rng.random() < 0.8 else [5, 6, 7, 8]
        numbers.append([rng.choice(kinds) for _ in range(8)])
        grades.append(grade)
    number, bounds = np.array([x for n in numbers for x in n]), np.arange(0, 8 * 400 + 1, 8)
    model = quality.fit(number, bounds, np.array(grades), 3, rounds=60, decay=0.0, batch=400)

    def s(x):
        return 1 / (1 + math.exp(-x))

    def likelihood(w, t):
        total = 0.0
        for n, g in zip(numbers, grades):
            z = sum(w[x] for x in n) / 8 ** 0.25
            total += math.log((s(z - t[g - 1]) if g else 1.0) - (s(z - t[g]) if g < 2 else 0.0))
        return total / len(grades)

    w, t, h = {k: 0.0 for k in (5, 6, 7, 8)}, [-0.5, 0.5], 1e-5
    for _ in range(150):
        base = likelihood(w, t)
        dw = {k: (likelihood(w | {k: w[k] + h}, t) - base) / h for k in w}
        dt = [(likelihood(w, [x + h * (i == j) for j, x in enumerate(t)]) - base) / h for i in range(2)]
        w = {k: w[k] + 1.0 * dw[k] for k in w}
        t = [x + 1.0 * d for x, d in zip(t, dt)]
    best, got = likelihood(w, t), likelihood({k: float(model.weights[k]) for k in w}, list(model.thresholds))
    start = likelihood({k: 0.0 for k in w}, [-0.5, 0.5])
    assert got >= best - 0.05 * (best - start) and start < best - 0.05
    # The probabilities that are reported are those of the model.
    z = quality._linear(model.weights, number, bounds)
    assert abs(z[0] - sum(float(model.weights[x]) for x in numbers[0]) / 8 ** 0.25) < 1e-6


def test_url_quantile_is_that_of_sorting(spark):
    import numpy as np
    rng = random.Random(4)
    values = [rng.choice([rng.random(), 0.5]) for _ in range(301)]
    df = spark.createDataFrame([(f"t{i}", v) for i, v in enumerate(values)], "text string, score double").repartition(5)
    for share in (0.0, 0.5, 0.99, 1.0):
        assert abs(urls.quantile(df, share) - float(np.quantile(values, share))) < 1e-12
    assert urls.quantile(df.limit(0), 0.99) is None and urls.quantile(df.where("text = 't7'"), 0.99) == values[7]


def test_url_scores_see_the_query(spark):
    rng = random.Random(13)
    rows = [(i, f"http://{rng.choice(WORDS)}.com/go?to={'casino-' if i % 7 == 0 else ''}{rng.choice(WORDS)}") for i in range(1200)]
    rows += [(2000 + i, f"http://casino-{rng.choice(WORDS)}.com/") for i in range(60)]
    got = urls.url_filter(spark.createDataFrame(rows, "page_id long, url string"), false_rejects=0.2).collect()
    told = [r.score for r in got if r.page_id < 2000 and r.page_id % 7 == 0]
    plain = [r.score for r in got if r.page_id < 2000 and r.page_id % 7]
    assert sum(told) / len(told) > sum(plain) / len(plain) + 0.5
    assert all(r.path == "/go" for r in got if r.page_id < 2000)


def test_url_rules(spark):
    rows = [(1, "http://a.NET/x"), (2, "https://sub.example.net/en/5?q"), (3, "http://example.net/fr/"), (4, "http://example.com/de/1"), (5, "http://example.com/den"),
            (6, "http://x.org/fr/#a"), (7, "http://notexample.com/de/1"), (8, None), (9, "no url"), (10, "http://"), (11, "http://q.net"), (12, "x://É.Org/FR/"), (None, "http://a.net/x"), (1, "http://a.NET/x"),
            (13, "http://h.com?a://b/c"), (14, "http://long.com/" + "a" * 50_000)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, host int, score string")
    got = [tuple(r)[:5] for r in urls.url_filter(df).collect()]
    want = [(1, "a.net", "/x", "net/", "block"), (2, "sub.example.net", "/en/5", "example.net/en/", "allow"), (3, "example.net", "/fr/", "net/", "block"),
            (4, "example.com", "/de/1", "example.com/de/", "block"), (6, "x.org", "/fr/", "org/fr/", "allow"), (8, "", "", None, "block"), (9, "", "", None, "block"), (10, "", "", None, "block"),
            (None, "a.net", "/x", "net/", "block"), (1, "a.net", "/x", "net/", "block")]
    for row in set(want):
        assert got.count(row) == want.count(row), row
    parsed = {r[0]: r[1:3] for r in got}
    assert len(got) == len(rows) and parsed[11] == ("q.net", "") and parsed[12] == ("É.org", "/FR/") and parsed[13] == ("h.com", "")
    assert urls.url_filter(df.limit(0)).count() == 0


def test_url_scores(spark):
    """Weights against the smoothed models, one character at a time."""
    from math import log
    examples = [("abc.com/a", False), ("abd.com/b", False), ("cas.com/a", True), ("casino.com", True)]
    table, each = urls.weights(spark.createDataFrame(examples, "text string, rejected boolean"))
    texts = ["abc.com/x", "zzz", "casino.com/a", "c"]
    got = {r.text: r.score for r in urls.scores(spark.createDataFrame([(t,) for t in texts], "text string"), table, each).collect()}

    def logp(kind, text):
        train, total = [t + "\n" for t, k in examples if k == kind], 0.0
        for i, c in enumerate(text + "\n"):
            p = 1 / 65536
            for order in range(min(i, urls.ORDER) + 1):
                ctx = (text + "\n")[i - order:i]
                after = [t[j + order] for t in train for j in range(len(t) - order) if t[j:j + order] == ctx]
                if after:
                    p = (after.count(c) + len(set(after)) * p) / (len(after) + len(set(after)))
            total += log(p)
        return total

    for t in texts:
        assert abs(got[t] - (logp(True, t) - logp(False, t)) / (len(t) + 1)) < 1e-9
    few, _ = urls.weights(spark.createDataFrame([("a.com", False)], "text string, rejected boolean"))
    assert few.count() == 0


def test_url_filter_learns_from_seeds(spark):
    rng = random.Random(3)
    rows = [(i, f"http://{'casino' if i % 9 == 0 else rng.choice(WORDS)}{'-' if i % 9 == 0 else ''}{rng.choice(WORDS)}.com/{rng.choice(WORDS)}") for i in range(1500)]
    got = urls.url_filter(spark.createDataFrame(rows, "page_id long, url string")).collect()
    bad = [r.verdict for r in got if r.page_id % 9 == 0]
    good = [r.verdict for r in got if r.page_id % 9]
    assert bad.count("block") >= 0.95 * len(bad) and good.count("block") <= 0.03 * len(good)


def test_substring_dedup_of_short_texts(spark):
    """Batches without a text of one window: one row, two rows, none."""
    for texts in ([], ["a b c"], ["w " * 10, "x " * 10], [None], [""], ["y " * 49, "y " * 49], ["z " * 50, "z " * 50, "short text of few words " * 4]):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
        got = {r.doc_id: r.n_removed for r in substrings.substring_dedup(docs).collect()}
        assert got == {i: 50 if i and t and t.split() == ["z"] * 50 else 0 for i, t in enumerate(texts)}
