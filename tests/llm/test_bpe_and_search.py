"""Encoding, token counts, exact search, components and the pipeline."""

import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from letterloom.llm import bpe, lines, neardup, token_counts, topk
from letterloom.llm.components import components

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")

AWKWARD = ["", "a" * 3000, "ab" * 700, "Hello's we'll x ½ ²³ \x1c\x85  \n\n  z", "日本語テキスト " * 50, " " * 500, "\n" * 99 + "x", "%" * 77, "áé", "🙂" * 40,
           "<|endoftext|> is text", "x" * 100_000 + " y", " \t\n lead", "tail  "]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs, special_tokens={})


def ids(data):
    return [int.from_bytes(data[k:k + 4], "little") for k in range(0, len(data), 4)]


def test_pattern_is_the_published_one():
    assert bpe.PATTERN == public_tokenizers.PATTERN


def test_encoding_equals_the_library(spark, ranks, library):
    rng = random.Random(1)
    texts = [*AWKWARD, *("".join(rng.choice("abcdefghij klm\n'.,É½ß　🙂") for _ in range(rng.randrange(400))) for _ in range(60))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (7000, None), (3, texts[3])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string").repartition(3)
    out = bpe.decode(bpe.encode(docs, ranks), ranks).collect()
    want = sorted(((i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, ids(r.ids), bytes(r.decoded)) for r in out), key=repr) == want
    assert all(r.n_tokens == len(r.ids) // 4 for r in out)
    assert bpe.encode(docs.limit(0), ranks).count() == 0


def test_full_table_of_pieces_is_emptied(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 20)
    coder = bpe.Coder(ranks)
    for k in range(50):
        text = f"word{k} otherword{k} " * 5
        assert ids(coder.encode([text])[0]) == library.encode_ordinary(text)


def test_other_patterns(ranks):
    coder = bpe.Coder(ranks, r"\S+|\s+")
    assert coder.decode(coder.encode(["it's one two"])[0]) == b"it's one two" and coder.pieces("it's one") == ["it's", " ", "one"]


def test_trees_follow_edits(ranks):
    coder, rng = bpe.Coder(ranks), random.Random(5)
    letters = "ab cd  \n\n'sré12.,!? x　½"
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 30, 300, 3000])))
        tree = token_counts.Tree(coder, text)
        for _ in range(5):
            at, size = rng.randrange(len(text) + 2), rng.choice([0, 1, 2, 5, 40])
            new = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 10, 200])))
            tree.replace(at, at + size, new)
            at = min(at, len(text))
            text = text[:at] + new + text[at + size:]
            assert tree.text == text
            assert [n for sizes, _ in tree.blocks for n in sizes] == [len(p) for p in coder.pieces(text)]
            assert tree.total == len(coder.encode([text])[0]) // 4


def test_token_counts(spark, ranks, library):
    pattern = r"[a-z]+@[a-z.]+|[0-9]{4,}"
    rows = [(1, "mail ann@b.example or 123456 now"), (2, None), (3, ""), (4, "99999"), (5, "no match"), (None, "x 55555"), (6, "1234 " * 3000), (1, "mail ann@b.example or 123456 now")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_tokens int")
    import re
    got = token_counts.counted(token_counts.redactions(docs, pattern, "[gone]"), ranks).collect()
    want = []
    for i, t in rows:
        after = re.sub(pattern, "[gone]", t or "")
        want.append((i, len(library.encode_ordinary(t or "")), len(re.findall(pattern, t or "")), len(library.encode_ordinary(after))))
    assert sorted(((r.doc_id, r.n_tokens, r.n_edits, r.n_tokens_after) for r in got), key=repr) == sorted(want, key=repr)
    odd = spark.sql("""SELECT 1L AS doc_id, 'abc def' AS text, array(struct(99 AS start, 5 AS length, ' tail' AS new), struct(CAST(NULL AS INT) AS start, 1 AS length, 'x' AS new),
        struct(0 AS start, 3 AS length, CAST(NULL AS STRING) AS new)) AS edits""")
    row = token_counts.counted(odd, ranks).first()
    assert (row.n_edits, row.n_tokens_after) == (2, len(library.encode_ordinary(" def tail")))


def test_kept_trees_take_further_edits(spark, ranks, library, monkeypatch):
    """Trees stored by one run are edited by the next two; no whole text is cut again."""
    texts = {i: f"number {i} " + "some words follow here, " * 40 for i in range(30)}
    docs = spark.createDataFrame([(*r, "x") for r in texts.items()], "doc_id long, text string, source string").coalesce(1)
    trees = token_counts.grown(docs, ranks)
    assert trees.columns == ["doc_id", "source", "key", "n_pieces", "n_tokens", "lengths", "tokens"]
    trees = trees.drop("source")
    for step in range(2):
        asked = {i: t for i, t in texts.items() if i % 3 == step}
        rows = [(i, t, [(7, 1, "twelve"), (len(t) + 4, 3, " end")]) for i, t in asked.items()]
        edits = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start: int, length: int, new: string>>")
        out = token_counts.edited(edits, trees, ranks)
        want = {i: (t[:7] + "twelve" + t[8:])[:len(t) + 4] + " end" for i, t in asked.items()}
        got = {r.doc_id: r for r in out.collect()}
        assert {i: r.text for i, r in got.items()} == want
        for i, r in got.items():
            assert (r.n_tokens, r.n_edits) == (len(library.encode_ordinary(want[i])), 2) and r.n_tokens_before == len(library.encode_ordinary(asked[i]))
            assert r.n_pieces == len(r.lengths) and sum(r.lengths) == len(want[i])
        texts |= want
        # The new trees take the place of the old ones.
        fresh = token_counts._key(out).select("doc_id", "key", "n_pieces", "n_tokens", "lengths", "tokens")
        trees = trees.join(fresh.select("doc_id"), "doc_id", "left_anti").unionByName(fresh)
    same = token_counts.grown(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), ranks)
    of = lambda df: sorted((r.doc_id, r.key, r.lengths, r.tokens) for r in df.collect())
    assert of(trees) == of(same)
    cut = []
    kept = bpe.coder(ranks, bpe.PATTERN)
    monkeypatch.setattr(kept, "pieces", lambda t, f=kept.pieces: cut.append(len(t)) or f(t))
    text = "a word or two, " * 5000
    tree = token_counts.Tree(kept, text, token_counts.Tree(bpe.Coder(ranks), text).leaves())
    tree.replace(30_000, 30_004, "other")
    assert sum(cut) < 500


def test_nearest(spark):
    rng = random.Random(2)
    centre = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.6) for x in rng.choice(centre)]) for i in range(300)]
    rows += [(1000 + i, centre[0]) for i in range(100)] + [rows[0], (None, centre[0]), (5000, None), (5050, [0.5]), (5100, [None] * 64)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, code string").repartition(4)
    sign = {i: tuple(x is not None and x > 0 for x in (list(v) + [None] * 64)[:64]) for i, v in rows if i is not None and v is not None}
    want = []
    for q in sign:
        if q % 50 == 0:
            near = sorted((sum(a != b for a, b in zip(sign[q], sign[v])), v) for v in sign if v != q)[:7]
            want += [(q, n, v, d) for n, (d, v) in enumerate(near, 1)]
    got = topk.nearest(df, df.where("vec_id % 50 = 0"), bits=64, k=7)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    few = df.where("vec_id < 3")
    assert topk.nearest(few, few.where("vec_id = 0"), bits=64, k=7).count() == 2
    assert topk.nearest(df.limit(0), df, bits=64).count() == 0


def test_components(spark):
    rng = random.Random(7)
    edges = [(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1001, 1100)] + [(5, 5), (None, 3), (2000, 2001), (2001, 2000)]
    edges += [(rng.randrange(3000, 3300), rng.randrange(3000, 3300)) for _ in range(120)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages(spark, tmp_path, library):
    """Each stage against what it should do to its own input, on documents with planted cases."""
    import corpus_pipeline
    rng = random.Random(11)
    vocabulary = ["alpha", "bravo", "carol", "delta", "early", "fancy", "giant", "honey", "ivory", "jolly"]
    prose = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n))
    line, item, base = prose(10), prose(20), prose(150)
    rows = [(i, prose(80), "aa", "s", 1) for i in range(60)]
    rows += [(100 + i, prose(40) + "\n" + line, "aa", "s", 1) for i in range(6)]
    rows += [(200, base, "aa", "s", 1), (201, base + " tail", "aa", "s", 1), (202, base.upper(), None, "s", 1)]
    rows += [(300, prose(10) + " " + item + " " + prose(10), "aa", "s", 1), (400, None, "aa", "s", 1), (401, "12 34", None, "s", 1), (None, prose(50), "aa", None, None), rows[0]]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen = spark.read.parquet(str(tmp_path / "documents.parquet"))
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        seen = stage(spark, seen, str(tmp_path))
        seen.write.parquet(str(tmp_path / name))
        seen = spark.read.parquet(str(tmp_path / name))
        after[name] = seen.collect()
        if name != "encoding":
            assert seen.columns == list(corpus_pipeline.COLUMNS)
    of = lambda name: sorted((r.doc_id for r in after[name]), key=repr)
    assert of("language_id") == sorted([i for i, *_ in rows if i not in (400, 401)], key=repr)
    assert of("line_dedup") == of("language_id")
    assert [r.doc_id for r in after["line_dedup"] if line in r.text] == [105]
    assert all(r.n_chars == len(r.text) for r in after["line_dedup"])
    assert of("near_dedup") == sorted(set(of("language_id")) - {201, 202}, key=repr)
    assert of("decontamination") == sorted(set(of("near_dedup")) - {300}, key=repr)
    texts = {r.doc_id: r.text for r in after["decontamination"]}
    assert of("encoding") == of("decontamination")
    for r in after["encoding"]:
        assert ids(r.ids) == library.encode_ordinary(texts[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert {(r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {(r.doc_id, r.n_tokens) for r in after["encoding"]}


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    assert lines.line_dedup(empty).count() == 0 and neardup.near_duplicates(empty).count() == 0


def test_queries_return_the_agreed_columns(spark):
    """Schemas of the queries whose result is fixed, and one row a document."""
    from letterloom.llm.queries import QUERIES
    want = {
        "op1_url_filter": ["page_id bigint", "host string", "path string", "rule string", "verdict string"],
        "op3_near_dedup": ["doc_id bigint", "n_shingles bigint", "component_id bigint", "kept boolean"],
        "op4_bpe": ["doc_id bigint", "n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"],
        "op5_substring_dedup": ["doc_id bigint", "n_words bigint", "n_removed bigint", "kept_sha256 string"],
        "op7_line_dedup": ["doc_id bigint", "n_lines bigint", "n_dropped bigint", "kept_sha256 string"],
        "op9_language_id": ["doc_id bigint", "held_out boolean", "lang_pred string", "score double"],
    }
    for name, columns in want.items():
        df = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert [f"{c} {k}" for c, k in df.dtypes][:len(columns)] == columns
        assert df.count() == (50 if name == "op1_url_filter" else 200)
    native = QUERIES["op7_line_dedup"](spark, "/root/testdata/sf0.001")
    assert "Python" not in native._jdf.queryExecution().toString() and "Arrow" not in native._jdf.queryExecution().toString()
    assert native.where(F.col("kept_sha256").isNull()).count() == 0


def test_token_counts_make_their_edits_once(spark, ranks):
    """Edits may be costly to find, and no text but those to be edited is kept."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<struct<start:int,length:int,new:string>>")
    def edits(text):
        calls.add(1)
        return [(0, 1, "x")] if text and text.startswith("a") else [] if text else None

    rows = [(1, "apple pie"), (1, "apple pie"), (None, "a"), (2, "banana split"), (3, None), (4, ""), (5, "an  egg\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("edits", edits("text"))
    got = [tuple(r) for r in token_counts.counted(docs, ranks).collect()]
    assert calls.value == len(rows)
    coder = bpe.Coder(ranks)
    count = lambda t: len(coder.encode([t])[0]) // 4
    want = [(i, len(coder.pieces(t or "")), count(t or ""), int((t or "").startswith("a")), count("x" + t[1:] if t and t[0] == "a" else t or "")) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    left = token_counts.grown(docs, ranks, texts_with="edits").select("doc_id", "text").collect()
    assert sorted(map(str, map(tuple, left))) == sorted(str((i, t if t and t[0] == "a" else None)) for i, t in rows)
