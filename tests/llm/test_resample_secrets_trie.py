"""Resampling, secret scans and the conversation trie against brute force."""

import base64
import bz2
import collections
import gzip
import hashlib
import math
import random
import re
import zlib
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from letterloom.llm import resample, secret_scan, turn_trie

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Resampling

def bag(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute_resample(rows, target, percent, min_words, buckets, seed):
    def hashed(texts):
        return collections.Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in bag(t)[1])

    s, t = hashed(x for _, x in rows), hashed(target)
    total, aim = sum(s.values()), sum(t.values())
    out = []
    for i, text in rows:
        words, features = bag(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (aim + buckets))))
                 for b in (zlib.crc32(f.encode()) % buckets for f in features)]
        weight = sum(gains) // len(gains) if gains else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        out.append([i, len(words), len(features), weight, score, None])
    pool = sorted((r for r in out if r[0] is not None and r[1] >= min_words), key=lambda r: (-r[4], r[0]))
    for rank, r in enumerate(pool[:len(pool) * percent // 100], 1):
        r[5] = rank
    return sorted((tuple(r) for r in out), key=repr)


VOCABULARY = ["alpha", "Beta", "GAMMA", "é", "ßtraße", "日本語", "x1", "9", "zz-top", "w" * 70]


@pytest.mark.parametrize("percent,min_words", [(25, 20), (100, 0), (60, 3)])
def test_resample(spark, percent, min_words):
    rng = random.Random(percent)
    rows = [(i, " ".join(rng.choice(VOCABULARY) for _ in range(rng.randrange(60)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \n.,"), (203, "word " * 40_000), (None, "some text without an id"), (-5, "É" * 500)] + [rows[3]] * 4
    target = [" ".join(rng.choice(VOCABULARY[:4]) for _ in range(30)) for _ in range(20)] + [None, ""]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, score string, rank int").repartition(4)
    aim = spark.createDataFrame([(t, "y") for t in target], "text string, doc_id string")
    got = resample.resample(docs, aim, percent, min_words, buckets=500, seed=3)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_resample(rows, target, percent, min_words, 500, 3)


def test_resample_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c " * 10), (2, "d e f " * 10)], "doc_id long, text string")
    assert resample.resample(none, none).count() == 0 and resample.resample(none, some).count() == 0
    assert [r["rank"] for r in resample.resample(some, none, percent=100).orderBy("doc_id").collect()] in ([1, 2], [2, 1])


def test_rows_that_tie_are_taken_by_id(spark):
    """One text in many documents: what decides is the noise, and ids where that is equal too."""
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.lit(7).alias("score"))
    for count in (1, 150, 400):
        assert resample._least(rows, -F.col("score"), count) == -7
        assert resample._least(rows, F.col("doc_id"), count) == count - 1
    far = spark.createDataFrame([(-2**62,), (0,), (2**62,)], "v long")
    assert [resample._least(far, F.col("v"), n) for n in (1, 2, 3)] == [-2**62, 0, 2**62]


# Secrets

SECRET = "password=hunter2hunter"
KEY = "AKIA" + "QWERTYUIOP234567"


def b64(data):
    return base64.b64encode(data if isinstance(data, bytes) else data.encode()).decode()


def plain(text):
    """The kinds as they are described, with no short cuts."""
    out = []
    for kind, pattern, fits in (
            ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
            ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24)):
        out += [(kind, *m.span()) for m in re.finditer(pattern, text) if fits(m)]
    return sorted(out, key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))


def random_text(rng):
    parts = ["token", "SECRET", "Api_Key", "apikey", "passwd", "=", ":", " ", "'", '"', "AKIA", "AKIAAKIA" + "B" * 11, "A" * 17, "abc", "0f" * 11, "0f" * 12, "ſecret", "toKen", "é", "\n", "-", "x.y/z", "zzzzzz"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(40)))


def test_plain_secrets(spark):
    rng = random.Random(5)
    texts = [random_text(rng) for _ in range(400)] + ["secret=token:abcdefgh", "token=abc", "", None, "token = abcdef " * 5000, "🙂" * 30 + SECRET]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, SECRET), (3, texts[3])]
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, secrets string, n_hex int").repartition(3)
    got = secret_scan.secrets(docs).select("doc_id", secret_scan.spans(plain=True).alias("s"), *[secret_scan.count_of(k).alias(k) for k in secret_scan.KINDS]).collect()
    want = [(i, ",".join(f"{k}:{a}:{b}" for k, a, b in plain(t or "")), *(sum(s[0] == k for s in plain(t or "")) for k in secret_scan.KINDS)) for i, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert secret_scan.secrets(docs.limit(0)).count() == 0


WRAPS = {
    "base64": b64(SECRET), "base64>base64": b64(b64(SECRET)), "url": "".join(f"%{ord(c):02x}" for c in SECRET),
    "url>url": quote(quote("password: 'abc/def'", safe=""), safe=""), "unicode": "".join(f"\\u{ord(c):04x}" for c in SECRET),
    "base64>gzip": b64(gzip.compress(SECRET.encode())), "base64>gzip>gzip": b64(gzip.compress(gzip.compress(SECRET.encode()))),
    "base64>base64>bzip2>base64": b64(b64(bz2.compress(b64(SECRET).encode()))), "url>gzip": quote(gzip.compress(SECRET.encode()), safe=""),
    "base64>url": b64("".join(f"%{ord(c):02x}" for c in SECRET)), "unicode>base64": "".join(f"&#{ord(c)};" for c in b64(SECRET)),
    "base64>unicode": b64("".join(chr(ord(c) + 0xFEE0) for c in SECRET)),
    "url>unicode>base64>zlib": quote("".join(f"\\u{ord(c):04x}" for c in b64(zlib.compress(SECRET.encode()))), safe=""),
}


@pytest.mark.parametrize("layers", sorted(WRAPS))
def test_wrapped_secrets(layers):
    text = "Ünï before " + WRAPS[layers] + " and after"
    found, closed = secret_scan.find(text)
    wrapped = [s for s in found if s[3] == layers]
    assert wrapped and closed == 0
    kind, start, end, _, value = wrapped[0]
    assert kind == "assign" and value.startswith("password")
    # The span lies in the wrapped stretch, and most of it unless the value has unwrapped neighbours.
    assert 11 <= start < end <= 11 + len(WRAPS[layers])
    assert [s[:3] for s in found if not s[3]] == plain(text)


def test_spans_follow_the_characters_inside():
    hidden = "first words, " + SECRET + ", last words"
    text = "x " + b64(hidden)
    (_, start, end, _, _), = [s for s in secret_scan.find(text)[0] if s[3]]
    assert SECRET in base64.b64decode(text[2:][(start - 2) // 4 * 4:-(-(end - 2) // 4) * 4] + "==").decode()
    assert end - start < len(text) - 20
    escaped = "a%20b%20" + quote(SECRET, safe="") + "%20c"
    (_, start, end, _, _), = [s for s in secret_scan.find(escaped)[0] if s[3]]
    assert escaped[start:end] == quote(SECRET, safe="")
    wide = "\\ud83d\\ude42 token=%61bcdef and \\ud83d alone"
    assert [wide[s[1]:s[2]] for s in secret_scan.find(wide)[0]] == ["token=%61bcdef"]


def test_wrapped_lines_and_url_alphabet():
    long_ = b64("x" * 70 + " " + SECRET + " " + "y" * 60)
    text = "\n".join(long_[k:k + 76] for k in range(0, len(long_), 76))
    assert [s[4] for s in secret_scan.find(text)[0]] == [SECRET]
    assert [s[4] for s in secret_scan.find(b64(SECRET) + "\n" + b64(KEY + " " * 5))[0]] == [SECRET, KEY]
    other = base64.urlsafe_b64encode(("??>>~~" + SECRET).encode()).decode()
    assert "-" in other or "_" in other
    assert [s[4] for s in secret_scan.find(other)[0]] == [SECRET]


def test_unwrapping_ends():
    bomb = b64(zlib.compress(b"token=abcdefgh " * 2_000_000))
    assert secret_scan.find(bomb) == ([], 1)
    deep = secret_scan.find("%" + "25" * 20_000 + "41KIA" + KEY[4:])[0]
    assert [s[4] for s in deep if s[0] == "access"] == [KEY]
    damaged = b64(gzip.compress(SECRET.encode() * 50)[:-9])
    assert secret_scan.find(damaged) == ([], 0)
    nested = SECRET
    for _ in range(12):
        nested = b64(nested)
    assert [s[4] for s in secret_scan.find(nested)[0] if s[0] == "assign"] == [SECRET]


def test_data_that_unpack_to_themselves(monkeypatch):
    """A layer that comes up again at its place is not opened again."""
    data = gzip.compress(b"anything")
    monkeypatch.setattr(secret_scan._Room, "unpack", lambda self, d, kind: data)
    assert secret_scan.find("see " + b64(data)) == ([], 0)


def test_prose_has_no_wrapped_secrets():
    rng = random.Random(2)
    words = ["internationalisation", "characteristically", "path/to/some/file_name", "Zusammenhangserklärung", "100%", "5%25", "&#x;", "\\u12", "a" * 40]
    text = " ".join(rng.choice(words) for _ in range(3000))
    assert [s for s in secret_scan.find(text)[0] if s[3]] == []


def test_masked(spark):
    docs = spark.createDataFrame([(1, f"a {SECRET} b {b64(SECRET)} c"), (2, None), (3, "nothing")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in secret_scan.masked(docs).collect()} == {1: "a [secret] b [secret]== c", 2: None, 3: "nothing"}


# Trie

def brute_trie(convs):
    """``convs``: number to list of (role, text)."""
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    leaves, saved, children = collections.Counter(), collections.Counter(), collections.Counter(p[:-1] for p in members if p)
    for path, held in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(held) - 1) * words
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + turns[h:]
    return out


def conversations(rng, convs):
    rows = []
    for c, turns in convs.items():
        places = [None, *range(1, len(turns))] if rng.random() < 0.2 else range(len(turns))
        rows += [(c, k, role or None, text or None, "x", 1) for k, (role, text) in zip(places, turns)]
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, depth string, n_convs int"


@pytest.fixture(params=[1, 2])
def talk(request):
    rng = random.Random(request.param)
    texts = ["", "hello", "tell me a story", "a  b\tc\n", "word " * 3000, "É ü", "once upon a time"]
    convs = {}
    for c in [*range(0, 70), *range(100, 125), 985, 1_000_000]:
        convs[c] = [(rng.choice(["user", "assistant", ""]), rng.choice(texts)) for _ in range(rng.choice([1, 1, 2, 3, 5, 9]))]
    for c in range(101, 119):
        convs[c] = convs[100]
    convs[7] = [("user", f"turn {k % 3}") for k in range(300)]
    convs[8] = convs[7][:200] + [("user", "other end")]
    return rng, convs


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(turn_trie, "RUN", 16)
    rank = turn_trie.list_rank
    monkeypatch.setattr(turn_trie, "list_rank", lambda arcs, sums: rank(arcs, sums, block=8))


def test_trie(spark, talk, small_blocks):
    rng, convs = talk
    rows = conversations(rng, convs) + [(None, 1, "user", "no conversation", "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted(map(tuple, turn_trie.prefix_trie(df).collect()))
    assert got == brute_trie(convs)


def test_trie_with_shared_openings(spark, talk):
    rng, convs = talk
    df = spark.createDataFrame(conversations(rng, convs), SCHEMA).repartition(5)
    got = turn_trie.trie(*turn_trie.with_shared_openings(turn_trie.numbered(df)))
    want = rebuilt(convs)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute_trie(want), key=repr)


def test_conversations_that_lose_all_turns(spark):
    """No template to borrow from, and no turn beyond those that go."""
    convs = {c: [("user", "hi")] for c in range(21, 40)}
    want = rebuilt(convs)
    assert any(not t for t in want.values())
    df = spark.createDataFrame([(c, 0, *t[0], "", 0) for c, t in convs.items()], SCHEMA)
    got = turn_trie.trie(*turn_trie.with_shared_openings(turn_trie.numbered(df)))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute_trie(want), key=repr)


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert turn_trie.prefix_trie(none).count() == 0
    assert turn_trie.trie(*turn_trie.with_shared_openings(turn_trie.numbered(none))).count() == 0


def test_list_rank_of_a_shuffled_list(spark):
    """No two neighbours in one block: every link is doubled."""
    rng = random.Random(9)
    order = list(range(500))
    rng.shuffle(order)
    after = dict(zip(order, order[1:] + [-1]))
    arcs = spark.createDataFrame([(a, after[a], 1, a) for a in range(500)], "arc long, after long, n long, v long")
    got = {r.arc: (r.n, r.v) for r in turn_trie.list_rank(arcs, ["n", "v"], block=4).collect()}
    assert got == {a: (500 - k, sum(order[k:])) for k, a in enumerate(order)}
