"""Operators on small tables, the split of hot groups, and payload mappers."""

import json
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from letterloom import schema, session
from letterloom.operators import agenda, components, feed, filters, identity, lookups, mailbox, ordering, store, threads, usage
from letterloom.operators import render
from letterloom.plans import corpora as C
from letterloom.sources import calendars, cards, chat, gmail, landing, notices, tracker

NOW = datetime(2026, 1, 10, tzinfo=timezone.utc)
MESSAGE = "id string, source string, thread_id string, chat_jid string, sender string, subject string, date string, snippet string, body string, unread boolean, seq long"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def hot(spark):
    """One group holds two thirds of the rows; some dates are equal."""
    rng = random.Random(7)
    data = [(("hot" if i % 3 else f"k{i % 5}"), f"2026-01-{rng.randint(1, 28):02d}", i, f"s{rng.randint(1, 9)}") for i in range(3000)]
    return spark.createDataFrame(data, "g string, date string, seq long, sender string").repartition(4).cache()


def test_split_groups_number_like_whole_groups(hot):
    whole = hot.withColumn("position", F.row_number().over(Window.partitionBy("g").orderBy("date", "seq")))
    split = ordering.number_in_groups(hot, ["g"], ["date", "seq"])
    assert rows(whole.select("seq", "position"), "seq") == rows(split.select("seq", "position"), "seq")


def test_split_groups_see_their_neighbours(hot):
    def compute(df, window):
        return df.withColumn("near", F.collect_list("seq").over(window.rowsBetween(-3, 3))).withColumn("prev", F.lag("seq").over(window))

    whole = compute(hot, Window.partitionBy("g").orderBy("date", "seq"))
    split = ordering.with_neighbours(hot, ["g"], ["date", "seq"], 3, compute, block_rows=7)
    pick = ("seq", "near", "prev")
    assert rows(whole.select(*pick), "seq") == rows(split.select(*pick), "seq")


def test_all_rows_are_numbered_once(hot):
    got = rows(ordering.number_rows(hot, ["date", "seq"], "n").select("n", "date", "seq"), "n")
    assert [r[0] for r in got] == list(range(1, 3001)) and got == sorted(got, key=lambda r: r[1:])


def test_top_of_a_hot_group_is_cut_before_the_shuffle(hot):
    plan = ordering.top_in_groups(hot, ["g"], [F.desc("date"), "seq"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan
    assert ordering.top_in_groups(hot, ["g"], [F.desc("date"), "seq"], 3).where("g = 'hot'").count() == 3


def test_collapse(spark):
    data = [("g:5", "g", "t1", None, "ann", "Re: Plan", "2026-01-05", "new", None, False, 1),
            ("g:4", "g", "t2", None, "bob", "Lunch", "2026-01-04", "", "body", True, 2),
            ("g:3", "g", "t1", None, "bob", "", "2026-01-03", "mid", None, True, 3),
            ("g:2", "g", "t1", None, "ann", "Plan", "2026-01-02", "old", None, False, 4),
            ("w:1", "w", None, "7@g.us", "cat", "Chat", "2026-01-01", None, "hey", False, 5),
            ("g:0", "g", "", None, "", "Solo", "", "s", None, None, 6)]
    got = {r.id: r for r in threads.collapse_threads(spark.createDataFrame(data, MESSAGE)).collect()}
    t1 = got["t1"]
    assert (t1.subject, t1.snippet, t1.participants, t1.message_count, t1.first_date, t1.date, t1.unread) == (
        "Plan", "new", "ann,bob", 3, "2026-01-02", "2026-01-05", True)
    assert got["t2"].snippet == "body" and got["w:7@g.us"].snippet == "hey" and got["g:0"].subject == "Solo"
    assert [r.id for r in sorted(got.values(), key=lambda r: r.first_seq)] == ["t1", "t2", "w:7@g.us", "g:0"]
    assert sum(r.message_count for r in got.values()) == len(data)


def test_participants_are_counted_past_three(spark):
    data = [(f"g:{i}", "g", "t", None, f"p{i % 5}", "S", f"2026-01-0{9 - i}", "x", None, False, i) for i in range(9)]
    row = threads.collapse_threads(spark.createDataFrame(data, MESSAGE)).first()
    assert (row.participants, row.participant_count) == ("p0,p1,p2+2", 5)


def tokens(spark, *senders):
    df = spark.createDataFrame([("t", s, i) for i, s in enumerate(senders)], "thread_id string, sender string, seq long")
    return {r.sender: r.token for r in threads.sender_tokens(df).collect()}


def test_sender_tokens(spark):
    assert tokens(spark, "ann@x.org", "bob lee") == {"ann@x.org": "A", "bob lee": "B"}
    assert tokens(spark, "ann@x.org", "amy@x.org") == {"ann@x.org": "Ann", "amy@x.org": "Amy"}
    assert tokens(spark, "al@a.org", "al@b.org", "al1@c.org") == {"al@a.org": "Al2", "al@b.org": "Al3", "al1@c.org": "Al1"}
    assert tokens(spark, "", "x") == {"": "?", "x": "X"}


def test_feed_offsets_after_a_cut(spark):
    data = [(f"{s}:{i}", s, f"2026-01-{d:02d}", i) for i, (s, d) in enumerate([("g", 9), ("g", 8), ("o", 7), ("g", 6), ("g", 5)])]
    messages = spark.createDataFrame(data, "id string, source string, date string, seq long")
    offsets = spark.createDataFrame([("k", "g", "2026-01-05"), ("other", "g", "2026-01-01")], "key string, source string, ts string")
    sources = C.constant(spark, [("g", 1), ("o", 2)], "prefix string, ord int")
    follows = feed.followed(spark.createDataFrame([("k",)], "key string"), offsets, sources, "2026-01-03")
    pages = feed.feed_pages(messages, follows, 3)
    report = feed.truncation(messages, follows, pages)
    assert rows(feed.advanced(report), "source") == [("k", "g", "2026-01-08"), ("k", "o", "2026-01-07")]
    assert rows(feed.advanced(report, "lossless"), "source") == [("k", "o", "2026-01-07")]
    page = feed.page_report(report).first()
    assert (page.remaining, page.has_more, page.truncated_sources, page.continue_since) == (2, True, "g", "2026-01-07")
    assert rows(feed.merge_offsets(offsets, feed.advanced(report)), "key", "source") == [
        ("k", "g", "2026-01-08"), ("k", "o", "2026-01-07"), ("other", "g", "2026-01-01")]


def test_refs_are_kept_and_extended(spark):
    known = spark.createDataFrame([("a", 1), ("b", 2)], "id string, ref bigint")
    listing = spark.createDataFrame([("c", "2"), ("a", "3"), ("d", "1"), ("", "9")], "id string, date string")
    new = feed.assign_refs(listing, known, ["date"], newest_first=True)
    assert rows(new, "ref") == [("c", 3), ("d", 4)]
    asked = spark.createDataFrame([("#3",), ("1",), ("9",), ("g:x",)], "asked string")
    got = dict(rows(lookups.resolve_refs(asked, known.union(new)).select("asked", "id"), "asked"))
    assert got == {"#3": "c", "1": "a", "9": "9", "g:x": "g:x"}


def test_filters(spark):
    data = [("1", "Ann <ann@Sub.Acme.org>", "Hi", "x", "g"), ("2", "bob@acme.org", "Lunch", "acme", "g"), ("3", "alerts.acme.org", "Hi", "y", "h"),
            ("4", "eve@notacme.org", "Hi", "z", "g")]
    df = spark.createDataFrame(data, "id string, sender string, subject string, snippet string, provider string").withColumn("date", F.lit("2026-01-09"))

    def ids(**given):
        return [r.id for r in filters.listing(df, now=NOW, **given).orderBy("id").collect()]

    assert ids(domain="@acme.org") == ["1", "2"] and ids(domain="sub.acme.org") == ["1"]
    assert ids(sender="ACME") == ["1", "2", "3", "4"] and ids(query="acme") == ["1", "2", "3", "4"] and ids(query="lunch") == ["2"]
    assert ids(domain="acme.org", query="hi") == ["1"] and ids(since="2d") == ["1", "2", "3", "4"] and ids(since="2026-01-10") == []


def test_skip_rules(spark):
    data = [("1", "ann@acme.org", "a", "x", None, None, False), ("2", "bob@sub.acme.org", "b", "x", None, None, False), ("3", "cat@x.org", "Sale now", "x", None, None, False),
            ("4", "dan@x.org", "d", "x", "CI", None, False), ("5", "eve", "e", "x", None, "9@g.us", False), ("6", " Fay@y.org ", "f", "x", None, None, False), ("7", None, None, None, None, None, None)]
    df = spark.createDataFrame(data, "id string, sender string, subject string, body string, category string, chat_jid string, is_group boolean")
    rules = spark.createDataFrame([("domain", "ACME.org"), ("sender", "fay@y.org")], "rule_type string, value string")
    kept = filters.skip(df, rules, groups=True, patterns=["sale"], categories=["ci"])
    assert [r.id for r in kept.orderBy("id").collect()] == ["2", "7"]
    assert filters.usable_patterns(spark, ["a+", "(", "[x"]) == ["a+"]


def test_contains_join_matches_pairwise(spark):
    left = [(f"user{i}@dom{i % 7}.org",) for i in range(60)]
    right = [("dom3",), ("user1",), ("r5@d",), ("absent",), ("",)]
    got = rows(lookups.containing(spark.createDataFrame(left, "t string"), "t", spark.createDataFrame(right, "n string"), "n").select("t", "n"), "t", "n")
    assert got == sorted((t, n) for (t,) in left for (n,) in right if n and n in t)


def test_substrings_are_looked_up_by_their_rarest_piece(spark):
    """A sender meets the needles it may contain, not all that share a common piece with it."""
    senders = [(f"user{i}@mail.example.com",) for i in range(200)] + [("é", ), ("ab",), ("日本語メール",)]
    needles = [(f"user{i}@mail",) for i in range(0, 200, 2)] + [("é",), ("b",), ("本語メ",), ("example.com",), ("example.org",)]
    left, right = spark.createDataFrame(senders, "t string"), spark.createDataFrame(needles, "n string")
    got = rows(lookups.containing(left, "t", right, "n"), "t", "n")
    assert got == sorted((t, n) for (t,) in senders for (n,) in needles if n in t)
    met = rows(lookups.candidates(left, "t", right, "n"), "t", "n")
    assert set(got) <= set(met) and not any(n == "example.org" for _, n in met)
    assert sum(t == "user7@mail.example.com" for t, _ in met) <= 12


def test_groups_that_hang_together(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(80), f"k{rng.randrange(90)}") for _ in range(120)]
    root = {r: r for r, _ in edges}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, k in edges:
        for b, q in edges:
            if k == q:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = components.components(spark.createDataFrame(edges, "r long, k string"), "r", "k")
    assert {r.r: r.component for r in got.collect()} == {r: find(r) for r in root}
    assert components.components(spark.createDataFrame([], "r long, k string"), "r", "k").count() == 0


def first_come(claims):
    by, taken, out = {}, set(), set()
    for seq, claim in claims:
        by.setdefault(seq, set()).add(claim)
    for seq in sorted(by):
        if taken.isdisjoint(by[seq]):
            out |= {(seq, c) for c in by[seq]}
            taken |= by[seq]
    return out


def test_first_come_first_served(spark):
    rng = random.Random(8)
    hot = [(seq, "hot") for seq in range(0, 400, 3)]
    claims = hot + [(rng.randrange(400), f"c{rng.randrange(300)}") for _ in range(900)]
    got = {tuple(r) for r in identity.first_come(spark.createDataFrame(claims, "seq long, claim string")).collect()}
    assert got == first_come(claims)


def test_a_chain_is_settled_in_few_rounds(spark, monkeypatch):
    """Each of 10,000 cards shares a claim with the next: every second one is accepted."""
    rounds = []
    write = components.materialise
    monkeypatch.setattr(components, "materialise", lambda df: rounds.append(1) or write(df))
    claims = spark.range(10_000).selectExpr("id AS seq", "explode(array(concat('c', id), concat('c', id + 1))) AS claim")
    got = identity.first_come(claims).select("seq").distinct()
    assert got.where("seq % 2 = 0").count() == got.count() == 5000
    assert len(rounds) <= 20


def test_runs_over_many_pieces(spark):
    rng = random.Random(6)
    labels = [rng.choice("aab") for _ in range(400)] + ["c"] * 300 + ["a"]
    df = spark.createDataFrame(list(enumerate(labels)), "n long, label string").repartition(7)
    want, run = [], 0
    for n, label in enumerate(labels):
        run += not n or labels[n - 1] != label
        want.append((n, run))
    got = ordering.number_runs(df, ["n"], "label")
    assert rows(got.select("n", "run"), "n") == want
    assert "SinglePartition" not in got._jdf.queryExecution().toString()
    down = ordering.number_runs(df, [F.desc("n")], "label")
    assert rows(down.agg(F.max("run").alias("m")), "m") == [(run,)]
    assert ordering.number_runs(df.limit(0), ["n"], "label").count() == 0


def test_cache_table(spark, tmp_path):
    """Merges replace versions also where they move to another month; scans choose folders and row groups."""
    schema = "id string, source string, date string, mailbox string, _schema_version int, _cached_at string"
    name, path = "cache_test", str(tmp_path / "cache")
    old = [(f"g:{k}", "g", f"2026-0{1 + k % 3}-05", "m", 3, "1") for k in range(30)] + [("o:1", "o", None, "m", 3, "1")]
    store.create(spark.createDataFrame(old, schema), name, path, buckets=4)
    new = [("g:0", "g", "2026-01-09", "m", 3, "2"), ("g:1", "g", "2026-09-01", "m", 3, "2"), ("g:99", "g", "2026-02-01", "m", 3, "2"), ("o:1", "o", "2026-05-05", "m", 3, "2")]
    store.merge(name, spark.createDataFrame(new, schema))
    want = {r[0]: (r[2], r[5]) for r in old} | {r[0]: (r[2], r[5]) for r in new}
    table = spark.table(name)
    assert {r.id: (r.date, r["_cached_at"]) for r in table.collect()} == want and table.count() == len(want)
    assert "month=none" not in " ".join(r.partition for r in spark.sql(f"SHOW PARTITIONS {name}").collect())
    plan = store.scan(table, source="g", since="2026-02-03")
    assert plan.count() == sum(i.startswith("g") and d >= "2026-02-03" for i, (d, _) in want.items())
    text = plan._jdf.queryExecution().executedPlan().toString()
    pushed = text.split("PushedFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(date,2026-02-03)" in pushed and "GreaterThanOrEqual(_schema_version,3)" in pushed
    chosen = text.split("PartitionFilters: [")[1].split("]")[0]
    assert "source" in chosen and "month" in chosen
    # A join by id moves the other side to the buckets and leaves the table where it is.
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        joined = table.join(spark.createDataFrame([("g:4",)], "id string"), "id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 1 and plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    spark.sql(f"DROP TABLE {name}")


def test_stamped_headers(spark):
    sources = spark.createDataFrame([("g", "gmail", "Me@X.org", None, None, None, None, None, 1)], schema.SOURCES)
    df = spark.createDataFrame([("g:1", "g", "gmail", "text", "old"), ("w:1", "w", "whatsapp", "text", ""), ("z:1", "z", "gmail", "text", "old")],
                               "id string, source string, provider string, body string, mailbox string")
    got = {r.id: (r.mailbox, r["_schema_version"], r["_cached_at"]) for r in store.stamped(df, sources, F.lit("now")).collect()}
    assert got == {"g:1": ("gmail:Me@X.org", 3, "now"), "z:1": (None, 3, "now")}
    assert "body" not in store.stamped(df, sources, F.lit("now")).columns


def test_rows_are_spread_only_where_files_are_few(spark, tmp_path):
    path, cores = str(tmp_path / "one"), spark.sparkContext.defaultParallelism
    spark.range(100).coalesce(1).write.parquet(path)
    one = spark.read.parquet(path)
    assert session.spread(one).rdd.getNumPartitions() == cores and session.spread(one).count() == 100
    many = spark.range(0, 100, 1, cores)
    assert session.spread(many) is many
    counted = one.groupBy("id").count()
    assert session.spread(counted) is counted
    stream = spark.readStream.schema("id long").parquet(path)
    assert session.spread(stream) is stream


def test_cleared_offsets(spark):
    offsets = spark.createDataFrame([("a", "g", "1"), ("b", "g", "2")], schema.OFFSETS)
    assert rows(feed.clear_offsets(offsets, "a"), "key") == [("b", "g", "2")]


def test_landing_reads_raw_once(spark, tmp_path):
    chat = '{"id":"1","timestamp":"2026-01-01 10:00:00","sender_jid":"5@s.whatsapp.net","content":"hi","chat_jid":"5@s.whatsapp.net"}\n[{"id":"2","sender_name":"Ann"}]\n5\nbroken'
    raw = [("w", "whatsapp", 1, chat), ("gh", "github", 2, '{"id":"7","updated_at":"2026-01-02T00:00:00Z","subject":{"title":"t","type":"Issue"}}'),
           ("g", "gmail", 3, "{broken"), ("h", "http", 4, '{"notifications":[{"id":"a","subject":"s"},{"id":"b"}]}'), ("h", "http", 5, "{}"),
           ("o", "o365", 6, '{"id":"z","subject":"x"}'), ("o", "o365", 7, '{"subject":"no id"}'), (None, None, 8, "{}")]
    spark.createDataFrame(raw, "source string, provider string, seq long, payload string").write.json(str(tmp_path / "raw"))
    landed = landing.land(landing.read_raw(spark, str(tmp_path / "raw")))
    assert sorted(r.id for r in landed.collect()) == ["gh:7", "h:a", "h:b", "o:z", "w:1", "w:2"]
    assert {r.id: r.sender for r in landed.where("source = 'w'").collect()} == {"w:1": "5@s.whatsapp.net", "w:2": "Ann"}
    assert landed._jdf.queryExecution().executedPlan().toString().count("FileScan json") == 1
    wrong = landing.rejects(landing.read_raw(spark, str(tmp_path / "raw")))
    assert sorted(r.seq for r in wrong.collect()) == [3, 8]


def test_sender_names(spark):
    contacts = spark.createDataFrame([("ann", "gw:ann@x.org", 1), ("bob", "o:bob@x.org", 1), ("zed", "bob2", 1), ("aaa", "g:dup", 1), ("bbb", "g:dup", 1)], "alias string, identifier string, ord int")
    pairs = spark.createDataFrame([("g", "ann@x.org"), ("g", "bob@x.org"), ("w", "k:bob2"), ("w", "k:none"), ("g", "dup"), ("g", "nobody")], "source string, sender string")
    got = {r.sender: r.name for r in lookups.named(pairs, contacts, C.sources(spark)).collect()}
    assert got == {"ann@x.org": "ann", "bob@x.org": "bob", "k:bob2": "zed", "k:none": "k:none", "dup": "aaa", "nobody": "nobody"}


def test_names_under_a_provider(spark):
    """Sources with colons, several sources of a provider, and the order of keys."""
    sources = spark.createDataFrame([("g", "Gmail", None, None, None, None, None, None, 3), ("g:x", "gmail", None, None, None, None, None, None, 1), ("o", "o365", None, None, None, None, None, None, 2)], schema.SOURCES)
    contacts = spark.createDataFrame([("first", "g:x:a@b", 1), ("second", "g:a@b", 1), ("other", "o:a@b", 1), ("colon", "g:x:y", 1), ("own", "g:x:c@d", 1), ("sib", "g:c@d", 1), ("fixed", "w:e@f", 1)], "alias string, identifier string, ord int")
    pairs = spark.createDataFrame([("g", "a@b"), ("g:x", "a@b"), ("o", "a@b"), ("o", "c@d"), ("zz", "a@b"), ("", "c@d"), ("g", "e@f"), ("g", "x:y"), ("g", "y")], "source string, sender string")
    got = {(r.source, r.sender): r.name for r in lookups.named(pairs, contacts, sources).collect()}
    assert got == {("g", "a@b"): "second", ("g:x", "a@b"): "first", ("o", "a@b"): "other", ("o", "c@d"): "sib", ("zz", "a@b"): "second",
                   ("", "c@d"): "sib", ("g", "e@f"): "fixed", ("g", "x:y"): "x:y", ("g", "y"): "colon"}


def plan_by_hand(cards_, existing):
    owner = {i: a for a, ids in existing.items() for i in ids}
    taken, out = set(), {}
    for seq, alias, ids in cards_:
        if alias in existing:
            out[seq] = "already up to date" if set(ids) <= set(existing[alias]) else "alias already exists"
        elif alias in taken:
            out[seq] = "duplicate in import"
        elif any(i in owner for i in ids):
            first = next(i for i in ids if i in owner)
            out[seq] = f"{first} already linked to '{owner[first]}'"
        else:
            out[seq] = None
            taken.add(alias)
            owner.update({i: alias for i in ids})
    return out


def test_import_plan_is_first_come_first_served(spark):
    rng = random.Random(3)
    people = [(i, f"p{rng.randint(0, 40)}", [f"m{rng.randint(0, 60)}@x.org" for _ in range(rng.randint(1, 3))]) for i in range(120)]
    people += [(200 + i, f"q{i}", ["shared@x.org"]) for i in range(30)]
    existing = {"p1": ["g:m1@x.org"], "p2": ["g:m2@x.org", "g:m3@x.org"]}
    df = spark.createDataFrame([(s, a, [], list(dict.fromkeys(m))) for s, a, m in people], "seq long, display_name string, phones array<string>, emails array<string>")
    known = spark.createDataFrame([(a, i, 1) for a, ids in existing.items() for i in ids], "alias string, identifier string, ord int")
    got = {r.seq: r.reason for r in identity.import_plan(df, known, ["g"], ["w"]).collect()}
    want = plan_by_hand([(s, a, [f"g:{x}" for x in dict.fromkeys(m)]) for s, a, m in people], existing)
    assert got == want


def test_link_and_unlink(spark):
    start = spark.createDataFrame([("ann", "g:a", 1)], "alias string, identifier string, ord int")
    more = spark.createDataFrame([(" Ann ", "o:a", 1), ("ann", "g:a", 2), ("bob", "g:b", 1)], "alias string, identifier string, ord int")
    linked = identity.link(start, more)
    assert rows(linked, "alias", "ord") == [("ann", "g:a", 1), ("ann", "o:a", 2), ("bob", "g:b", 1)]
    gone = spark.createDataFrame([("bob", None), ("ann", "g:a")], "alias string, identifier string")
    assert rows(identity.unlink(linked, gone).select("alias", "identifier"), "alias") == [("ann", "o:a")]


def test_actions(spark):
    messages = spark.createDataFrame([("g:1", "g:t", ["INBOX", "UNREAD"]), ("g:2", "g:t", ["INBOX"]), ("g:3", None, None)], "id string, thread_id string, labels array<string>")
    log = spark.createDataFrame([(1, "archive", None, "thread", "g:t"), (2, "unarchive", None, "message", "g:2"), (3, "label", "x", "message", "g:1"), (4, "unlabel", "x", "thread", "g:t"),
                                 (5, "trash", None, "message", "g:3"), (6, "read", None, "message", "g:1")], "seq long, action string, label string, scope string, target string")
    got = {r.id: sorted(r.labels) for r in mailbox.apply_actions(messages, log).collect()}
    assert got == {"g:1": [], "g:2": ["INBOX"], "g:3": ["TRASH"]}
    asked = log.withColumn("source", F.when(F.col("seq") == 1, F.lit("o")).when(F.col("seq") == 2, F.lit("zz")).otherwise("g"))
    reasons = {r.seq: r.reason for r in mailbox.gate(asked, C.sources(spark)).collect()}
    assert reasons[1] == "needs level modify, source has readonly" and reasons[2] == "unknown source" and reasons[3] is None
    assert "sending is closed" in mailbox.gate(asked, C.sources(spark), "send").where("seq = 3").first().reason


def test_cache_clear_counts_what_goes(spark):
    df = spark.createDataFrame([("a", "g", 3), ("b", "g", 2), ("c", "o", 2)], "id string, source string, _schema_version int")
    kept, counted = store.clear(df, source="g", stale_only=True)
    assert sorted(r.id for r in kept.collect()) == ["a", "c"] and counted.get["removed"] == 1


def test_partitioned_cache(spark, tmp_path):
    df = spark.createDataFrame([("a", "g", "2026", 3, "m"), ("b", "o", "2025", 3, "m")], "id string, source string, date string, _schema_version int, mailbox string")
    store.write(df, str(tmp_path / "c"))
    store.write(df.where("source = 'g'").withColumn("date", F.lit("2027")), str(tmp_path / "c"))
    back = spark.read.parquet(str(tmp_path / "c"))
    assert rows(back.select("id", "date"), "id") == [("a", "2027"), ("b", "2025")]
    plan = store.scan(back, source="g", since="2026")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source" in plan and "GreaterThanOrEqual(date" in plan


def test_savings(spark):
    df = spark.createDataFrame([(0, 0), (1000, 250), (3, 1)], "i long, o long")
    assert [r[0] for r in df.select(usage.savings(F.col("i"), F.col("o"))).collect()] == [0.0, 75.0, 66.7]


# Calendar

EVENT = "id string, source string, title string, start string, end string, all_day boolean, duration_minutes long, recurring_event_id string"


def test_agenda_windows():
    low, high = agenda.window_bounds("week", datetime(2026, 3, 11, 3, tzinfo=timezone.utc), "America/New_York")
    assert (low.isoformat(), high.isoformat()) == ("2026-03-09T04:00:00+00:00", "2026-03-16T04:00:00+00:00")
    low, high = agenda.window_bounds("range", NOW, "Europe/Amsterdam", "2026-03-28", "2026-03-29")
    assert (low.isoformat(), high.isoformat()) == ("2026-03-27T23:00:00+00:00", "2026-03-29T21:59:59+00:00")


def test_all_day_events_keep_to_their_dates(spark):
    data = [("in", "c", "x", "2026-03-10", "2026-03-11", True, None, None), ("next", "c", "x", "2026-03-11", "2026-03-12", True, None, None),
            ("same", "c", "x", "2026-03-10", "2026-03-10", True, None, None), ("odd", "c", "x", "soon", "", True, None, None),
            ("late", "c", "x", "2026-03-11T03:30:00+00:00", "2026-03-11T04:30:00+00:00", False, 60, None)]
    low, high = agenda.window_bounds("today", datetime(2026, 3, 10, 15, tzinfo=timezone.utc), "America/New_York")
    got = agenda.agenda(spark.createDataFrame(data, EVENT), low, high, "America/New_York")
    assert {r.id for r in got.collect()} == {"in", "same", "odd", "late"}


def test_series_fold(spark):
    data = [(f"e{i}", "c", "x", f"2026-03-1{i}T09:00:00+00:00", f"2026-03-1{i}T10:00:00+00:00", False, 60, "s" if i < 3 else None) for i in range(5)]
    got = rows(agenda.collapse_recurring(spark.createDataFrame(data, EVENT), "UTC").select("id", "instances", "collapsed"), "id")
    assert got == [("e0", 3, True), ("e3", 1, False), ("e4", 1, False)]


# Payloads

def raw(spark, *payloads, **more):
    df = spark.createDataFrame([("s", i, p) for i, p in enumerate(payloads)], "source string, seq long, payload string")
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def test_mime_tree_prefers_this_level(spark):
    def leaf(kind, text, **more):
        import base64
        return {"mimeType": kind, "body": {"data": base64.urlsafe_b64encode(text.encode()).decode()}, **more}

    inner = {"mimeType": "multipart/alternative", "parts": [leaf("text/plain", "inner")]}
    tree = {"mimeType": "multipart/mixed", "parts": [inner, leaf("text/plain", "outer"), leaf("text/html", "<b>h</b>"), {"mimeType": "text/plain", "filename": "n.txt", "body": {"size": 3}}]}
    attached = {"mimeType": "multipart/mixed", "parts": [{"mimeType": "multipart/related", "filename": "f.eml", "parts": [leaf("text/plain", "hidden")]}, leaf("text/html", "shown")]}
    outside = {"mimeType": "multipart/mixed", "parts": [{"mimeType": "text/plain", "body": {"attachmentId": "ref9"}}]}
    deep = {"mimeType": "multipart/mixed", "parts": [leaf("text/plain", "deep"), {"mimeType": "image/png", "filename": "far.png", "body": {"size": 5}}]}
    for _ in range(60):
        deep = {"mimeType": "multipart/mixed", "parts": [{"mimeType": "text/x"}, deep]}
    got = gmail.messages(raw(spark, *[json.dumps({"id": str(i), "payload": t}) for i, t in enumerate((tree, attached, outside, deep))])).orderBy("seq").collect()
    assert [r.body for r in got] == ["outer", "shown", "", "deep"] and [r.size for r in got] == [None] * 4
    assert got[0].attachments[0].asDict() == {"filename": "n.txt", "mime_type": "text/plain", "size": 3}
    ref = raw(spark, json.dumps({"id": "1", "payload": outside})).withColumn("m", F.from_json("payload", gmail.message_type())).select(gmail.external_body("m.payload", "text/plain"))
    assert ref.first()[0] == "ref9"
    assert [a.filename for a in got[3].attachments] == ["far.png"]


def test_broken_payloads_are_set_aside(spark):
    df = raw(spark, '{"a":1}', "{broken", "[1]")
    good, bad = landing.split_malformed(df)
    assert good.count() == 2 and bad.first().error == "payload is not JSON"


def test_chat_lines(spark):
    text = '{"id":"1","timestamp":"2026-01-01 10:00:00","sender_jid":"5@s.whatsapp.net","chat_name":"Ann","content":"hi"}\n\nnope{\n[{"id":"2","sender_name":"Bob"}]'
    got = chat.messages(raw(spark, text)).orderBy("id").collect()
    assert [(r.id, r.sender, r.date, r.body) for r in got] == [("s:1", "Ann", "2026-01-01T10:00:00", "hi"), ("s:2", "Bob", "", "")]


def test_tracker_ids_and_categories(spark):
    ids = spark.createDataFrame([("12",), ("o/r#4",), ("o/r/pull-comments/5",), ("o/r/pulls/4/reviews/6",), ("o/r/comments/7",), ("o/r",)], "id string")
    assert [r.kind for r in tracker.classify_ids(ids).collect()] == ["notification", "issue", "review_comment", "review", "comment", None]
    one = {"id": "9", "unread": True, "reason": "mention", "subject": {"title": "Bump a from 1 to 2", "type": "PullRequest", "url": "https://h/repos/o/r/pulls/3"}, "repository": {"full_name": "o/r"}}
    row = tracker.notifications(raw(spark, json.dumps(one))).first()
    assert (row.subject, row.thread_id, row.sender) == ("[dependabot] Bump a from 1 to 2", "s:o/r#3", "o/r")


def test_notice_ids_are_stable(spark):
    import hashlib
    one = {"notifications": [{"date": "2026-01-01T00:00:00-04:00", "source": "ci", "subject": "x", "link": "http://l"}], "meters": {"bad": 1}}
    row = notices.notifications(raw(spark, json.dumps(one))).first()
    assert row.id == "s:" + hashlib.sha256(b"ci|2026-01-01T00:00:00-04:00|x|http://l").hexdigest()[:12]
    assert (row.subject, row.date, row.body) == ("ci: x", "2026-01-01T04:00:00Z", "ci: x\n\nhttp://l")
    polled = notices.meters(raw(spark, json.dumps(one)).withColumn("polled_at", F.current_timestamp()))
    assert polled.first().meters == []


def test_ical_all_day_and_missing_end(spark):
    text = "BEGIN:VEVENT\nUID:a\nDTSTART;VALUE=DATE:20260310\nDURATION:P2D\nEND:VEVENT\nBEGIN:VEVENT\nUID:b\nDTSTART:20260310T090000\nSTATUS:CANCELLED\nEND:VEVENT"
    got = calendars.ical_events(raw(spark, text, timezone="America/New_York", owner="x")).orderBy("id").collect()
    assert [(r.id, r.title, r.start, r.end, r.all_day, r.duration_minutes, r.status) for r in got] == [
        ("s:a", "(No title)", "2026-03-10", "2026-03-12", True, None, "confirmed"),
        ("s:b", "(No title)", "2026-03-10T13:00:00+00:00", "2026-03-10T13:00:00+00:00", False, 0, "cancelled")]


def test_cards(spark):
    text = "BEGIN:VCARD\nN:Doe\\;S;Ann;;;\nTEL:1\nEND:VCARD\nBEGIN:VCARD\nFN:Cut\nBEGIN:VCARD\nitem1.EMAIL;TYPE=x:A@B.Org\nFN:Bo\n b\\, Jr\nEND:VCARD\nTEL:9"
    got = cards.parse_cards(raw(spark, text)).orderBy("pos").collect()
    assert [(r.display_name, r.phones, r.emails) for r in got] == [("Ann Doe;S", ["1"], []), ("Bob, Jr", [], ["A@b.org"])]


# Renderings

def test_listing_keeps_its_columns(spark):
    data = [("g:1", "g", "t", None, "ann", "A", "2026-01-05T10:00:00Z", "s|x\ny", None, True, 1), ("g:2", "g", "t", None, None, None, "2026-01-04T10:00:00Z", None, "b", None, 2)]
    df = spark.createDataFrame(data, MESSAGE).withColumn("place", F.col("seq"))
    lines = [r.line for r in render.listing(df).orderBy("place", "part").collect()]
    assert lines[1] == "*|g|ann|A|2026-01-05T10:00:00Z|g:1|5b|s/x y" and {x.count("|") for x in lines} == {7}
    refs = [r.line for r in render.listing(df.withColumn("ref", F.col("seq"))).orderBy("place", "part").collect()]
    assert refs[1:] == ["--- 5Jan ---", "*|1|g|ann|A|10:00|5b|s/x y", "--- 4Jan ---", " |2|g|||10:00|1b|"]
    with pytest.raises(ValueError):
        render.format_name("yaml")


def test_transcript(spark):
    data = [("1", "w", "t", None, "ann lee", "Talk", "2025-12-31T23:50:00Z", None, "hi\nthere", False, 1), ("2", "w", "t", None, "bob", "Talk", "2026-01-01T00:10:00Z", None, "a|b", False, 2),
            ("3", "w", "t", None, "ann lee", "Talk", "2026-01-01T00:20:00Z", None, "", False, 3)]
    lines = [r.line for r in render.transcripts(spark.createDataFrame(data, MESSAGE)).orderBy("idx").collect()]
    assert lines == ["THREAD|t|Talk|3 msgs", "|31 Dec 25 23:50|A|hi there|", "|1 Jan 26 00:10|B|a/b|", "|00:20|A||"]
    full = [r.line for r in render.full_threads(spark.createDataFrame(data, MESSAGE)).orderBy("idx").collect()]
    assert sum(map(len, lines)) < sum(map(len, full)) + 40


def test_compact_forms_are_smaller(spark):
    text = "word " * 60
    data = [(f"g:{i}", "g", "t", None, f"p{i % 3}@x.org", "Subject", f"2026-01-05T10:{i:02d}:00Z", text, text, False, i) for i in range(10)]
    df = spark.createDataFrame(data, MESSAGE)
    listed = sum(len(r.line) for r in render.listing(df.withColumn("place", F.col("seq"))).collect())
    folded = sum(len(r.line) for r in render.thread_listing(threads.collapse_threads(df)).collect())
    raw_bytes = df.agg(F.sum(usage.json_bytes(df))).first()[0]
    assert folded < 0.25 * listed and listed < 0.3 * raw_bytes


def test_lines_go_to_text_files_in_order(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("place"), F.col("id").cast("string").alias("line")).repartition(5)
    render.write_lines(df, str(tmp_path / "out"), "place")
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert [x for p in parts for x in p.read_text().split()] == [str(i) for i in range(100)]


def test_tokens_of_names_that_end_in_digits(spark):
    """Long runs of digits are no numbers to avoid; short ones are."""
    names = ["Ann A", "Ann B", "Ann C", "Ann2 X", "Ann007 X", "Ann123456789012 X", "Ann1234567890123456789012345 X", "Ann" + "9" * 60 + " X"]
    df = spark.createDataFrame([("t", n, i) for i, n in enumerate(names)], "thread_id string, sender string, seq long")
    got = {r.sender: r.token for r in threads.sender_tokens(df).collect()}
    assert [got[n] for n in names[:3]] == ["Ann1", "Ann3", "Ann4"]
    assert len(set(got.values())) == len(names) and got["Ann2 X"] == "Ann2"


def test_landing_leaves_nothing_out_in_silence(spark):
    rows = [("s", "gmail", 1, "{broken"), ("s", "pigeon", 2, "{}"), ("s", None, 3, "{}"), ("s", "o365", 4, '{"id":"a","subject":"x"}'), ("s", "gmail", 5, None), ("c", "caldav", 6, "no json")]
    df = spark.createDataFrame(rows, "source string, provider string, seq long, payload string")
    assert rows_of(landing.rejects(df)) == [(1, "payload is not JSON"), (2, "unknown provider"), (3, "unknown provider"), (5, "payload is not JSON")]
    assert [r.id for r in landing.land(df).collect()] == ["s:a"]
    assert landing.land_events(df).count() == 0


def rows_of(df):
    return sorted((r.seq, r.error) for r in df.collect())


def test_many_consumers_of_one_source(spark):
    """Ten thousand consumers with offsets of their own: counts come from one sort, not from pairs."""
    messages = spark.range(2000).selectExpr("concat('g:', id) AS id", "'g' AS source", "concat('2026-01-01T', lpad(id, 6, '0')) AS date", "id AS seq")
    keys = spark.range(10_000).selectExpr("concat('k', id) AS key")
    offsets = spark.range(10_000).selectExpr("concat('k', id) AS key", "'g' AS source", "concat('2026-01-01T', lpad(id % 2500, 6, '0')) AS ts")
    sources = spark.createDataFrame([("g", 1)], "prefix string, ord int")
    follows = feed.followed(keys, offsets, sources, "2026")
    pages = feed.feed_pages(messages, follows, 5)
    assert pages.count() == 4 * sum(min(5, 2000 - k) for k in range(2000))
    report = {r.key: (r.available, r.returned) for r in feed.truncation(messages, follows, pages).collect()}
    assert report == {f"k{i}": (2000 - i % 2500, min(5, 2000 - i % 2500)) for i in range(10_000) if i % 2500 < 2000}
