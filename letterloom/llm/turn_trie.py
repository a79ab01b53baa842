"""The trie of conversations by their turns, with subtree sums from an Euler tour.

A node is a sequence of turns with which some conversation begins. Its key is the exclusive
or of the hashes of (position, turn) of its turns, 128 bits: such keys are running sums, so
a conversation of any length is cut into blocks and no task holds it whole.

The tour enters and leaves every node once: two arcs a node, each with a link to the arc
after it. To rank the list, arcs are cut into blocks by the number of their node, stretches
of links inside a block become one link each, and the links that are left are doubled
until they reach the end. Nodes are numbered by their smallest conversation and depth, so
the path of a conversation lies side by side and few links leave a block; where many do,
the doubling still takes rounds by the logarithm only. A subtree is what the tour passes
between entering and leaving its top: sums over it are differences of two sums along the tour.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from letterloom.llm.tables import pick, stored
from letterloom.operators.ordering import number_in_groups, number_rows, with_neighbours

#: Turns of a conversation whose keys one group of a window adds up.
RUN = 10_000
#: Arcs of a block; an even number, so that both arcs of a node are in one.
BLOCK = 1 << 13
#: Children of one node whose neighbours one group of a window finds.
SIBLINGS = 1 << 8
#: Hashes of a text and of its place; the seed sets the second 64 bits apart from the first.
SEED = 7


def _pair(*columns, names: tuple[str, str]) -> list[Column]:
    return [F.xxhash64(*columns).alias(names[0]), F.xxhash64(F.lit(SEED), *columns).alias(names[1])]


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, t1, t2, n_words) of each turn: place, hash of role and text, words.

    Turns go by ``turn``, null first; turns of one number by the hash of role and text.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = pick(conversations, "conv_id", "turn", "role", "text").where("conv_id IS NOT NULL").select(
        "conv_id", "turn", *_pair(role, text, names=("t1", "t2")),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words"))
    return number_in_groups(turns, ["conv_id"], [F.asc_nulls_first("turn"), "t1", "t2"], "pos").select(
        "conv_id", F.col("pos").cast("long").alias("pos"), "t1", "t2", "n_words")


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns marked ``last`` where a conversation ends, and the conversations without turns: none."""
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("pos"), F.lit(True).alias("last"))
    return turns.join(sizes, ["conv_id", "pos"], "left").withColumn("last", F.coalesce("last", F.lit(False))), sizes.select("conv_id").limit(0)


def with_shared_openings(turns: DataFrame, group: int = 20, choices: int = 4) -> tuple[DataFrame, DataFrame]:
    """The same for conversations that take their opening from the first of their group.

    Conversation c begins with the first h turns of c - c % group, as far as there are any, and
    goes on with its own after its first h; h is the CRC-32 of its number modulo ``choices``.
    """
    def skipped(conv_id):
        return F.crc32(F.col(conv_id).cast("string").cast("binary")) % choices

    heads = turns.where((F.col("conv_id") % group == 0) & (F.col("pos") < choices)).select(
        F.col("conv_id").alias("template"), "pos", "t1", "t2", "n_words")
    lent = heads.groupBy("template").agg(F.count("*").alias("lent"))
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("size")).select(
        "conv_id", "size", skipped("conv_id").alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("template"))
    convs = stored(convs.join(lent, "template", "left").withColumn("taken", F.least("h", F.coalesce("lent", F.lit(0)))).select(
        "conv_id", "template", "h", "taken", (F.col("taken") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("total")), "trie-convs")
    opening = convs.where("taken > 0").join(heads, "template").where("pos <= taken")
    own = turns.where(F.col("pos") > skipped("conv_id")).join(convs, "conv_id").withColumn("pos", F.col("pos") - F.col("h") + F.col("taken"))
    columns = ["conv_id", "pos", "t1", "t2", "n_words", (F.col("pos") == F.col("total")).alias("last")]
    return opening.select(*columns).unionAll(own.select(*columns)), convs.where("total = 0").select("conv_id")


def _keyed(turns: DataFrame) -> DataFrame:
    """Turns with the key (k1, k2) of the node that they complete, and (p1, p2) of the one before."""
    rows = stored(turns.select(
        "conv_id", "pos", "n_words", "last", *_pair("pos", "t1", "t2", names=("s1", "s2")),
        F.expr(f"(pos - 1) div {RUN}").alias("run")), "trie-turns")
    along = Window.partitionBy("conv_id", "run").orderBy("pos")
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy("conv_id", "run").agg(F.bit_xor("s1").alias("r1"), F.bit_xor("s2").alias("r2"))
    # Conversations of one run have nothing before it.
    long_ = runs.where("run > 0").select("conv_id").distinct()
    earlier = runs.join(long_, "conv_id", "left_semi").select(
        "conv_id", "run", F.bit_xor("r1").over(before).alias("b1"), F.bit_xor("r2").over(before).alias("b2")).where("run > 0")
    keyed = rows.withColumns({f"k{i}": F.bit_xor(f"s{i}").over(along) for i in (1, 2)}).join(earlier, ["conv_id", "run"], "left")
    keyed = keyed.withColumns({f"k{i}": F.col(f"k{i}").bitwiseXOR(F.coalesce(f"b{i}", F.lit(0))) for i in (1, 2)})
    return keyed.select("conv_id", F.col("pos").alias("depth"), "n_words", "last", "k1", "k2",
                        *[F.col(f"k{i}").bitwiseXOR(F.col(f"s{i}")).alias(f"p{i}") for i in (1, 2)])


def _nodes(keyed: DataFrame, empty: DataFrame) -> DataFrame:
    """One row a node, numbered from 0 by smallest conversation and depth; the root is 0."""
    inner = keyed.groupBy("k1", "k2", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_words").alias("n_words"),
        F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    nil = F.lit(0).cast("long")
    root = keyed.where("last").select("conv_id").unionAll(empty).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        nil.alias("k1"), nil.alias("k2"), nil.alias("depth"), "conv_id", "n_convs", nil.alias("n_words"),
        F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"))
    nodes = number_rows(inner.unionAll(root), ["conv_id", "depth"], "id")
    return stored(nodes.withColumn("id", (F.col("id") - 1).cast("long")), "trie-nodes")


def _parents(nodes: DataFrame) -> DataFrame:
    """(id, parent_id, parent_conv_id) of all nodes but the root."""
    root = nodes.where("depth = 0").first()
    if root is None:
        return nodes.select("id", F.col("id").alias("parent_id"), F.col("conv_id").alias("parent_conv_id"))
    above = nodes.where("depth > 0").select(
        F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("id").alias("parent_id"), F.col("conv_id").alias("parent_conv_id"))
    deep = nodes.where("depth > 1").select("id", "p1", "p2").join(above, ["p1", "p2"]).select("id", "parent_id", "parent_conv_id")
    return stored(deep.unionAll(nodes.where("depth = 1").select(
        "id", F.lit(root["id"]).alias("parent_id"), F.lit(root["conv_id"]).alias("parent_conv_id"))), "trie-parents")


def contracted(arcs: pd.DataFrame, sums: list[str]) -> pd.DataFrame:
    """For each arc of a block: where its stretch of links leaves the block, the sums from the
    arc to there, and whether the stretch begins with it."""
    arcs = arcs.sort_values("arc")
    arc, after = arcs["arc"].to_numpy(), arcs["after"].to_numpy()
    n = len(arc)
    at = np.minimum(np.searchsorted(arc, after), n - 1)
    step = np.append(np.where((after >= 0) & (arc[at] == after), at, n), n)
    head = np.ones(n + 1, bool)
    head[step] = False
    last = np.arange(n + 1)
    totals = np.vstack([np.append(arcs[c].to_numpy(), 0) for c in sums])
    while (step < n).any():
        last = np.where(step < n, last[step], last)
        totals = totals + totals[:, step]
        step = step[step]
    out = {"arc": arc, "out": after[last[:n]], "head": head[:n]} | {c: t[:n] for c, t in zip(sums, totals)}
    return pd.DataFrame(out)


def list_rank(arcs: DataFrame, sums: list[str], block: int = BLOCK) -> DataFrame:
    """Sums of the columns ``sums`` from each arc to the end of the list, the arc itself included.

    ``arcs`` has ``arc``, numbered from 0, and ``after``, the next one, -1 at the end.
    """
    types = ", ".join(f"{c} long" for c in sums)
    local = stored(arcs.groupBy(F.expr(f"arc div {block}")).applyInPandas(
        lambda pdf: contracted(pdf, sums), f"arc long, out long, head boolean, {types}"), "tour-stretches")
    heads = stored(local.where("head").select("arc", "out", *sums), "tour-heads")
    # Each round doubles how far a link reaches, so the length of the list bounds the rounds.
    for _ in range(max(heads.count() - 1, 0).bit_length()):
        reached = heads.select(F.col("arc").alias("out"), F.col("out").alias("_out"), *[F.col(c).alias(f"_{c}") for c in sums])
        moved = heads.where("out >= 0").join(reached, "out").select(
            "arc", F.col("_out").alias("out"), *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in sums])
        heads = stored(moved.unionAll(heads.where("out < 0")), "tour-heads")
    rest = heads.select(F.col("arc").alias("out"), *[F.col(c).alias(f"_{c}") for c in sums])
    return local.where("out >= 0").join(rest, "out").select("arc", *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in sums]).unionAll(
        local.where("out < 0").select("arc", *sums))


def _subtrees(nodes: DataFrame, parents: DataFrame, children: DataFrame) -> DataFrame:
    """(id, n_leaves, saved_tokens) from the tour; the arcs of node n are 2n, in, and 2n + 1, out."""
    siblings = with_neighbours(parents.select("id", "parent_id"), ["parent_id"], ["id"], 1,
                               lambda df, w: df.withColumn("sibling", F.lead("id").over(w)), block_rows=SIBLINGS)
    tree = nodes.select("id", ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved")).join(
        children.withColumnRenamed("parent_id", "id"), "id", "left").join(siblings, "id", "left")
    into = F.struct((2 * F.col("id")).alias("arc"), F.coalesce(2 * F.col("first_child"), 2 * F.col("id") + 1).alias("after"),
                    F.col("first_child").isNull().cast("long").alias("leaves"), F.col("saved").alias("saved"))
    out_of = F.struct((2 * F.col("id") + 1).alias("arc"), F.coalesce(2 * F.col("sibling"), 2 * F.col("parent_id") + 1, F.lit(-1).cast("long")).alias("after"),
                      F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
    ranked = list_rank(tree.select(F.inline(F.array(into, out_of))), ["leaves", "saved"])
    sign = 1 - 2 * (F.col("arc") % 2)
    return ranked.groupBy(F.expr("arc div 2").alias("id")).agg(
        F.sum(sign * F.col("leaves")).alias("n_leaves"), F.sum(sign * F.col("saved")).alias("saved_tokens"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (k1, k2, conv_id) as one row for each key of a batch, its numbers comma-joined."""
    for batch in batches:
        if not len(batch):
            continue
        k1, k2, conv = (batch.column(c).to_numpy() for c in ("k1", "k2", "conv_id"))
        starts = np.flatnonzero(np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
        texts = [",".join(map(str, part.tolist())) for part in np.split(conv, starts[1:])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(k1[starts]), pa.array(k2[starts]), pa.array(conv[starts]), pa.array(texts)], names=["k1", "k2", "first", "text"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces as one SHA-256 a key; only the hash of the key at hand is kept."""
    def row(key, state):
        return pa.RecordBatch.from_pylist([{"k1": key[0], "k2": key[1], "ends_sha256": state.hexdigest()}])

    key, state = None, None
    for batch in batches:
        done = []
        for k1, k2, text in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text"))):
            if (k1, k2) == key:
                state.update(b"," + text.encode())
                continue
            if key is not None:
                done.append(row(key, state))
            key, state = (k1, k2), hashlib.sha256(text.encode())
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if key is not None:
        yield row(key, state)


def _ends(keyed: DataFrame, empty: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of the nodes at which conversations end.

    A node at which a third of them ends has its numbers joined where they are sorted, over
    many partitions; what meets in one task, in order and one at a time, are the pieces.
    """
    nil = F.lit(0).cast("long")
    ends = keyed.where("last").select("k1", "k2", "conv_id").unionAll(empty.select(nil, nil, "conv_id"))
    order = ["k1", "k2", "conv_id"]
    pieces = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, "k1 long, k2 long, first long, text string")
    return pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(_hashed, "k1 long, k2 long, ends_sha256 string")


def trie(turns: DataFrame, empty: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has conv_id, pos (1, 2, 3 ...), t1, t2, n_words and ``last``; ``empty`` the
    conv_id of conversations without turns. Both come from one of the functions above.
    """
    keyed = stored(_keyed(turns), "trie-keys")
    nodes = _nodes(keyed, empty)
    parents = _parents(nodes)
    children = parents.groupBy("parent_id").agg(F.min("id").alias("first_child"), F.count("*").alias("n_children"))
    return nodes.join(parents, "id", "left").join(children.select(F.col("parent_id").alias("id"), "n_children"), "id", "left").join(
        _subtrees(nodes, parents, children), "id").join(_ends(keyed, empty), ["k1", "k2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of ``conversations`` (conv_id, turn, role, text) as they are.

    Null roles and texts count as empty; null turns come first, and turns of one number are
    ordered by a hash of role and text. Repeated rows are turns of their own. Rows without
    conv_id are left out. Other columns are ignored. An empty table has no node, not even a root.
    """
    return trie(*as_they_are(numbered(conversations)))


#: The same for conversations with shared openings, by DuckDB: nodes are joined with all their ancestors.
TRIE_SQL = r"""
WITH RECURSIVE bits(i, k, v) AS (SELECT i, 0, i::BIGINT FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
steps AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS template, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], [ord(x)::BIGINT for x in string_split(conv_id::VARCHAR, '')]),
   lambda a, v: xor(a >> 8, t[xor(a & 255, v) + 1]))) % 4 AS h FROM (SELECT DISTINCT conv_id FROM o), steps),
l AS (SELECT c.*, (SELECT count(*) FROM o WHERE o.conv_id = c.template AND pos <= h) AS taken FROM c),
r AS (SELECT l.conv_id, pos, role, text FROM l JOIN o ON o.conv_id = l.template AND pos <= h UNION ALL SELECT conv_id, pos - h + taken, role, text FROM l JOIN o USING (conv_id) WHERE pos > h),
k AS (SELECT conv_id, pos AS depth, text, list(sha256(role || chr(1) || text)) OVER (PARTITION BY conv_id ORDER BY pos) AS path FROM r UNION ALL SELECT conv_id, 0, '', [] FROM l),
e AS (SELECT conv_id, max(depth) AS depth FROM k GROUP BY conv_id),
n AS (SELECT path, any_value(k.depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) AS words,
   sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (k.depth = e.depth), '')) AS ends_sha256 FROM k JOIN e USING (conv_id) GROUP BY path),
p AS (SELECT n.*, q.conv_id AS parent_conv_id FROM n LEFT JOIN n q ON n.depth > 0 AND q.path = n.path[:n.depth - 1]),
f AS (SELECT parent_conv_id, depth - 1 AS depth, count(*) AS n_children FROM p WHERE depth > 0 GROUP BY ALL),
m AS (SELECT p.*, coalesce(n_children, 0) AS n_children FROM p LEFT JOIN f ON f.parent_conv_id = p.conv_id AND f.depth = p.depth),
s AS (SELECT a.path, count(*) FILTER (m.n_children = 0) AS n_leaves, CAST(sum((m.n_convs - 1) * m.words) AS BIGINT) AS saved_tokens
   FROM m JOIN k a ON a.conv_id = m.conv_id AND a.depth <= m.depth GROUP BY a.path)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM m JOIN s USING (path)
"""
