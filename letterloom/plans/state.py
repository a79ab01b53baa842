"""Queries over feeds, references, usage and mailbox state."""

from __future__ import annotations

from pyspark.sql import functions as F

from letterloom.functions import headers
from letterloom.operators import feed, lookups, mailbox, usage
from letterloom.plans import corpora as C
from letterloom.plans.messages import M
from letterloom.plans.registry import query
from letterloom.plans.sql_views import MSG, SOURCES, with_views

ORDER = "date DESC, source_ord, seq"


@query("feed_newest_n", M + f"""
SELECT id, row_number() OVER (ORDER BY {ORDER}) AS place FROM msg WHERE unread QUALIFY place <= 100""")
def feed_newest_n(spark, folder):
    """The newest hundred of the unread messages: the limit comes after the filter."""
    page = feed.listed(C.messages(spark, folder).where("unread"), 100)
    return page.select("id", F.col("place").cast("bigint").alias("place"))


@query("continuation", M + f"SELECT min(date)[1:10] AS since FROM (SELECT date FROM msg ORDER BY {ORDER} LIMIT 100)")
def continuation(spark, folder):
    return feed.continuation(C.messages(spark, folder), 100)


# Consumers: one per region. Each follows all sources; some offsets are missing.
OFFSETS = """
, keys AS (SELECT r_name AS key, r_regionkey AS k FROM region),
offsets AS (SELECT r_name AS key, s.prefix AS source, strftime(TIMESTAMP '2001-05-01' + to_days(CAST(r_regionkey * 15 AS INT)), '%Y-%m-%dT%H:%M:%SZ') AS ts
  FROM region, sources s WHERE s.prefix IN ('g', 'o', 'gw') AND (r_regionkey + s.ord) % 3 <> 0),
due AS (SELECT keys.key, msg.* FROM keys, msg LEFT JOIN offsets o ON o.key = keys.key AND o.source = msg.source
  WHERE date >= coalesce(o.ts, '2001-07-26T00:00:00Z')),
placed AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY date DESC, source_ord, seq) AS place FROM due)
"""
FEED = with_views(MSG, SOURCES) + OFFSETS


def page_offsets(spark, folder):
    """The offsets that consumers have before they read."""
    region = C.table(spark, folder, "region")
    known = C.sources(spark).where("prefix IN ('g', 'o', 'gw')").select("prefix", "ord")
    pairs = region.select("r_name", "r_regionkey", F.explode(F.array(*[F.lit(p) for p in ("g", "o", "gw")])).alias("prefix"))
    return pairs.join(known, "prefix").where("(r_regionkey + ord) % 3 <> 0").selectExpr(
        "r_name AS key", "prefix AS source",
        "date_format(timestamp '2001-05-01 00:00:00' + make_dt_interval(r_regionkey * 15), \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS ts")


def _due(spark, folder):
    keys = C.table(spark, folder, "region").selectExpr("r_name AS key")
    messages = C.messages(spark, folder).drop("source_ord")
    follows = feed.followed(keys, page_offsets(spark, folder), C.sources(spark), "2001-07-26T00:00:00Z")
    return messages, follows, feed.feed_pages(messages, follows, 60)


@query("feed_pages", FEED + "SELECT key, id, place FROM placed WHERE place <= 60")
def feed_pages(spark, folder):
    """The page of every consumer: messages at or after its offsets, newest first."""
    return _due(spark, folder)[2].select("key", "id", F.col("place").cast("bigint").alias("place"))


@query("truncation_report", FEED + """
, per AS (SELECT key, source, count(*) FILTER (place <= 60) AS r, count(*) FILTER (place > 60) AS d, min(date) FILTER (place <= 60) AS lo FROM placed GROUP BY ALL)
SELECT key, CAST(sum(r) AS BIGINT) AS returned, CAST(sum(d) AS BIGINT) AS remaining, sum(d) > 0 AS has_more,
  coalesce(string_agg(source, ',' ORDER BY source) FILTER (WHERE d > 0), '') AS truncated_sources, CASE WHEN sum(d) > 0 THEN min(lo)[1:10] END AS continue_since
FROM per GROUP BY key""")
def truncation_report(spark, folder):
    return feed.page_report(feed.truncation(*_due(spark, folder)))


ADVANCED = """
, per AS (SELECT key, source, count(*) FILTER (place <= 60) AS r, count(*) FILTER (place > 60) AS d,
  min(date) FILTER (place <= 60) AS lo, max(date) FILTER (place <= 60) AS hi FROM placed GROUP BY ALL),
new AS (SELECT key, source, CASE WHEN d > 0 THEN lo ELSE hi END AS ts FROM per WHERE r > 0 {and_})
SELECT coalesce(n.key, o.key) AS key, coalesce(n.source, o.source) AS source, coalesce(n.ts, o.ts) AS ts
FROM offsets o FULL JOIN new n ON n.key = o.key AND n.source = o.source"""


@query("feed_offsets", FEED + ADVANCED.format(and_=""))
def feed_offsets(spark, folder):
    """Offsets after every consumer read its page."""
    return feed.merge_offsets(page_offsets(spark, folder), feed.advanced(feed.truncation(*_due(spark, folder))))


@query("feed_offsets_lossless", FEED + ADVANCED.format(and_="AND d = 0"))
def feed_offsets_lossless(spark, folder):
    """The same, but a source with dropped rows keeps its offset."""
    moved = feed.advanced(feed.truncation(*_due(spark, folder)), "lossless")
    return feed.merge_offsets(page_offsets(spark, folder), moved)


@query("offset_summary", with_views(MSG, SOURCES) + OFFSETS + "SELECT key, count(*) AS sources, max(ts) AS latest FROM offsets GROUP BY key")
def offset_summary(spark, folder):
    return usage.offset_summary(page_offsets(spark, folder))


REFS = "known AS (SELECT id, row_number() OVER (ORDER BY seq) AS ref FROM msg WHERE seq % 40 = 0)"


def _refs(spark, folder):
    first = C.messages(spark, folder).where("seq % 40 = 0")
    return feed.assign_refs(first, spark.createDataFrame([], "id string, ref bigint"), ["seq"])


@query("ref_assign", M + "," + REFS + f"""
SELECT id, ref FROM known UNION ALL
SELECT id, (SELECT max(ref) FROM known) + row_number() OVER (ORDER BY date DESC, id) FROM msg WHERE seq % 40 <> 0""")
def ref_assign(spark, folder):
    """Known messages keep their numbers, all others get the next ones, newest first."""
    known = _refs(spark, folder)
    return known.unionByName(feed.assign_refs(C.messages(spark, folder), known, ["date"], newest_first=True))


@query("ref_resolve", M + "," + REFS + """
, asked AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN '#' || (o_orderkey % 97) WHEN 1 THEN CAST(o_orderkey % 89 AS VARCHAR) ELSE 'g:m' || o_orderkey END AS asked FROM orders)
SELECT asked, coalesce(id, asked) AS id FROM asked LEFT JOIN known ON regexp_matches(asked, '^#?[0-9]+$') AND CAST(ltrim(asked, '#') AS VARCHAR) = CAST(ref AS VARCHAR)""")
def ref_resolve(spark, folder):
    asked = C.table(spark, folder, "orders").selectExpr(
        "CASE o_orderkey % 3 WHEN 0 THEN concat('#', o_orderkey % 97) WHEN 1 THEN CAST(o_orderkey % 89 AS STRING) ELSE concat('g:m', o_orderkey) END AS asked")
    return lookups.resolve_refs(asked, _refs(spark, folder)).select("asked", "id")


# Usage: every line item is a call.
LOG = """
WITH log AS (SELECT l_returnflag AS command, l_linestatus AS source, CAST(trunc(l_extendedprice) AS BIGINT) AS bytes_in,
  CAST(trunc(l_extendedprice * l_discount) AS BIGINT) AS bytes_out, CAST(l_quantity AS BIGINT) AS messages FROM lineitem)"""


def _log(spark, folder):
    return C.table(spark, folder, "lineitem").selectExpr(
        "l_returnflag AS command", "l_linestatus AS source", "CAST(l_extendedprice AS BIGINT) AS bytes_in",
        "CAST(l_extendedprice * l_discount AS BIGINT) AS bytes_out", "CAST(l_quantity AS BIGINT) AS messages")


@query("usage_rollup", LOG + """
SELECT CASE grouping(source, command) WHEN 1 THEN 'source' WHEN 2 THEN 'command' ELSE 'total' END AS level, coalesce(source, command, '') AS name,
  count(*) AS calls, CAST(sum(bytes_in) AS BIGINT) AS bytes_in, CAST(sum(bytes_out) AS BIGINT) AS bytes_out, CAST(sum(messages) AS BIGINT) AS messages
FROM log GROUP BY GROUPING SETS ((source), (command), ())""")
def usage_rollup(spark, folder):
    return usage.rollup(_log(spark, folder))


@query("savings_pct", LOG + """
SELECT level, name, CASE WHEN i = 0 THEN 0.0 ELSE round_even((1 - o / i) * 100, 1) END AS savings FROM (
  SELECT 'total' AS level, '' AS name, CAST(sum(bytes_in) AS DOUBLE) AS i, CAST(sum(bytes_out) AS DOUBLE) AS o FROM log
  UNION ALL SELECT 'source', source, CAST(sum(bytes_in) AS DOUBLE), CAST(sum(bytes_out) AS DOUBLE) FROM log GROUP BY source)""")
def savings_pct(spark, folder):
    rows = usage.rollup(_log(spark, folder)).where("level <> 'command'")
    return rows.select("level", "name", usage.savings(F.col("bytes_in"), F.col("bytes_out")).alias("savings"))


@query("usage_attribution", M + """
, per AS (SELECT source, CAST(sum(strlen('{"source":"' || source || '","id":"' || id || '","subject":"' || subject || '"}')) AS BIGINT) AS bytes_in,
  count(*) AS messages, sum(strlen(subject) + 1) AS o FROM msg GROUP BY source)
SELECT 'list' AS command, source, bytes_in, CAST(round_even((SELECT sum(o) FROM per) * (messages / (SELECT sum(messages) FROM per)), 0) AS BIGINT) AS bytes_out, messages FROM per""")
def usage_attribution(spark, folder):
    df = C.messages(spark, folder).select("source", "id", "subject")
    return usage.attribute(df, F.octet_length("subject") + 1, "list")


@query("status_report", with_views(MSG) + "," + LOG.strip().removeprefix("WITH ") + """
SELECT 'contacts' AS section, 'aliases' AS name, count(DISTINCT c_name) AS value FROM customer
UNION ALL SELECT 'contacts', 'identifiers', count(*) FROM customer
UNION ALL SELECT 'filters', 'rules', count(*) FROM nation
UNION ALL SELECT 'usage', CASE grouping(source, command) WHEN 1 THEN 'source:' || source WHEN 2 THEN 'command:' || command ELSE 'total:' END, CAST(sum(bytes_in) AS BIGINT)
  FROM log GROUP BY GROUPING SETS ((source), (command), ())
UNION ALL SELECT 'cache', source, count(*) FROM msg GROUP BY source""")
def status_report(spark, folder):
    contacts = C.table(spark, folder, "customer").selectExpr("c_name AS alias", "c_name AS identifier")
    rules = C.table(spark, folder, "nation").selectExpr("'sender' AS rule_type", "n_name AS value")
    return usage.status(contacts, rules, _log(spark, folder), C.messages(spark, folder))


@query("label_stats", M + """
, l AS (SELECT source, unread, unnest(labels) AS label FROM msg)
SELECT source, CASE label WHEN 'INBOX' THEN 'Inbox' WHEN 'CATEGORY_SOCIAL' THEN 'Social' WHEN 'CATEGORY_UPDATES' THEN 'Updates' ELSE 'Trash' END AS name,
  count(*) AS total, count(*) FILTER (unread) AS unread FROM l WHERE label <> 'UNREAD' GROUP BY source, label""")
def label_stats(spark, folder):
    return mailbox.label_stats(C.messages(spark, folder)).select("source", "name", "total", "unread")


# Actions: every line item asks for something on the message or thread of its order.
ACTIONS = """
, acts AS (SELECT l_orderkey * 10 + l_linenumber AS seq, CASE (l_orderkey + l_linenumber) % 9 WHEN 0 THEN 'archive' WHEN 1 THEN 'unarchive' WHEN 2 THEN 'read'
    WHEN 3 THEN 'unread' WHEN 4 THEN 'label' WHEN 5 THEN 'unlabel' WHEN 6 THEN 'trash' WHEN 7 THEN 'move' ELSE 'explode' END AS action,
  CASE WHEN l_partkey % 11 = 0 THEN '' ELSE l_returnflag END AS label, CASE WHEN l_suppkey % 6 = 0 AND thread_id IS NOT NULL THEN 'thread' ELSE 'message' END AS scope,
  CASE WHEN l_suppkey % 6 = 0 AND thread_id IS NOT NULL THEN thread_id ELSE id END AS target, source, thread_id, l_suppkey AS call
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate) AS rn FROM lineitem QUALIFY rn = 1) JOIN msg ON msg.seq = l_orderkey)"""


def _actions(spark, folder):
    items = C.table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min(F.struct("l_partkey", "l_suppkey", "l_shipdate", "l_returnflag")).alias("i")).select("l_orderkey", "l_linenumber", "i.*")
    return items.join(C.messages(spark, folder).select("id", "source", "thread_id", "seq"), F.col("l_orderkey") == F.col("seq")).selectExpr(
        "l_orderkey * 10 + l_linenumber AS seq",
        """CASE (l_orderkey + l_linenumber) % 9 WHEN 0 THEN 'archive' WHEN 1 THEN 'unarchive' WHEN 2 THEN 'read' WHEN 3 THEN 'unread'
           WHEN 4 THEN 'label' WHEN 5 THEN 'unlabel' WHEN 6 THEN 'trash' WHEN 7 THEN 'move' ELSE 'explode' END AS action""",
        "if(l_partkey % 11 = 0, '', l_returnflag) AS label",
        "if(l_suppkey % 6 = 0 AND thread_id IS NOT NULL, 'thread', 'message') AS scope",
        "if(l_suppkey % 6 = 0 AND thread_id IS NOT NULL, thread_id, id) AS target", "source", "thread_id", "l_suppkey AS call")


GATED = with_views(MSG, SOURCES) + ACTIONS + """
, gated AS (SELECT acts.*, CASE WHEN action = 'explode' THEN 'unknown action explode'
    WHEN action IN ('label', 'unlabel', 'move') AND label = '' THEN 'label required'
    WHEN source = 'o' THEN 'needs level modify, source has readonly' END AS reason FROM acts)"""


@query("action_gate", GATED + "SELECT seq, reason FROM gated")
def action_gate(spark, folder):
    return mailbox.gate(_actions(spark, folder), C.sources(spark)).select("seq", "reason")


@query("apply_actions", GATED + """
, reach AS (SELECT seq, action, label, target AS id FROM gated WHERE reason IS NULL AND scope = 'message'
  UNION ALL SELECT g.seq, action, label, msg.id FROM gated g JOIN msg ON msg.thread_id = g.target WHERE reason IS NULL AND scope = 'thread'),
eff AS (SELECT id, seq, 'INBOX' AS label, action = 'unarchive' AS a FROM reach WHERE action IN ('archive', 'unarchive', 'trash', 'move')
  UNION ALL SELECT id, seq, 'UNREAD', action = 'unread' FROM reach WHERE action IN ('read', 'unread')
  UNION ALL SELECT id, seq, label, action <> 'unlabel' FROM reach WHERE action IN ('label', 'unlabel', 'move')
  UNION ALL SELECT id, seq, 'TRASH', true FROM reach WHERE action = 'trash'),
fin AS (SELECT id, label, arg_max(a, seq) AS a FROM eff GROUP BY ALL),
ad AS (SELECT id, list(label) FILTER (WHERE a) AS ad, list(label) FILTER (WHERE NOT a) AS rm FROM fin GROUP BY id),
res AS (SELECT msg.id, list_sort(list_distinct(list_filter(list_concat(labels, coalesce(ad, [])), lambda x: NOT list_contains(coalesce(rm, []), x)))) AS l FROM msg LEFT JOIN ad USING (id))
SELECT id, array_to_string(l, ',') AS labels, list_contains(l, 'UNREAD') AS unread FROM res""")
def apply_actions(spark, folder):
    """Labels of every message after the allowed part of the log."""
    allowed = mailbox.gate(_actions(spark, folder), C.sources(spark)).where("reason IS NULL")
    after = mailbox.apply_actions(C.messages(spark, folder), allowed)
    return after.select("id", F.array_join(F.array_sort("labels"), ",").alias("labels"), "unread")


@query("action_preview", with_views(MSG) + ACTIONS + """
SELECT seq, target || ': would ' || action || CASE WHEN scope = 'thread' THEN ' (whole thread)' ELSE '' END || CASE WHEN label <> '' THEN ' label=' || label ELSE '' END AS line FROM acts""")
def action_preview(spark, folder):
    return mailbox.preview(_actions(spark, folder))


@query("thread_requests", with_views(MSG) + ACTIONS + """
SELECT seq, row_number() OVER w = 1 AS runs, CASE WHEN row_number() OVER w > 1 THEN first_value(target) OVER w END AS same_as
FROM acts WHERE scope = 'thread' WINDOW w AS (PARTITION BY call, source, thread_id ORDER BY seq)""")
def thread_requests(spark, folder):
    """Whole-thread requests: the first of a call runs, the others point to it."""
    return mailbox.first_requests(_actions(spark, folder).where("scope = 'thread'")).select("seq", "runs", "same_as")


@query("derived_columns", M + """
SELECT id, source, CASE WHEN seq % 2 = 0 THEN '7kb' WHEN seq % 11 = 0 AND seq % 7 <> 0 THEN '0b' ELSE strlen(snippet) || 'b' END AS size FROM msg""")
def derived_columns(spark, folder):
    """Source from the id, and size from what is stored or from the text."""
    df = C.messages(spark, folder)
    return df.select(
        "id", headers.source_of(F.lit(None).cast("string"), F.col("id")).alias("source"),
        headers.message_size(F.when(F.expr("seq % 2 = 0"), F.lit("7kb")), F.lit(""), F.col("snippet")).alias("size"))
