"""Queries over message headers: clean-up, filters, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from letterloom.functions import dates, headers
from letterloom.operators import filters, lookups, ordering, store
from letterloom.plans import corpora as C
from letterloom.plans.registry import query
from letterloom.plans.sql_views import CONTACTS, CUST, EVENTS, MSG, SOURCES, with_views
from letterloom.session import fresh_path

M = with_views(MSG)
MC = with_views(MSG, CUST, CONTACTS)
MCS = with_views(MSG, CUST, CONTACTS, SOURCES)


@query("normalize_subject", M + "SELECT id, subject FROM msg")
def normalize_subject(spark, folder):
    raw = C.raw_messages(spark, folder)
    return raw.select("id", headers.header("subject", F.col("subject")).alias("subject"))


@query("normalize_address", M + """
SELECT id, sender, 'team' || (custkey % 20) || '@example.org' AS recipient FROM msg""")
def normalize_address(spark, folder):
    raw = C.raw_messages(spark, folder)
    return raw.select("id", headers.header("sender", F.col("sender")).alias("sender"),
                      headers.header("to", F.col("to")).alias("recipient"))


@query("normalize_date", """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN 'soon'
    WHEN 1 THEN strftime(t - INTERVAL '5 hours 30 minutes', '%Y-%m-%dT%H:%M:%SZ')
    ELSE strftime(t, '%Y-%m-%dT%H:%M:%SZ') END AS date
FROM (SELECT o_orderkey, o_orderdate + to_seconds(o_orderkey % 86400) AS t FROM orders)""")
def normalize_date(spark, folder):
    """Mail dates, with and without zone and weekday, ISO dates with an offset, and junk."""
    t = F.expr("CAST(o_orderdate AS TIMESTAMP) + make_dt_interval(0, 0, 0, o_orderkey % 86400)")
    raw = F.expr("o_orderkey % 5")
    written = (
        F.when(raw == 0, F.date_format(t, "EEE, d MMM yyyy HH:mm:ss '+0000'"))
        .when(raw == 1, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'+05:30'"))
        .when(raw == 2, F.date_format(t, "d MMM yyyy HH:mm:ss 'GMT'"))
        .when(raw == 3, F.date_format(t, "yyyy-MM-dd HH:mm:ss"))
        .otherwise("soon"))
    return C.table(spark, folder, "orders").select("o_orderkey", dates.to_iso(written).alias("date"))


@query("phone_to_chat", """
SELECT c_custkey, CASE c_custkey % 8
    WHEN 0 THEN '31' || n || '@s.whatsapp.net' WHEN 1 THEN '31' || n || '@s.whatsapp.net'
    WHEN 5 THEN '31' || n || '@s.whatsapp.net' WHEN 7 THEN '31' || n || '@s.whatsapp.net' END AS chat
FROM (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 9, '5') AS n FROM customer)""")
def phone_to_chat(spark, folder):
    number = F.lpad(F.col("c_custkey").cast("string"), 9, "5")
    form = F.expr("c_custkey % 8")
    phone = (
        F.when(form == 0, F.concat(F.lit("+31 "), number))
        .when(form == 1, F.concat(F.lit(" 0031-"), number))
        .when(form == 2, F.concat(F.lit("06"), number))
        .when(form == 3, F.concat(F.lit("tel:+31"), number, F.lit(";ext=12")))
        .when(form == 4, F.concat(F.lit("+31"), number, F.lit(" ext. 5")))
        .when(form == 5, F.concat(F.lit("TEL:+31-"), number))
        .when(form == 6, F.concat(F.lit("+31"), number, number))
        .otherwise(F.concat(F.lit("+31("), number, F.lit(");type=cell"))))
    return C.table(spark, folder, "customer").select("c_custkey", headers.phone_to_chat(phone).alias("chat"))


@query("human_size", """
SELECT doc_id, CASE WHEN n = 0 THEN '0b' WHEN n < 1000 THEN n || 'b'
    WHEN n < 1000000 THEN greatest(CAST(round_even(n / 1024.0, 0) AS BIGINT), 1) || 'kb'
    ELSE greatest(CAST(round_even(n / 1048576.0, 0) AS BIGINT), 1) || 'mb' END AS size
FROM (SELECT doc_id, strlen(text) * CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 64 WHEN 2 THEN 0 ELSE 1024 END AS n FROM documents)""")
def human_size(spark, folder):
    n = F.octet_length("text") * F.expr("CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 64 WHEN 2 THEN 0 ELSE 1024 END")
    return C.table(spark, folder, "documents").select("doc_id", headers.human_size(n.cast("bigint")).alias("size"))


@query("snippet_field", M + r"""
SELECT id, CASE WHEN length(s) > 80 THEN rtrim(substr(s, 1, 77)) || '...' ELSE s END AS snippet,
  CASE WHEN length(f) > 77 THEN rtrim(substr(f, 1, 77)) || '...' ELSE f END AS flat
FROM (SELECT id, replace(regexp_replace(trim(snippet, E' \n'), E'[\r\n]+', ' ', 'g'), '|', '/') AS s,
             replace(trim(regexp_replace(snippet || '  ' || body, '\s+', ' ', 'g')), '|', '/') AS f FROM msg)""")
def snippet_field(spark, folder):
    return C.messages(spark, folder).select(
        "id", headers.snippet_field(F.col("snippet")).alias("snippet"),
        headers.flat_body(F.concat("snippet", F.lit("  "), "body")).alias("flat"))


@query("sender_filter", M + "SELECT id, sender FROM msg WHERE contains(lower(sender), 'u1')")
def sender_filter(spark, folder):
    return filters.listing(C.messages(spark, folder), now=C.NOW, sender="U1").select("id", "sender")


@query("domain_filter", M + """
SELECT id, sender FROM msg WHERE contains(sender, '@')
  AND ('.' || split_part(sender, '@', 2)) LIKE '%.furniture.example.com'
UNION ALL SELECT id, sender FROM msg WHERE contains(sender, '@') AND ('.' || split_part(sender, '@', 2)) LIKE '%.building.example.com'""")
def domain_filter(spark, folder):
    """One exact domain and one that is matched as a sub-domain."""
    df = C.messages(spark, folder)
    exact = filters.listing(df, now=C.NOW, domain="@Furniture.example.com")
    below = filters.listing(df, now=C.NOW, domain="example.com").where(F.col("sender").contains("@building."))
    return exact.unionByName(below).select("id", "sender")


@query("text_query", M + """
SELECT id, subject FROM msg
WHERE contains(lower(sender), 'urgent') OR contains(lower(subject), 'urgent') OR contains(lower(snippet), 'urgent')""")
def text_query(spark, folder):
    return filters.listing(C.messages(spark, folder), now=C.NOW, query="URGENT").select("id", "subject")


@query("since_filter", M + "SELECT id, date FROM msg WHERE date >= '2001-05-02T00:00:00Z'")
def since_filter(spark, folder):
    return filters.listing(C.messages(spark, folder), now=C.NOW, since="92d").select("id", "date")


@query("stacked_filters", M + """
SELECT id, date FROM msg WHERE date >= '2000-08-24T00:00:00Z' AND contains(sender, '@') AND unread
  AND contains(sender, 'example.com') AND (contains(subject, 'HIGH') OR contains(snippet, 'HIGH'))""")
def stacked_filters(spark, folder):
    return filters.listing(
        C.messages(spark, folder), now=C.NOW, since="49w", domain="example.com", query="high", unread_only=True,
    ).select("id", "date")


@query("skip_filters", M + r"""
SELECT id FROM msg
WHERE coalesce(category, '') <> 'ci'
  AND sender NOT IN (SELECT 'u' || c_custkey || '@' || lower(c_mktsegment) || '.example.com' FROM customer WHERE c_custkey % 9 = 0)
  AND (NOT contains(sender, '@') OR split_part(sender, '@', 2) <> 'machinery.example.com')
  AND NOT is_group
  AND NOT regexp_matches(subject || ' ' || body, '(?i)#1[0-4]\b') AND NOT regexp_matches(subject || ' ' || body, '(?i)body 2\d+ 1-')""")
def skip_filters(spark, folder):
    """Rules of every kind: many senders, one domain, a category, groups, two patterns and a broken one."""
    customer = C.table(spark, folder, "customer")
    rules = customer.where("c_custkey % 9 = 0").selectExpr(
        "'sender' AS rule_type", "concat('U', c_custkey, '@', c_mktsegment, '.example.com') AS value").unionByName(
        C.constant(spark, [("domain", "MACHINERY.example.com")], "rule_type STRING, value STRING"))
    patterns = filters.usable_patterns(spark, [r"#1[0-4]\b", r"body 2\d+ 1-", "(broken"])
    return filters.skip(C.messages(spark, folder), rules, groups=True, patterns=patterns, categories=["CI"]).select("id")


@query("rule_maintenance", """
SELECT 'sender' AS rule_type, lower(c_mktsegment) || '@x.com' AS value FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY ALL
UNION ALL SELECT 'pattern', c_mktsegment FROM customer GROUP BY ALL""")
def rule_maintenance(spark, folder):
    customer = C.table(spark, folder, "customer")
    new = customer.selectExpr("'sender' AS rule_type", "concat(c_mktsegment, '@X.com') AS value").unionByName(
        customer.selectExpr("'pattern' AS rule_type", "c_mktsegment AS value"))
    gone = customer.where("c_mktsegment = 'BUILDING'").selectExpr("'sender' AS rule_type", "'Building@x.com' AS value")
    return filters.remove_rules(filters.add_rules(new.limit(0), new), gone)


@query("period_filter", M + """
SELECT id, date, 'quarter' AS period FROM msg WHERE date >= '1997-10' AND date < '1998-01'
UNION ALL SELECT id, date, 'range' FROM msg WHERE date >= '1999-11' AND date < '2000-02'""")
def period_filter(spark, folder):
    df = C.messages(spark, folder)
    quarter = df.where(filters.in_period("1997-Q4")).withColumn("period", F.lit("quarter"))
    span = df.where(filters.in_period("1999-11..2000-01")).withColumn("period", F.lit("range"))
    return quarter.unionByName(span).select("id", "date", "period")


@query("contact_filter", MC + """
, idents AS (SELECT lower(identifier) AS i FROM contact_ids WHERE alias = 'aa3'),
needles AS (SELECT i FROM idents UNION SELECT substr(i, instr(i, ':') + 1) FROM idents)
SELECT DISTINCT id, sender FROM msg JOIN needles ON contains(lower(sender), i)""")
def contact_filter(spark, folder):
    return filters.from_contact(C.messages(spark, folder), C.contacts(spark, folder), "AA3").select("id", "sender")


NOISE = MC + """
, known AS (SELECT DISTINCT lower(identifier[position(':' IN identifier) + 1:]) AS sender FROM contact_ids),
shown AS (SELECT id, sender, labels, CASE WHEN seq % 19 = 0 THEN 'forwarded' WHEN seq % 23 = 0 THEN 'attachments' WHEN seq % 19 <> 1 AND length(trim(body)) < 20 THEN 'trivial' END AS kind FROM msg),
flagged AS (SELECT id, CASE WHEN list_contains(labels, 'CATEGORY_SOCIAL') THEN 'label' WHEN sender LIKE '%@household.%' THEN 'automated'
  WHEN lower(sender) NOT IN (SELECT sender FROM known) THEN 'unknown' ELSE kind END AS noise FROM shown)
"""


def _flagged(spark, folder):
    df = C.messages(spark, folder).withColumns({
        "body": F.expr("""CASE WHEN seq % 19 = 0 THEN concat(' \n---------- Forwarded message ---------\n', body) WHEN seq % 23 = 0 THEN ' '
            WHEN seq % 19 = 1 THEN concat('see below please\nBegin forwarded message:\n', body) ELSE body END"""),
        "snippet": F.lit(None).cast("string"),
        "attachments": F.expr("if(seq % 23 = 0, array(struct('a.pdf' AS filename, 'application/pdf' AS mime_type, 9L AS size)), NULL)")})
    allowed = C.contacts(spark, folder).selectExpr("substring(identifier, instr(identifier, ':') + 1) AS identifier")
    return filters.noise_flags(df, automated=["%@household.%"], labels=["CATEGORY_SOCIAL"], allowed=allowed)


@query("noise_layers", NOISE + "SELECT id, noise FROM flagged")
def noise_layers(spark, folder):
    """The first layer of noise that catches each message."""
    return _flagged(spark, folder).select("id", "noise")


@query("noise_report", NOISE + """
SELECT coalesce(noise, 'processed') AS layer, count(*) AS messages FROM flagged GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM flagged""")
def noise_report(spark, folder):
    """What each layer caught, what is left, and all."""
    return filters.noise_report(_flagged(spark, folder))


@query("source_selection", with_views(MSG, SOURCES) + """
, picked AS (SELECT 'gmail' AS wanted, prefix FROM sources WHERE provider = 'gmail'
  UNION ALL SELECT 'outlook', prefix FROM sources WHERE provider = 'o365'
  UNION ALL SELECT 'GW', prefix FROM sources WHERE prefix = 'gw' UNION ALL SELECT 'all', prefix FROM sources)
SELECT wanted, prefix, count(id) AS messages FROM picked LEFT JOIN msg ON source = prefix GROUP BY ALL""")
def source_selection(spark, folder):
    """Messages of the sources that a provider, an alias, a prefix or ``all`` selects."""
    counts = C.messages(spark, folder).groupBy(F.col("source").alias("prefix")).agg(F.count("*").alias("messages"))
    out = None
    for wanted in ("gmail", "outlook", "GW", "all"):
        part = filters.select_sources(C.sources(spark), wanted).select(F.lit(wanted).alias("wanted"), "prefix")
        out = part if out is None else out.unionByName(part)
    return out.join(counts, "prefix", "left").withColumn("messages", F.coalesce("messages", F.lit(0)))


@query("mailbox_validity", M + """
SELECT id, mailbox FROM msg WHERE schema_version >= 3 AND (source = 'w' OR mailbox LIKE '%me@example.com')""")
def mailbox_validity(spark, folder):
    return filters.current_rows(C.messages(spark, folder), C.sources(spark)).select("id", "mailbox")


@query("cache_scan", M + """
SELECT id, date FROM msg WHERE schema_version >= 3 AND source = 'o' AND date >= '2000-01-01' AND contains(sender, 'u3')""")
def cache_scan(spark, folder):
    """A scan of the stored cache: rows of an old version, and what was fetched since."""
    fetched = C.messages(spark, folder)
    old = fetched.where("_schema_version < 3").drop("body").withColumn("_cached_at", F.lit("2001-08-01"))
    new = fetched.where("_schema_version >= 3").drop("_schema_version")
    path = fresh_path(spark, "cache")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    store.create(old, name, path, buckets=4)
    store.merge(name, store.stamped(new, C.sources(spark), F.lit("2001-08-02")))
    return store.scan(spark.table(name), source="o", since="2000-01-01", sender="U3").select("id", "date")


RESOLVED = MCS + """
, pair AS (SELECT DISTINCT source, sender FROM msg),
cand AS (
  SELECT source, sender, 0 AS prio, sender AS key FROM pair
  UNION ALL SELECT source, sender, 1, source || ':' || sender FROM pair
  UNION ALL SELECT p.source, sender, 10 + s2.ord, s2.prefix || ':' || sender
    FROM pair p JOIN sources s1 ON s1.prefix = p.source JOIN sources s2 ON s2.provider = s1.provider
  UNION ALL SELECT source, sender, 100, 'g:' || sender FROM pair
  UNION ALL SELECT source, sender, 101, 'o:' || sender FROM pair
  UNION ALL SELECT source, sender, 102, 'w:' || sender FROM pair),
best AS (
  SELECT source, sender, arg_min(alias, row(prio, alias)) AS alias
  FROM cand JOIN contact_ids ON identifier = key GROUP BY ALL),
resolved AS (SELECT pair.source, pair.sender, coalesce(alias, pair.sender) AS name FROM pair LEFT JOIN best USING (source, sender))
"""


@query("resolve_sender", RESOLVED + "SELECT id, name FROM msg JOIN resolved USING (source, sender)")
def resolve_sender(spark, folder):
    return lookups.with_aliases(C.messages(spark, folder), C.contacts(spark, folder), C.sources(spark)).select("id", "name")


@query("sibling_prefixes", with_views(SOURCES, MSG) + """
SELECT s1.prefix, s2.prefix AS sibling, count(msg.id) AS messages FROM sources s1 JOIN sources s2 ON s1.provider = s2.provider
LEFT JOIN msg ON msg.source = s2.prefix GROUP BY ALL""")
def sibling_prefixes(spark, folder):
    """Messages under each source and under the sources of the same provider."""
    counts = C.messages(spark, folder).groupBy(F.col("source").alias("sibling")).agg(F.count("*").alias("messages"))
    return lookups.siblings(C.sources(spark)).join(counts, "sibling", "left").select(
        "prefix", "sibling", F.coalesce("messages", F.lit(0)).alias("messages"))


@query("longest_prefix", """
WITH ids AS (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'g:' WHEN 1 THEN 'gw:' WHEN 2 THEN 'gw:x:' WHEN 3 THEN 'zz:' ELSE '' END || o_orderkey AS id, o_orderkey % 5 AS k FROM orders)
SELECT id, CASE k WHEN 0 THEN 'g' WHEN 1 THEN 'gw' WHEN 2 THEN 'gw:x' WHEN 3 THEN 'zz' END AS source FROM ids""")
def longest_prefix(spark, folder):
    ids = C.table(spark, folder, "orders").selectExpr(
        "concat(CASE o_orderkey % 5 WHEN 0 THEN 'g:' WHEN 1 THEN 'gw:' WHEN 2 THEN 'gw:x:' WHEN 3 THEN 'zz:' ELSE '' END, o_orderkey) AS id")
    known = C.sources(spark).select("prefix").unionByName(C.constant(spark, [("gw:x",)], "prefix string"))
    return lookups.source_by_prefix(ids, known)


@query("known_unknown_split", M + """
SELECT id, date, CASE WHEN seq % 3 = 0 THEN 'cache' ELSE 'provider' END AS origin FROM msg WHERE seq % 2 = 0""")
def known_unknown_split(spark, folder):
    df = C.messages(spark, folder)
    asked = df.where("seq % 2 = 0").select("id")
    return lookups.read_through(asked, df.where("seq % 3 = 0"), df).select("id", "date", "origin")


@query("thread_of_id", M + """
SELECT id AS asked, coalesce(thread_id, id) AS thread_id FROM msg
UNION ALL SELECT DISTINCT thread_id, thread_id FROM msg WHERE thread_id IS NOT NULL""")
def thread_of_id(spark, folder):
    df = C.messages(spark, folder)
    asked = df.select("id").unionByName(df.where("thread_id IS NOT NULL").select(F.col("thread_id").alias("id")).distinct())
    return lookups.thread_of(asked, df).select(F.col("id").alias("asked"), "thread_id")


@query("contact_messages", MC + """
SELECT DISTINCT id, alias, CASE WHEN seq % 4 = 0 THEN 'x@y.org, ' || sender ELSE '' END AS cc FROM msg JOIN contact_ids ON identifier = 'g:' || sender WHERE source = 'g'""")
def contact_messages(spark, folder):
    """Messages from a contact, or with the contact among those who got a copy."""
    copied = F.col("seq") % 4 == 0
    df = C.messages(spark, folder).withColumn("cc", F.when(copied, F.concat(F.lit("x@y.org, "), "sender")).otherwise(""))
    df = df.withColumn("sender", F.when(copied, F.lit("list@example.org")).otherwise(F.col("sender")))
    return lookups.contact_messages(df, C.contacts(spark, folder), "g").select("id", "alias", "cc")


@query("configured_sources", with_views(MSG, SOURCES) + """
SELECT msg.source, sources.provider, ord AS source_ord, count(*) AS messages FROM msg JOIN sources ON prefix = source GROUP BY ALL""")
def configured_sources(spark, folder):
    return lookups.configured(C.messages(spark, folder).drop("source_ord"), C.sources(spark)).groupBy(
        "source", "provider", "source_ord").agg(F.count("*").alias("messages"))


@query("point_read", M + """
, known AS (SELECT id, row_number() OVER (ORDER BY seq) AS ref FROM msg WHERE seq % 50 = 0),
asked AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN '#' || (o_orderkey % 60) ELSE 'g:m' || o_orderkey END AS asked FROM orders WHERE o_orderkey % 25 < 2)
SELECT asked, msg.id, subject, body FROM asked LEFT JOIN known ON asked = '#' || ref JOIN msg ON msg.id = coalesce(known.id, asked)""")
def point_read(spark, folder):
    """Messages read by id or by short reference, with their bodies."""
    df = C.messages(spark, folder)
    asked = C.table(spark, folder, "orders").where("o_orderkey % 25 < 2").selectExpr(
        "if(o_orderkey % 2 = 0, concat('#', o_orderkey % 60), concat('g:m', o_orderkey)) AS asked")
    refs = ordering.number_rows(df.where("seq % 50 = 0").select("id", "seq"), ["seq"], "ref").select("id", "ref")
    wanted = lookups.resolve_refs(asked, refs).select("asked", "id")
    full = store.read_messages(df.drop("body"), df.select("id", "mailbox", "body"), wanted.select("id").distinct())
    return wanted.join(full, "id").select("asked", "id", "subject", "body")


@query("provider_ids", M + """
SELECT id, substr(id, 3) AS own_id, regexp_replace(id, '[^A-Za-z0-9._-]', '_', 'g') AS file_id, id AS kept FROM msg""")
def provider_ids(spark, folder):
    """Ids without their source, and as file names; an id of another source stays whole."""
    from letterloom.functions.headers import path_id, strip_source
    return C.messages(spark, folder).select(
        "id", strip_source(F.col("id"), F.col("source")).alias("own_id"), path_id(F.col("id")).alias("file_id"),
        strip_source(F.col("id"), F.lit("zz")).alias("kept"))


@query("point_read_threads", M + """
, asked AS (SELECT CASE WHEN seq % 80 = 0 AND thread_id IS NOT NULL THEN thread_id ELSE id END AS asked,
    CASE WHEN thread_id IS NOT NULL THEN thread_id WHEN source = 'w' THEN 'w:' || chat_jid ELSE id END AS thread, source FROM msg WHERE seq % 40 = 0 AND source <> 'w'),
numbered AS (SELECT id, coalesce(thread_id, id) AS thread, row_number() OVER (PARTITION BY coalesce(thread_id, id) ORDER BY date, seq) AS idx FROM msg WHERE source <> 'w')
SELECT DISTINCT asked, id, idx FROM asked JOIN numbered USING (thread)""")
def point_read_threads(spark, folder):
    """Threads read by the id of one of their messages, or by their own."""
    df = C.messages(spark, folder)
    asked = df.where("seq % 40 = 0 AND source <> 'w'").selectExpr("if(seq % 80 = 0 AND thread_id IS NOT NULL, thread_id, id) AS id").distinct()
    return store.read_threads(asked, df).select("asked", "id", F.col("idx").cast("bigint").alias("idx"))


@query("point_read_events", with_views(EVENTS) + "SELECT id, title, start FROM cal WHERE event_id % 30 = 0")
def point_read_events(spark, folder):
    """Events read by id; ids of no event give nothing."""
    asked = C.table(spark, folder, "events").where("event_id % 30 = 0").selectExpr("explode(array(concat('c', user_id % 3, ':', event_id), concat('z:', event_id))) AS id")
    return store.read_events(asked, C.events(spark, folder)).select("id", "title", "start")
