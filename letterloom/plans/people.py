"""Queries over the contact map and its import."""

from __future__ import annotations

from pyspark.sql import functions as F

from letterloom.operators import identity
from letterloom.plans import corpora as C
from letterloom.plans.registry import query
from letterloom.plans.sql_views import CONTACTS, CUST, with_views

P = with_views(CUST, CONTACTS)


@query("link_unlink", P + """
, added AS (SELECT alias, identifier FROM contact_ids UNION SELECT 'friends', 'g:' || mail FROM cust WHERE k % 10 = 0 UNION SELECT lower(c_name), 'h:x' || k FROM cust WHERE k % 4 = 0)
SELECT alias, identifier FROM added WHERE alias NOT IN (SELECT lower(c_name) FROM cust WHERE k % 6 = 0)
  AND NOT (alias = 'friends' AND identifier IN (SELECT 'g:' || mail FROM cust WHERE k % 20 = 0))""")
def link_unlink(spark, folder):
    """Identifiers are added to old and new aliases, then some go and some aliases go whole."""
    customers = C.table(spark, folder, "customer").selectExpr(
        "*", "concat('u', c_custkey, '@', lower(c_mktsegment), '.example.com') AS mail")
    new = customers.where("c_custkey % 10 = 0").selectExpr("' Friends ' AS alias", "concat('g:', mail) AS identifier", "CAST(c_custkey AS INT) AS ord").unionByName(
        customers.where("c_custkey % 4 = 0").selectExpr("c_name AS alias", "concat('h:x', c_custkey) AS identifier", "1 AS ord"))
    gone = customers.where("c_custkey % 6 = 0").selectExpr("c_name AS alias", "CAST(NULL AS STRING) AS identifier").unionByName(
        customers.where("c_custkey % 20 = 0").selectExpr("'friends' AS alias", "concat('g:', mail) AS identifier"))
    return identity.unlink(identity.link(C.contacts(spark, folder), new), gone).select("alias", "identifier")


@query("contact_search", P + """
SELECT alias, identifier FROM contact_ids WHERE alias IN (SELECT alias FROM contact_ids WHERE contains(alias, 'aa') OR contains(lower(identifier), 'u12'))""")
def contact_search(spark, folder):
    """Aliases found by a part of their name, and by a part of an identifier."""
    df = C.contacts(spark, folder)
    return identity.find(df, "AA").unionByName(identity.find(df, "u12")).distinct().select("alias", "identifier")


CARDS = """
card AS (SELECT c_custkey AS seq, CASE WHEN c_custkey % 13 = 0 THEN '' ELSE 'person ' || (c_custkey % 400) END AS alias,
  CASE WHEN c_custkey % 17 = 0 THEN [] ELSE ['p' || (c_custkey % 700) || '@example.com'] END AS emails,
  CASE c_custkey % 6 WHEN 0 THEN '3160000' || lpad(CAST(c_custkey % 300 AS VARCHAR), 4, '0') || '@s.whatsapp.net' END AS jid,
  CASE WHEN c_custkey % 6 = 1 THEN 1 ELSE 0 END AS bad FROM customer),
full_card AS (SELECT *, list_concat(list_concat(list_transform(emails, lambda x: 'g:' || x), list_transform(emails, lambda x: 'gw:' || x)),
  CASE WHEN jid IS NULL THEN [] ELSE ['w:' || jid] END) AS idents FROM card),
existing AS (SELECT 'person ' || c_custkey AS alias, unnest(CASE WHEN c_custkey % 100 = 0 THEN ['g:p' || c_custkey || '@example.com', 'gw:p' || c_custkey || '@example.com']
  ELSE ['g:p' || c_custkey || '@example.com'] END) AS identifier FROM customer WHERE c_custkey % 50 = 0)"""

PLAN = "WITH RECURSIVE " + CARDS + """
, ex_alias AS (SELECT alias, list(identifier) AS l FROM existing GROUP BY alias),
ex_owner AS (SELECT identifier, max(alias) AS owner FROM existing GROUP BY identifier),
eligible AS (SELECT seq, alias, idents, row_number() OVER (ORDER BY seq) AS i,
    list_prepend('a:' || alias, list_transform(idents, lambda x: 'i:' || x)) AS claims
  FROM full_card WHERE alias <> '' AND len(idents) > 0 AND alias NOT IN (SELECT alias FROM ex_alias)
    AND NOT list_has_any(idents, (SELECT list(identifier) FROM existing))),
greedy AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS held, false AS ok
  UNION ALL SELECT e.i, CASE WHEN list_has_any(g.held, e.claims) THEN g.held ELSE list_concat(g.held, e.claims) END, NOT list_has_any(g.held, e.claims)
  FROM greedy g JOIN eligible e ON e.i = g.i + 1),
won AS (SELECT e.* FROM eligible e JOIN greedy USING (i) WHERE ok),
owned AS (SELECT identifier, -1 AS by_seq, owner FROM ex_owner UNION ALL SELECT unnest(idents), seq, alias FROM won),
cand AS (SELECT seq, alias, unnest(idents) AS identifier, generate_subscripts(idents, 1) AS ord FROM full_card WHERE seq NOT IN (SELECT seq FROM won)),
hit AS (SELECT seq, arg_min(identifier || ' already linked to ''' || owner || '''', ord) AS reason FROM cand JOIN owned USING (identifier) WHERE by_seq < seq GROUP BY seq),
dup AS (SELECT DISTINCT c.seq FROM cand c JOIN won w ON w.alias = c.alias AND w.seq < c.seq),
plan AS (SELECT f.seq, f.alias, f.idents, f.bad, CASE WHEN f.alias = '' THEN 'no name' WHEN len(f.idents) = 0 THEN 'no phone or email'
    WHEN x.alias IS NOT NULL THEN CASE WHEN list_has_all(x.l, f.idents) THEN 'already up to date' ELSE 'alias already exists' END
    WHEN dup.seq IS NOT NULL THEN 'duplicate in import' ELSE hit.reason END AS reason
  FROM full_card f LEFT JOIN ex_alias x USING (alias) LEFT JOIN dup ON dup.seq = f.seq LEFT JOIN hit ON hit.seq = f.seq)
"""


def _cards(spark, folder):
    return C.table(spark, folder, "customer").selectExpr(
        "c_custkey AS seq", "if(c_custkey % 13 = 0, '  ', concat('  Person  ', c_custkey % 400)) AS display_name",
        "CASE c_custkey % 6 WHEN 0 THEN array(concat('+31 60000 ', lpad(c_custkey % 300, 4, '0'))) WHEN 1 THEN array('06-12345678') ELSE array() END AS phones",
        "if(c_custkey % 17 = 0, array(), array(concat('p', c_custkey % 700, '@example.com'))) AS emails")


def _existing(spark, folder):
    return C.table(spark, folder, "customer").where("c_custkey % 50 = 0").selectExpr(
        "concat('person ', c_custkey) AS alias",
        "explode(if(c_custkey % 100 = 0, array('g:p', 'gw:p'), array('g:p'))) AS p", "c_custkey",
    ).selectExpr("alias", "concat(p, c_custkey, '@example.com') AS identifier", "1 AS ord")


def _plan(spark, folder):
    return identity.import_plan(_cards(spark, folder), _existing(spark, folder), ["g", "gw"], ["w"])


@query("card_identifiers", "WITH " + CARDS + "SELECT seq, alias, array_to_string(idents, ' ') AS identifiers, bad AS bad_phones FROM full_card")
def card_identifiers(spark, folder):
    return identity.card_identifiers(_cards(spark, folder), ["g", "gw"], ["w"]).withColumn("identifiers", F.array_join("identifiers", " "))


@query("import_plan", PLAN + """
SELECT seq, alias, CASE WHEN reason IS NULL THEN 'link' WHEN reason IN ('no name', 'no phone or email', 'already up to date') THEN 'skip' ELSE 'conflict' END AS outcome, reason FROM plan""")
def import_plan(spark, folder):
    """The outcome of every card of an address book, first come, first served."""
    return _plan(spark, folder).select("seq", "alias", "outcome", "reason")


@query("import_skips", PLAN + """
SELECT reason, count(*) AS count FROM plan WHERE reason IN ('no name', 'no phone or email', 'already up to date') GROUP BY reason
UNION ALL SELECT 'phone number without a country code (+ or 00)', CAST(sum(bad) AS BIGINT) FROM plan WHERE alias <> ''""")
def import_skips(spark, folder):
    return identity.skipped(_plan(spark, folder)).withColumn("count", F.col("count").cast("bigint"))


@query("import_applied", PLAN + """
SELECT alias, identifier FROM existing UNION SELECT alias, unnest(idents) FROM plan WHERE reason IS NULL""")
def import_applied(spark, folder):
    """The contact map once the plan is applied."""
    old = _existing(spark, folder)
    return identity.link(old, identity.planned_links(_plan(spark, folder))).select("alias", "identifier")


@query("import_report", PLAN + """
, lines AS (SELECT 1 AS section, seq AS line_no, alias || '|' || array_to_string(idents, '|') AS line FROM plan WHERE reason IS NULL
  UNION ALL SELECT 2, seq, alias || '|' || reason FROM plan WHERE reason NOT IN ('no name', 'no phone or email', 'already up to date')
  UNION ALL SELECT 3, 0, count(*) || '|' || reason FROM plan WHERE reason IN ('no name', 'no phone or email', 'already up to date') GROUP BY reason
  UNION ALL SELECT 3, 0, sum(bad) || '|phone number without a country code (+ or 00)' FROM plan WHERE alias <> '')
SELECT * FROM lines UNION ALL
SELECT section, -1, CASE section WHEN 1 THEN 'LINKS (' || count(*) || '):' WHEN 2 THEN 'CONFLICTS (' || count(*) || ' — stored values left unchanged):' ELSE 'SKIPPED:' END FROM lines GROUP BY section""")
def import_report(spark, folder):
    return identity.plan_report(_plan(spark, folder))


@query("contact_map_stats", P + "SELECT count(DISTINCT alias) AS aliases, count(*) AS identifiers FROM contact_ids")
def contact_map_stats(spark, folder):
    return C.contacts(spark, folder).agg(F.count_distinct("alias").alias("aliases"), F.count("*").alias("identifiers"))
