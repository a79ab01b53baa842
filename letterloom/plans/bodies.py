"""Queries over bodies and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from letterloom.functions import bodies
from letterloom.operators import usage
from letterloom.plans import corpora as C
from letterloom.plans.registry import query
from letterloom.plans.sql_views import BODIES, PAGES, with_views
from letterloom.session import spread

WS = r"E' \t\n\r\f\x0b '"

# The patterns of ``functions.patterns`` in the dialect of the checking SQL.
REPLY = r"""(?i)^(On\s+(Mon|Tue|Wed|Thu|Fri|Sat|Sun).*\bwrote:\s*|On\s+\d.*\bwrote:\s*|On\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\b.*\bwrote:\s*|-{2,}\s*(Original|Forwarded)\s+message\s*-{2,}\s*)$"""
SIG = r"""(?i)^(--\s*|---+\s*|_{3,}\s*|Sent from (my )?\w.*|Sent via\b.*|Get Outlook for\b.*|(Best|Kind|Warm)\s+regards?\s*[,.]?\s*|(Thanks|Thank you|Cheers|Regards|Sincerely|Yours truly|With appreciation|All the best|Talk soon)\s*[,.]?\s*)$"""
CONF = r"""(?i)(this\s+(email|message|communication)\s+is\s+(intended|confidential)|confidentiality\s+notice|privileged\s+and\s+confidential|if\s+you\s+(are\s+not|have\s+received)\s+this\s+(email|message)\s+in\s+error|please\s+notify\s+the\s+sender\s+immediately|unauthorized\s+(use|disclosure|review|distribution))"""
UNSUB = r"""(?im)^.*(unsubscribe|opt[\s-]?out|email\s+preferences|manage\s+subscriptions?|update\s+(your\s+)?preferences|no\s+longer\s+wish\s+to\s+receive|stop\s+receiving|view\s+(in|this\s+email\s+in)\s+(your\s+)?browser|add\s+us\s+to\s+your\s+address\s+book|problems?\s+(viewing|displaying)\s+this\s+email|click\s+here\s+to\s+view\s+this\s+message).*$"""


def sql_replies(source: str) -> str:
    """Quoted replies cut line by line."""
    return rf"""
    SELECT * EXCLUDE (lines, cut, kept), array_to_string(list_filter(string_split(kept, chr(10)), lambda x: NOT regexp_matches(x, '^\s*>')), chr(10)) AS body FROM (
      SELECT * EXCLUDE (body), CASE WHEN cut > 0 THEN rtrim(array_to_string(lines[1:cut - 1], chr(10)), {WS}) ELSE body END AS kept FROM (
        SELECT *, list_position(list_transform(lines, lambda x: regexp_matches(regexp_replace(x, '[*_]', '', 'g'), '{REPLY}')), true) AS cut FROM (
          SELECT *, string_split(body, chr(10)) AS lines FROM {source})))"""


def sql_signature(source: str) -> str:
    return rf"""
    SELECT * EXCLUDE (lines, skipped, cut, body), CASE WHEN cut > 0 THEN array_to_string(lines[1:skipped + cut - 1], chr(10)) ELSE body END AS body FROM (
      SELECT *, list_position(list_transform(lines[skipped + 1:], lambda x: regexp_matches(trim(x, {WS}), '{SIG}')
          OR regexp_matches(regexp_replace(trim(x, {WS}), '[*_]', '', 'g'), '{SIG}') OR regexp_matches(x, '{CONF}')), true) AS cut FROM (
        SELECT *, greatest(0, len(lines) - greatest(len(lines) * 2 // 5, 15)) AS skipped FROM (
          SELECT *, string_split(body, chr(10)) AS lines FROM {source})))"""


def sql_unsub(source: str) -> str:
    return f"SELECT * REPLACE (regexp_replace(body, '{UNSUB}', '', 'g') AS body) FROM {source}"


def sql_blank(source: str) -> str:
    return rf"""SELECT * REPLACE (trim(regexp_replace(regexp_replace(body, '(?m)[ \t]+$', '', 'g'), '\n{{3,}}', E'\n\n', 'g'), E'\n') AS body) FROM {source}"""


B = with_views(BODIES)
PICK = "SELECT doc_id, md5(body) AS body_md5, length(body) AS n_chars FROM "


def _digest(df, name="body"):
    return df.select("doc_id", F.md5(name).alias("body_md5"), F.length(name).cast("bigint").alias("n_chars"))


@query("strip_replies", B + PICK + f"({sql_replies('bodies')})")
def strip_replies(spark, folder):
    return _digest(bodies.strip_replies(C.bodies(spark, folder), "body"))


@query("strip_signature", B + PICK + f"({sql_signature('bodies')})")
def strip_signature(spark, folder):
    return _digest(bodies.strip_signature(C.bodies(spark, folder), "body"))


@query("strip_unsub", B + PICK + f"({sql_unsub('bodies')})")
def strip_unsub(spark, folder):
    return _digest(bodies.strip_boilerplate(C.bodies(spark, folder), "body"))


@query("collapse_ws", B + PICK + f"({sql_blank('bodies')})")
def collapse_ws(spark, folder):
    return _digest(bodies.collapse_blank(C.bodies(spark, folder), "body"))


CLEAN = f"""
, s0 AS (SELECT * REPLACE (trim(body, {WS}) AS body) FROM bodies),
s1 AS ({sql_replies('s0')}), s2 AS ({sql_signature('s1')}), s3 AS ({sql_unsub('s2')}), s4 AS ({sql_blank('s3')}),
cleaned AS (SELECT * REPLACE (trim(body, {WS}) AS body) FROM s4)
"""


@query("clean_text", B + CLEAN + PICK + "cleaned")
def clean_text(spark, folder):
    """Every plain-text stage in order."""
    return _digest(bodies.clean_text(C.bodies(spark, folder), "body"))


@query("clean_reduction", B + CLEAN + """
SELECT b.lang, CAST(sum(strlen(b.body)) AS BIGINT) AS bytes_in, CAST(sum(strlen(c.body)) AS BIGINT) AS bytes_out, count(*) AS documents,
  round_even((1 - sum(strlen(c.body)) / sum(strlen(b.body))) * 100, 1) AS saved_pct
FROM bodies b JOIN cleaned c USING (doc_id) GROUP BY b.lang""")
def clean_reduction(spark, folder):
    df = C.bodies(spark, folder).withColumn("raw", F.col("body"))
    return usage.reduction(bodies.clean_text(df, "body"), "raw", "body", "lang")


@query("html_detection", with_views(PAGES, BODIES) + r"""
SELECT CAST(regexp_matches(body, '(?i)<(html|head|body|div|span|p|br|table|tr|td|th|a\s|img\s|h[1-6]|ul|ol|li|strong|em|b|i|style|script|meta|link|footer|header|blockquote|center|font|!DOCTYPE|!--)[^>]*>') AS BOOLEAN) AS html, count(*) AS documents
FROM (SELECT html AS body FROM page UNION ALL SELECT 'mail <u' || doc_id || '@example.com> ' || body FROM bodies) GROUP BY ALL""")
def html_detection(spark, folder):
    """Pages are HTML; plain bodies with an address in angle brackets are not."""
    pages = C.pages(spark, folder).select(F.col("html").alias("body"))
    plain = C.bodies(spark, folder).select(F.concat(F.lit("mail <u"), F.col("doc_id").cast("string"), F.lit("@example.com> "), "body").alias("body"))
    return pages.union(plain).select(bodies.is_html(F.col("body")).alias("html")).groupBy("html").agg(F.count("*").alias("documents"))


@query("html_to_text_native", with_views(PAGES) + r"""
, a AS (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS t FROM page),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g'), '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)<head\b[^>]*>.*?</head\s*>', '', 'g') AS t FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)<img\b[^>]*>', '', 'g'), '\s+', ' ', 'g') AS t FROM b),
l AS (SELECT page_id, replace(regexp_replace(t, '(?is)<a\b[^>]*?\bhref="(?:#|mailto:|[^"]*(?:click\.|track\.|trk\.|redirect\.|go\.|link\.|mailchi\.mp|list-manage|sendgrid|mailgun))[^"]*"[^>]*>([^<]*)</a>', '\1', 'g'),
  '<a href="https://self.example/">https://self.example/</a>', 'https://self.example/') AS t FROM c),
d AS (SELECT page_id, regexp_replace(t, '(?is)<a\b[^>]*?\bhref="([^"]+)"[^>]*>([^<]*)</a>', '\2 (\1)', 'g') AS t FROM l),
e AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)<(br|/p|/div|/li|/tr|/h[1-6]|/ul|/ol|/blockquote|/article|/footer|/nav)\b[^>]*>', E'\n', 'g'), '<[^>]+>', '', 'g') AS t FROM d),
f AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS t FROM e),
g AS (SELECT page_id, trim(regexp_replace(regexp_replace(t, ' *\n *', E'\n', 'g'), '\n{3,}', E'\n\n', 'g'), """ + WS + r""") AS t FROM f)
SELECT page_id, md5(t) AS text_md5, length(t) AS n_chars FROM g""")
def html_to_text_native(spark, folder):
    text = spread(C.pages(spark, folder)).withColumn("text", bodies.simple_html_to_text(F.col("html")))
    return text.select("page_id", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("n_chars"))


@query("tracking_images", with_views(PAGES) + """
SELECT page_id, CASE WHEN page_id % 5 = 3 THEN 1 ELSE 0 END AS trackers FROM page""")
def tracking_images(spark, folder):
    """Tracking images per page."""
    tags = F.regexp_extract_all("html", F.lit(r"(?i)<img\b[^>]*>"), F.lit(0))
    from letterloom.functions.patterns import TINY_STYLE, TRACKER_URL
    side = r"""(?i)\b{}\s*=\s*["']?[0-3](?:px)?["'\s/>]"""
    tracker = lambda t: (t.rlike(side.format("width")) & t.rlike(side.format("height"))) | t.rlike(f"(?i){TINY_STYLE}") | t.rlike(f"(?i){TRACKER_URL}")
    return C.pages(spark, folder).select("page_id", F.size(F.filter(tags, tracker)).alias("trackers"))
