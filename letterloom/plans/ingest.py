"""Queries that write provider payloads from the given tables and read them back.

Each first builds the payload of a provider as JSON or text from the tables, then runs the
mapper of that provider over it. The SQL gives the expected rows straight from the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.functions.headers import clean_headers
from letterloom.plans import corpora as C
from letterloom.plans.messages import M
from letterloom.plans.registry import query
from letterloom.plans.sql_views import EVENTS, MSG, with_views
from letterloom.session import spread
from letterloom.sources import calendars, cards, chat, gmail, graph, landing, notices, tracker


def b64(text: Column) -> Column:
    return F.translate(F.base64(F.encode(text, "UTF-8")), "+/", "-_")


def part(mime: str, text: Column, name: str = "", **head: str) -> Column:
    """A leaf of a MIME tree."""
    fields = [F.lit(mime).alias("mimeType"), F.lit(name).alias("filename"),
              F.struct(b64(text).alias("data"), F.octet_length(text).alias("size")).alias("body")]
    if head:
        fields.append(F.array(*[F.struct(F.lit(k.replace("_", "-")).alias("name"), F.lit(v).alias("value"))
                                for k, v in head.items()]).alias("headers"))
    return F.struct(*fields)


def _nest(kind: str, *texts: Column) -> Column:
    """A container of parts, all as JSON text."""
    return F.concat(F.lit(f'{{"mimeType":"multipart/{kind}","filename":"","parts":['), F.concat_ws(",", *texts), F.lit("]}"))


def gmail_raw(spark, folder) -> DataFrame:
    """Mail payloads of five MIME shapes."""
    m = C.raw_messages(spark, folder).where("source = 'g'")
    plain, html = F.concat(F.lit("plain "), "body", F.lit(" ünï")), F.concat(F.lit("<p>html "), "body", F.lit("</p>"))
    j = F.to_json
    leaf = j(part("text/plain", plain))
    alt = _nest("alternative", j(part("text/plain", plain)), j(part("text/html", html)))
    nested = _nest("mixed", _nest("related", j(part("text/html", html))), _nest("alternative", j(part("text/plain", plain))),
                   j(part("application/pdf", F.lit("x" * 9), "a.pdf")))
    attached = _nest("mixed", j(part("text/plain", F.lit("note.txt"), "note.txt")),
                     j(part("text/plain", F.lit("cover"), Content_Disposition="ATTACHMENT")), j(part("text/html", html)))
    deep = _nest("mixed", j(part("text/plain", plain)), j(part("image/png", F.lit("y" * 4), "p.png")))
    for _ in range(9):
        deep = _nest("mixed", deep)
    payload = (
        F.when(F.expr("seq % 5 = 0"), leaf).when(F.expr("seq % 5 = 1"), alt).when(F.expr("seq % 5 = 2"), nested)
        .when(F.expr("seq % 5 = 3"), attached).otherwise(deep))
    heads = F.to_json(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in (
        ("X-Other", F.lit("z")), ("FROM", F.col("sender")), ("subject", F.col("subject")), ("To", F.col("to")), ("Message-Id", F.concat(F.lit("<"), "id", F.lit(">"))))]))
    with_heads = F.concat(F.lit('{"headers":'), heads, F.lit(","), F.substr(payload, F.lit(2)))
    ms = F.unix_millis(F.to_timestamp("date")).cast("string")
    text = F.concat(
        F.lit('{"id":"'), F.substr("id", F.lit(3)), F.lit('","threadId":"'), F.coalesce(F.substr("thread_id", F.lit(3)), F.lit("none")),
        F.lit('","internalDate":"'), ms, F.lit('","labelIds":'), F.to_json("labels"), F.lit(',"snippet":"'), "body", F.lit('"'),
        F.lit(',"sizeEstimate":'), F.expr("CAST(seq % 3 * 2000 AS STRING)"), F.lit(',"payload":'), with_heads, F.lit("}"))
    return m.select("source", F.lit("gmail").alias("provider"), "seq", text.alias("payload"))


@query("json_headers", M + """
SELECT id, 'g:' || coalesce(substr(thread_id, 3), 'none') AS thread_id, sender, subject, date, body AS snippet, unread,
  CASE seq % 3 WHEN 1 THEN '2kb' WHEN 2 THEN '4kb' END AS size FROM msg WHERE source = 'g'""")
def json_headers(spark, folder):
    """Mail headers from their payloads."""
    rows = clean_headers(gmail.headers(gmail_raw(spark, folder)))
    return rows.select("id", "thread_id", "sender", "subject", "date", "snippet", "unread", "size")


@query("mime_pick", M + """
SELECT id, CASE WHEN seq % 5 = 3 THEN '<p>html ' || body || '</p>' ELSE 'plain ' || body || ' ünï' END AS body,
  CASE WHEN seq % 5 IN (0, 4) THEN 'plain ' || body || ' ünï' ELSE '<p>html ' || body || '</p>' END AS html_body,
  CASE seq % 5 WHEN 2 THEN 'a.pdf:9' WHEN 3 THEN 'note.txt:8' WHEN 4 THEN 'p.png:4' ELSE '' END AS attachments,
  '<' || id || '>' AS message_id FROM msg WHERE source = 'g'""")
def mime_pick(spark, folder):
    """Bodies picked from MIME trees, plain or HTML first, and the attachments beside them."""
    raw = gmail_raw(spark, folder)
    full = gmail.messages(raw)
    html = gmail.messages(raw, prefer_html=True).select("id", F.col("body").alias("html_body"))
    listed = F.array_join(F.transform("attachments", lambda a: F.concat(a["filename"], F.lit(":"), a["size"].cast("string"))), ",")
    return full.join(html, "id").select("id", "body", "html_body", listed.alias("attachments"), "message_id")


@query("mail_threads", M + """
SELECT 'g:x' || seq AS thread_id, 'g:m' || seq || '-' || i AS id, i + 1 AS idx, seq % 4 + 1 AS message_count, raw_subject AS thread_subject
FROM msg, range(4) r(i) WHERE source = 'g' AND i <= seq % 4""")
def mail_threads(spark, folder):
    """Thread payloads of one to four messages spread into numbered messages."""
    raw = gmail_raw(spark, folder)
    one = F.concat(F.lit('"id":"m'), F.col("seq").cast("string"))
    listed = F.transform(F.sequence(F.lit(0), F.expr("seq % 4")), lambda i: F.replace(
        F.col("payload"), F.concat(one, F.lit('"')), F.concat(one, F.lit("-"), i.cast("string"), F.lit('"'))))
    payload = F.concat(F.lit('{"id":"x'), F.col("seq").cast("string"), F.lit('","messages":['), F.array_join(listed, ","), F.lit("]}"))
    return gmail.thread_messages(raw.withColumn("payload", payload)).select("thread_id", "id", "idx", "message_count", "thread_subject")


def person(name: Column, address: Column) -> Column:
    return F.struct(F.struct(name.alias("name"), address.alias("address")).alias("emailAddress"))


@query("graph_messages", M + """
SELECT id, coalesce(thread_id, '') AS thread_id, CASE WHEN seq % 3 = 0 THEN 'u' || custkey || '@x.org' ELSE 'User ' || custkey || ' <u' || custkey || '@x.org>' END AS sender,
  raw_subject AS subject, date, CASE WHEN seq % 4 = 0 THEN 'pre ' || seq ELSE body END AS body, seq % 5 = 0 AS unread,
  'Ann <ann@x.org>, bob@x.org' AS recipients, CASE WHEN seq % 2 = 0 THEN 'list' ELSE 'bare' END AS form FROM msg WHERE source = 'o'""")
def graph_messages(spark, folder):
    """Office mail: headers from lists of both forms, bodies from single messages of both forms."""
    lists, singles = graph_raw(spark, folder)
    heads = graph.headers(lists).select("id", "thread_id", "sender", "subject", "date", "unread", F.when(F.expr("seq % 2 = 0"), F.lit("list")).otherwise("bare").alias("form"))
    return heads.join(graph.messages(singles).select("id", "body", F.col("to").alias("recipients")), "id")


def graph_raw(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Office mail as lists of one message and as single ones, each in both forms."""
    m = C.raw_messages(spark, folder).where("source = 'o'").withColumn("k", F.split("thread_id", ":t")[1])
    user = F.regexp_extract("sender", r"User (\d+)", 1)
    item = F.struct(
        F.substr("id", F.lit(3)).alias("id"), F.substr("thread_id", F.lit(3)).alias("conversationId"), "subject",
        person(F.when(F.expr("seq % 3 <> 0"), F.concat(F.lit("User "), user)), F.concat(F.lit("u"), user, F.lit("@x.org"))).alias("from"),
        F.array(person(F.lit("Ann"), F.lit("ann@x.org")), person(F.lit(None).cast("string"), F.lit("bob@x.org"))).alias("toRecipients"),
        F.col("date").alias("receivedDateTime"), F.concat(F.lit("pre "), F.col("seq").cast("string")).alias("bodyPreview"),
        F.struct(F.when(F.expr("seq % 4 = 0"), F.lit("")).otherwise(F.col("body")).alias("content")).alias("body"),
        F.when(F.expr("seq % 5 = 0"), F.lit(False)).alias("isRead"))
    one = F.to_json(item)
    lists = m.select("source", "seq", F.when(F.expr("seq % 2 = 0"), F.concat(F.lit('{"value":['), one, F.lit("]}"))).otherwise(
        F.concat(F.lit("["), one, F.lit("]"))).alias("payload"))
    singles = m.select("source", "seq", F.when(F.expr("seq % 2 = 0"), F.concat(F.lit('{"value":'), one, F.lit("}"))).otherwise(one).alias("payload"))
    return lists, singles


@query("chat_messages", """
SELECT 'w:' || event_id AS id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') AS date,
  CASE event_id % 4 WHEN 0 THEN 'Name ' || user_id WHEN 1 THEN CASE WHEN user_id % 2 = 0 THEN 'alias' || user_id ELSE 'Chat ' || user_id END
    WHEN 2 THEN CASE WHEN user_id % 2 = 0 THEN 'alias' || user_id ELSE user_id || '@s.whatsapp.net' END ELSE user_id || '@g.us' END AS sender,
  CASE WHEN event_id % 4 = 2 THEN '' ELSE 'Chat ' || user_id END AS subject, event_type AS body FROM events""")
def chat_messages(spark, folder):
    """Chat lines: objects, arrays, blank and broken lines; missing names filled in."""
    e = C.table(spark, folder, "events")
    jid = F.concat(F.col("user_id").cast("string"), F.when(F.expr("event_id % 4 = 3"), F.lit("@g.us")).otherwise("@s.whatsapp.net"))
    line = F.to_json(F.struct(
        F.col("event_id").cast("string").alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), jid.alias("sender_jid"),
        F.when(F.expr("event_id % 4 = 0"), F.concat(F.lit("Name "), F.col("user_id").cast("string"))).alias("sender_name"),
        F.when(F.expr("event_id % 4 <> 2"), F.concat(F.lit("Chat "), F.col("user_id").cast("string"))).alias("chat_name"), F.col("event_type").alias("content")))
    text = F.when(F.expr("event_id % 2 = 0"), F.concat(F.lit("\n  "), line, F.lit("\n{broken"))).otherwise(F.concat(F.lit("["), line, F.lit("]\n\n")))
    raw = e.select(F.lit("w").alias("source"), F.col("event_id").alias("seq"), text.alias("payload"))
    known = e.where("user_id % 2 = 0").selectExpr(
        "concat('alias', user_id) AS alias", "concat('w:', user_id, '@s.whatsapp.net') AS identifier", "1 AS ord").distinct()
    return chat.messages(raw, known).select("id", "date", "sender", "subject", "body")


@query("chat_list", """
SELECT 'w:' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN '@g.us' ELSE '@s.whatsapp.net' END AS id,
  CASE WHEN c_custkey % 4 = 0 THEN c_custkey || CASE WHEN c_custkey % 3 = 0 THEN '@g.us' ELSE '@s.whatsapp.net' END ELSE c_name END AS subject, c_custkey % 3 = 0 AS is_group FROM customer""")
def chat_list(spark, folder):
    c = C.table(spark, folder, "customer")
    jid = F.concat(F.col("c_custkey").cast("string"), F.when(F.expr("c_custkey % 3 = 0"), F.lit("@g.us")).otherwise("@s.whatsapp.net"))
    line = F.to_json(F.struct(jid.alias("jid"), F.when(F.expr("c_custkey % 4 <> 0"), F.col("c_name")).alias("name")))
    return chat.chats(c.select(F.lit("w").alias("source"), F.col("c_custkey").alias("seq"), line.alias("payload"))).select("id", "subject", "is_group")


@query("chat_contexts", """
SELECT 'w:' || conv_id AS thread_id, 'w:' || conv_id || '-' || turn || CASE WHEN k < 0 THEN 'b' || -k WHEN k > 0 THEN 'a' || k ELSE '' END AS id,
  row_number() OVER (PARTITION BY conv_id, turn ORDER BY k) AS idx FROM conversations, range(-3, 3) r(k) WHERE k >= -least(turn, 3)""")
def chat_contexts(spark, folder):
    """A context payload around every turn: what came before is listed newest first."""
    base = F.concat("conv_id", F.lit("-"), "turn")

    def item(tail):
        return F.struct(F.concat(base, tail).alias("id"), F.col("role").alias("sender_name"), F.col("conv_id").cast("string").alias("chat_jid"))

    some = F.least(F.col("turn"), F.lit(3)).cast("int")
    before = F.transform(F.slice(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(1), some), lambda i: item(F.concat(F.lit("b"), i.cast("string"))))
    after = F.transform(F.array(F.lit(1), F.lit(2)), lambda i: item(F.concat(F.lit("a"), i.cast("string"))))
    payload = F.to_json(F.struct(item(F.lit("")).alias("message"), before.alias("before"), after.alias("after")))
    raw = C.table(spark, folder, "conversations").select(
        F.lit("w").alias("source"), (F.col("conv_id") * 100000 + F.col("turn")).alias("seq"), payload.alias("payload"))
    return chat.contexts(raw).select("thread_id", "id", F.col("idx").cast("bigint").alias("idx"))


KIND = """CASE event_id % 6 WHEN 0 THEN 'Release' WHEN 1 THEN 'CheckSuite' WHEN 2 THEN 'PullRequest' WHEN 3 THEN 'RepositoryVulnerabilityAlert' ELSE 'Issue' END"""
TITLE = "CASE WHEN event_id % 4 = 2 THEN 'Bump lib from 1.' || user_id || ' to 2.0' ELSE 'Work on ' || event_type END"
REASON = "CASE user_id % 6 WHEN 0 THEN 'ci_activity' WHEN 1 THEN 'review_requested' WHEN 2 THEN 'team_mention' WHEN 3 THEN 'subscribed' WHEN 4 THEN '' ELSE 'assign' END"
CATEGORY = f"""CASE WHEN event_id % 6 = 0 THEN 'release' WHEN event_id % 6 = 1 THEN 'ci' WHEN event_id % 6 = 3 THEN 'dependabot'
  WHEN event_id % 6 = 2 AND event_id % 4 = 2 THEN 'dependabot' ELSE CASE user_id % 6 WHEN 0 THEN 'ci' WHEN 1 THEN 'review' WHEN 2 THEN 'mention' WHEN 3 THEN 'subscribed' WHEN 4 THEN 'other' ELSE 'assignment' END END"""


def notification_raw(spark, folder) -> DataFrame:
    url = """concat('https://api.example.com/repos/o', user_id % 3, '/r', user_id, CASE event_id % 3 WHEN 0 THEN '/issues/' WHEN 1 THEN '/pulls/' ELSE '/commits/' END, event_id)"""
    return spread(C.table(spark, folder, "events")).selectExpr(
        "'gh' AS source", "'github' AS provider", "event_id AS seq", f"""to_json(named_struct('id', CAST(event_id AS STRING), 'unread', event_id % 2 = 0, 'reason', {REASON},
            'updated_at', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), 'subject', named_struct('title', {TITLE}, 'url', {url}, 'type', {KIND}),
            'repository', named_struct('full_name', concat('o', user_id % 3, '/r', user_id)))) AS payload""")


NOTIFIED = f"""SELECT 'gh:' || event_id AS id, CASE WHEN event_id % 3 = 2 THEN '' ELSE 'gh:o' || (user_id % 3) || '/r' || user_id || '#' || event_id END AS thread_id,
  'o' || (user_id % 3) || '/r' || user_id AS sender, '[' || {CATEGORY} || '] ' || {TITLE} AS subject, {CATEGORY} AS category,
  strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS date, event_id % 2 = 0 AS unread FROM events"""


@query("classify_events", f"SELECT {CATEGORY} AS category, count(*) AS n FROM events GROUP BY ALL")
def classify_events(spark, folder):
    """Notifications per category."""
    return tracker.notifications(notification_raw(spark, folder)).groupBy("category").agg(F.count("*").alias("n"))


@query("tracker_notifications", NOTIFIED)
def tracker_notifications(spark, folder):
    return tracker.notifications(notification_raw(spark, folder)).drop("source", "seq")


@query("tracker_unread", f"SELECT id, subject FROM ({NOTIFIED}) WHERE unread AND contains(lower(subject), 'click')")
def tracker_unread(spark, folder):
    """Only unread notifications, searched by subject."""
    from letterloom.operators.filters import subject_contains
    return tracker.notifications(notification_raw(spark, folder), unread_only=True).where(subject_contains("CLICK")).select("id", "subject")


@query("tracker_ids", """
SELECT l_orderkey, l_linenumber, CASE k WHEN 0 THEN 'notification' WHEN 1 THEN 'issue' WHEN 2 THEN 'comment' WHEN 3 THEN 'review_comment' WHEN 4 THEN 'review' END AS kind,
  CASE WHEN k BETWEEN 1 AND 4 THEN 'own' WHEN k = 0 THEN '' END AS owner, CASE WHEN k = 4 THEN CAST(l_linenumber AS VARCHAR) WHEN k < 4 THEN '' END AS pull, CASE WHEN k < 5 THEN CAST(l_orderkey AS VARCHAR) END AS number FROM (SELECT *, (l_orderkey + l_linenumber) % 6 AS k FROM lineitem)""")
def tracker_ids(spark, folder):
    """Kinds of ids; those of no kind are rejects."""
    ids = C.table(spark, folder, "lineitem").selectExpr("l_orderkey", "l_linenumber", """concat(CASE (l_orderkey + l_linenumber) % 6 WHEN 0 THEN '' WHEN 1 THEN 'own/rep#'
        WHEN 2 THEN 'own/rep/comments/' WHEN 3 THEN 'own/rep/pull-comments/' WHEN 4 THEN concat('own/rep/pulls/', l_linenumber, '/reviews/') ELSE 'own/' END, l_orderkey) AS id""")
    return tracker.classify_ids(ids).select("l_orderkey", "l_linenumber", "kind", "owner", "pull", "number")


def _discussion(spark, folder) -> dict[str, DataFrame]:
    """Orders as issues (every third a pull request), line items as replies of three kinds."""
    ref = "concat('own/rep', o_custkey % 7, '#', o_orderkey)"
    stamp = "date_format({}, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
    heads = C.table(spark, folder, "orders").selectExpr(
        "'gh' AS source", "o_orderkey AS seq", f"{ref} AS ref", f"""concat('{{', if(o_orderkey % 3 = 0, '"pull_request":{{"url":"u"}},', ''), substring(to_json(named_struct(
            'title', o_orderpriority, 'user', named_struct('login', concat('c', o_custkey)), 'created_at', {stamp.format('o_orderdate')}, 'state', 'open')), 2)) AS payload""")
    items = C.table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min(F.struct("l_partkey", "l_suppkey", "l_shipdate")).alias("i")).select("l_orderkey", "l_linenumber", "i.*").join(
        C.table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    reply = items.selectExpr(
        "'gh' AS source", "l_linenumber AS n", "CAST(l_linenumber AS BIGINT) AS seq", f"{ref} AS ref", f"""to_json(named_struct('id', CAST(l_linenumber AS STRING), 'user', named_struct('login', concat('s', l_suppkey)),
            'body', concat('part ', l_partkey), 'created_at', {stamp.format('l_shipdate')}, 'submitted_at', {stamp.format('l_shipdate')},
            'state', CASE l_partkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' ELSE '' END)) AS payload""")
    return {"heads": tracker.issues(heads), "comments": tracker.comments(reply.where("n % 3 = 0")),
            "reviews": tracker.reviews(reply.where("n % 3 = 1")), "inline": tracker.comments(reply.where("n % 3 = 2"), "pull-comments")}


@query("thread_union", """
WITH item AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate) AS rn FROM lineitem) JOIN orders ON o_orderkey = l_orderkey WHERE rn = 1),
head AS (SELECT o_orderkey, 'own/rep' || (o_custkey % 7) || '#' || o_orderkey AS ref, o_orderkey % 3 = 0 AS pull FROM orders),
rep AS (SELECT h.o_orderkey, ref, pull, l_linenumber AS n, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') AS date,
  CASE WHEN l_linenumber % 3 = 1 AND l_partkey % 3 = 1 THEN '[APPROVED] ' ELSE '' END || 'part ' || l_partkey AS body,
  'gh:' || split_part(ref, '#', 1) || CASE l_linenumber % 3 WHEN 0 THEN '/comments/' WHEN 1 THEN '/pulls/' || h.o_orderkey || '/reviews/' ELSE '/pull-comments/' END || l_linenumber AS id
  FROM item JOIN head h ON h.o_orderkey = l_orderkey WHERE l_linenumber % 3 = 0 OR (pull AND NOT (l_linenumber % 3 = 1 AND l_partkey % 3 = 0)))
SELECT 'gh:' || ref AS thread_id, 'gh:' || ref AS id, '' AS body, CAST(1 AS BIGINT) AS idx FROM head
UNION ALL SELECT 'gh:' || ref, id, body, 1 + row_number() OVER (PARTITION BY ref ORDER BY CASE WHEN pull THEN date ELSE '' END, n, id) FROM rep""")
def thread_union(spark, folder):
    """Discussions put together from issues, comments, reviews and inline comments."""
    from letterloom.operators import threads
    d = _discussion(spark, folder)
    whole = threads.assemble(d["heads"], d["comments"], d["reviews"], d["inline"])
    return whole.select("thread_id", "id", "body", F.col("idx").cast("bigint").alias("idx"))


@query("search_hits", """
SELECT 'gh:own/rep#' || o_orderkey AS id, o_orderpriority AS subject, strftime(o_orderdate, '%Y-%m-%d') AS date, substr(repeat(o_orderpriority || ' ', 30), 1, 200) AS snippet,
  o_orderkey % 3 = 0 AS is_pull_request FROM orders WHERE o_orderkey % 5 <> 4""")
def search_hits(spark, folder):
    """Search hits; a hit that names no repository is dropped."""
    raw = C.table(spark, folder, "orders").selectExpr("'gh' AS source", "o_orderkey AS seq", """concat('{', if(o_orderkey % 3 = 0, '"pull_request":{},', ''), substring(to_json(named_struct(
        'url', if(o_orderkey % 2 = 0 AND o_orderkey % 5 <> 4, concat('https://api.example.com/repos/own/rep/issues/', o_orderkey), 'https://api.example.com/x'),
        'repository_url', if(o_orderkey % 5 = 4, 'none', 'https://api.example.com/repos/own/rep/'), 'number', o_orderkey, 'title', o_orderpriority, 'body', repeat(concat(o_orderpriority, ' '), 30),
        'updated_at', if(o_orderkey % 7 = 0, '', date_format(o_orderdate, 'yyyy-MM-dd')), 'created_at', date_format(o_orderdate, 'yyyy-MM-dd'))), 2)) AS payload""")
    return tracker.search_hits(raw).select("id", "subject", "date", "snippet", "is_pull_request")


NOTICES = """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'h:n' || event_id ELSE 'h:' || substr(sha256(event_type || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '|user ' || user_id || '|' || CASE WHEN event_id % 2 = 0 THEN 'http://x/' || event_id ELSE '' END), 1, 12) END AS id,
  event_type AS sender, event_type || ': user ' || user_id AS subject, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS date,
  event_type || ': user ' || user_id || CASE WHEN event_id % 2 = 0 THEN E'\\n\\nhttp://x/' || event_id ELSE '' END AS body FROM events"""


def notice_raw(spark, folder) -> DataFrame:
    return spread(C.table(spark, folder, "events")).selectExpr("'h' AS source", "'http' AS provider", "event_id AS seq", "ts AS polled_at", """to_json(named_struct('notifications', array(named_struct(
        'id', if(event_id % 3 = 0, concat('n', event_id), NULL), 'date', date_format(ts, 'yyyy-MM-dd HH:mm:ss'), 'source', event_type, 'subject', concat('user ', user_id),
        'link', if(event_id % 2 = 0, concat('http://x/', event_id), NULL))), 'meters', array(named_struct('label', event_type, 'count', event_id)))) AS payload""")


@query("synth_id", NOTICES.replace("SELECT event_id, ", "SELECT "))
def synth_id(spark, folder):
    """Generic notices; those without an id get one from their content."""
    return notices.notifications(notice_raw(spark, folder)).select("id", "sender", "subject", "date", "body")


@query("meter_snapshots", """
SELECT 'h' AS source, event_type || '=' || event_id AS meters FROM events ORDER BY ts DESC, event_id DESC LIMIT 1""")
def meter_snapshots(spark, folder):
    """The last meters of every source."""
    from letterloom.operators.lookups import live_meters
    polls = notices.meters(notice_raw(spark, folder))
    listed = F.array_join(F.transform("meters", lambda m: F.concat(m["label"], F.lit("="), m["count"].cast("string"))), ",")
    return live_meters(polls, C.sources(spark)).select("source", listed.alias("meters"))


def chat_raw(spark, folder) -> DataFrame:
    """Chat lines, one a payload, with a blank and a broken line."""
    return spread(C.table(spark, folder, "events")).selectExpr("'w' AS source", "'whatsapp' AS provider", "event_id AS seq", """concat('\n', to_json(named_struct(
        'id', CAST(event_id AS STRING), 'timestamp', date_format(ts, 'yyyy-MM-dd HH:mm:ss'), 'sender_jid', concat(user_id, '@s.whatsapp.net'), 'content', event_type)), '\n{broken') AS payload""")


def mixed_raw(spark, folder) -> DataFrame:
    """Payloads of five providers, some broken, and some of a provider that nobody knows."""
    mail = gmail_raw(spark, folder)
    raw = mail.unionByName(notification_raw(spark, folder)).unionByName(notice_raw(spark, folder).drop("polled_at"))
    raw = raw.unionByName(graph_raw(spark, folder)[1].withColumn("provider", F.lit("o365"))).unionByName(chat_raw(spark, folder))
    bad = mail.where("seq % 10 = 0").withColumn("payload", F.expr("if(seq % 4 = 0, '{broken', NULL)"))
    return raw.unionByName(bad).unionByName(mail.where("seq % 10 = 2").withColumn("provider", F.expr("if(seq % 4 = 0, 'pigeon', NULL)")))


@query("landed_messages", with_views(MSG) + f"""
SELECT 'gmail' AS provider, count(*) AS messages, min(date) AS first, max(date) AS last FROM msg WHERE source = 'g'
UNION ALL SELECT 'github', count(*), min(date), max(date) FROM ({NOTIFIED}) UNION ALL SELECT 'http', count(*), min(date), max(date) FROM ({NOTICES})
UNION ALL SELECT 'o365', count(*), min(date), max(date) FROM msg WHERE source = 'o'
UNION ALL SELECT 'whatsapp', count(*), strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ'), strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') FROM events""")
def landed_messages(spark, folder):
    """Payloads of five providers as one table of messages; broken and unknown ones make no rows."""
    return landing.land(mixed_raw(spark, folder)).groupBy("provider").agg(
        F.count("*").alias("messages"), F.min("date").alias("first"), F.max("date").alias("last"))


@query("landing_rejects", with_views(MSG) + """
SELECT 'gmail' AS provider, 'payload is not JSON' AS error, count(*) AS payloads FROM msg WHERE source = 'g' AND seq % 10 = 0 HAVING count(*) > 0
UNION ALL SELECT CASE WHEN seq % 4 = 0 THEN 'pigeon' END, 'unknown provider', count(*) FROM msg WHERE source = 'g' AND seq % 10 = 2 GROUP BY 1""")
def landing_rejects(spark, folder):
    """What landing leaves out, by provider and reason."""
    return landing.rejects(mixed_raw(spark, folder)).groupBy("provider", "error").agg(F.count("*").alias("payloads"))


@query("landed_events", """
SELECT 'gcal' AS provider, count(*) AS events, count(*) FILTER (event_type = 'signup') AS all_day FROM events
UNION ALL SELECT 'o365cal', count(*), count(*) FILTER (event_type = 'signup') FROM events
UNION ALL SELECT 'caldav', count(*), count(*) FILTER (event_type = 'signup') FROM events""")
def landed_events(spark, folder):
    """Events of three calendar forms as one table, with broken payloads among them."""
    raw = google_raw(spark, folder).withColumn("provider", F.lit("gcal"))
    raw = raw.unionByName(office_raw(spark, folder).withColumn("provider", F.lit("o365cal")), allowMissingColumns=True)
    raw = raw.unionByName(ical_raw(spark, folder).withColumn("provider", F.lit("caldav")), allowMissingColumns=True)
    raw = raw.unionByName(raw.where("provider = 'gcal' AND seq % 10 = 0").withColumn("payload", F.lit("{")))
    return landing.land_events(raw).groupBy("provider").agg(F.count("*").alias("events"), F.count_if("all_day").alias("all_day"))


@query("source_failures", """
SELECT 'r' || (o_custkey % 5) AS source, count(*) AS payloads, count(*) FILTER (o_custkey % 5 = 3 OR o_orderkey % 10 = 0) AS failed,
  count(*) = count(*) FILTER (o_custkey % 5 = 3 OR o_orderkey % 10 = 0) AS all_failed FROM orders GROUP BY ALL""")
def source_failures(spark, folder):
    """Broken payloads per source; the others still come through."""
    raw = C.table(spark, folder, "orders").selectExpr("concat('r', o_custkey % 5) AS source", "o_orderkey AS seq",
                                                      "if(o_custkey % 5 = 3 OR o_orderkey % 10 = 0, '{broken', '{\"a\":1}') AS payload")
    return landing.failures(raw, landing.split_malformed(raw)[1])


# Calendars

@query("google_events", """
SELECT 'gc:' || event_id AS id, CASE WHEN event_type = 'view' THEN '(No title)' ELSE event_type END AS title, event_type = 'signup' AS all_day,
  CASE WHEN event_type = 'signup' THEN strftime(ts, '%Y-%m-%d') WHEN event_id % 3 = 0 THEN strftime(t - INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S+00:00') WHEN event_id % 3 = 1 THEN strftime(t - INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%S+00:00')
    ELSE strftime(t, '%Y-%m-%dT%H:%M:%S+00:00') END AS start, CASE WHEN event_type <> 'signup' THEN CAST(45 AS BIGINT) END AS duration_minutes,
  CASE WHEN event_id % 2 = 0 THEN '2 people' ELSE '' END AS attendees_summary, CASE WHEN event_id % 2 = 0 THEN 'accepted' END AS your_status,
  CASE WHEN event_id % 2 = 0 THEN 'Ann:declined,me@x.org:accepted' ELSE '' END AS attendees, CASE WHEN event_id % 4 = 0 THEN 'http://v/' || event_id ELSE '' END AS meeting_link,
  CASE WHEN event_id % 5 = 0 THEN 'weekly on Mon+Wed' ELSE '' END AS recurrence_summary
FROM (SELECT *, date_trunc('second', ts) AS t FROM events)""")
def google_events(spark, folder):
    """Events with offsets, own zones and the zone of their source; attendees, links and rules."""
    who = F.array_join(F.transform("attendees", lambda a: F.concat(a["name"], F.lit(":"), a["status"])), ",")
    return calendars.google_events(google_raw(spark, folder), detail=True).select(
        "id", "title", "all_day", "start", "duration_minutes", "attendees_summary", "your_status", F.coalesce(who, F.lit("")).alias("attendees"), "meeting_link", "recurrence_summary")


def google_raw(spark, folder) -> DataFrame:
    return C.table(spark, folder, "events").selectExpr("'gc' AS source", "event_id AS seq", "'Asia/Tokyo' AS timezone", """concat('{', if(event_type = 'view', '', concat('"summary":"', event_type, '",')), substring(to_json(named_struct('id', CAST(event_id AS STRING),
        'start', named_struct('date', if(event_type = 'signup', date_format(ts, 'yyyy-MM-dd'), NULL), 'dateTime', if(event_type = 'signup', NULL, concat(date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), if(event_id % 3 = 2, 'Z', ''))), 'timeZone', if(event_id % 3 = 1, 'Europe/Amsterdam', NULL)),
        'end', named_struct('date', if(event_type = 'signup', date_format(ts, 'yyyy-MM-dd'), NULL), 'dateTime', if(event_type = 'signup', NULL, concat(date_format(CAST(ts AS TIMESTAMP) + interval 45 minutes, "yyyy-MM-dd'T'HH:mm:ss"), if(event_id % 3 = 2, 'Z', ''))), 'timeZone', if(event_id % 3 = 1, 'Europe/Amsterdam', NULL)),
        'attendees', if(event_id % 2 = 0, array(named_struct('email', 'ann@x.org', 'displayName', 'Ann', 'self', false, 'responseStatus', 'declined'), named_struct('email', 'me@x.org', 'displayName', NULL, 'self', true, 'responseStatus', 'accepted')), NULL),
        'conferenceData', if(event_id % 4 = 0, named_struct('entryPoints', array(named_struct('entryPointType', 'phone', 'uri', 'tel:1'), named_struct('entryPointType', 'video', 'uri', concat('http://v/', event_id)))), NULL),
        'recurrence', if(event_id % 5 = 0, array('EXDATE:1', 'RRULE:FREQ=WEEKLY;BYDAY=MO,WE'), NULL))), 2)) AS payload""")


@query("graph_events", """
SELECT 'oc:' || event_id AS id, event_type = 'signup' AS all_day, CASE WHEN event_type = 'signup' THEN strftime(ts, '%Y-%m-%d') WHEN event_id % 2 = 0 THEN strftime(t - INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S+00:00')
  ELSE strftime(t, '%Y-%m-%dT%H:%M:%S+00:00') END AS start, CASE WHEN user_id % 2 = 0 THEN 'cancelled' ELSE 'confirmed' END AS status, CASE user_id % 3 WHEN 2 THEN 'accepted' END AS your_status,
  CASE WHEN event_id % 3 = 0 THEN 'oc:m' || user_id END AS recurring_event_id, CASE WHEN event_id % 3 = 0 THEN 'every 2 weekly on Mon' ELSE '' END AS recurrence_summary FROM (SELECT *, date_trunc('second', ts) AS t FROM events)""")
def graph_events(spark, folder):
    return calendars.graph_events(office_raw(spark, folder), detail=True).select("id", "all_day", "start", "status", "your_status", "recurring_event_id", "recurrence_summary")


def office_raw(spark, folder) -> DataFrame:
    return C.table(spark, folder, "events").selectExpr("'oc' AS source", "event_id AS seq", """to_json(named_struct('id', CAST(event_id AS STRING), 'subject', event_type, 'isAllDay', event_type = 'signup', 'isCancelled', user_id % 2 = 0,
        'start', named_struct('dateTime', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'.0000000'"), 'timeZone', if(event_id % 2 = 0, 'Asia/Tokyo', 'UTC')), 'end', named_struct('dateTime', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'.0000000'"), 'timeZone', 'UTC'),
        'responseStatus', named_struct('response', CASE user_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'organizer' ELSE 'accepted' END), 'seriesMasterId', if(event_id % 3 = 0, concat('m', user_id), NULL),
        'recurrence', if(event_id % 3 = 0, named_struct('pattern', named_struct('type', 'weekly', 'interval', 2, 'daysOfWeek', array('monday'))), NULL))) AS payload""")


@query("ical_events", """
SELECT 'cc:' || event_id || CASE WHEN event_id % 4 = 0 THEN '::' || strftime(t, '%Y-%m-%dT%H:%M:%S+00:00') ELSE '' END AS id, 'Talk, ' || event_type || E'\\nlong' AS title, event_type = 'signup' AS all_day,
  CASE WHEN event_type = 'signup' THEN strftime(ts, '%Y-%m-%d') WHEN event_id % 3 = 0 THEN strftime(t - INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S+00:00') ELSE strftime(t, '%Y-%m-%dT%H:%M:%S+00:00') END AS start,
  CASE WHEN event_type <> 'signup' THEN CAST(90 AS BIGINT) END AS duration_minutes, CASE WHEN user_id % 2 = 0 THEN 'tentative' ELSE 'needsAction' END AS your_status, '2 people' AS attendees_summary, 'boss@x.org' AS organizer
FROM (SELECT *, date_trunc('second', ts) AS t FROM events)""")
def ical_events(spark, folder):
    """iCalendar text: folded lines, escapes, zones, durations, instances and nested alarms."""
    return calendars.ical_events(ical_raw(spark, folder)).select("id", "title", "all_day", "start", "duration_minutes", "your_status", "attendees_summary", "organizer")


def ical_raw(spark, folder) -> DataFrame:
    e = C.table(spark, folder, "events").selectExpr("*", "date_format(ts, \"yyyyMMdd'T'HHmmss\") AS c")
    start = F.expr("CASE WHEN event_type = 'signup' THEN concat('DTSTART;VALUE=DATE:', substring(c, 1, 8)) WHEN event_id % 3 = 0 THEN concat('DTSTART;TZID=Asia/Tokyo:', c) WHEN event_id % 3 = 1 THEN concat('DTSTART:', c, 'Z') ELSE concat('DTSTART:', c) END")
    text = F.concat_ws("\r\n", F.lit("BEGIN:VCALENDAR\r\nBEGIN:VEVENT"), F.concat(F.lit("UID:"), "event_id"), start,
                       F.when(F.col("event_type") != "signup", F.lit("DURATION:PT1H30M")),
                       F.concat(F.lit("SUMMARY;LANGUAGE=en:Talk\\, "), "event_type", F.lit("\\nlo\r\n ng")),
                       F.lit('ORGANIZER;CN="Big: Boss":mailto:boss@x.org'), F.lit("ATTENDEE;CN=Ann;PARTSTAT=ACCEPTED:mailto:ann@x.org"),
                       F.when(F.expr("user_id % 2 = 0"), F.lit("ATTENDEE;PARTSTAT=TENTATIVE:MAILTO:Me@x.org")).otherwise("ATTENDEE:mailto:me@x.org"),
                       F.when(F.expr("event_id % 4 = 0"), F.concat(F.lit("RECURRENCE-ID:"), "c", F.lit("Z"))),
                       F.lit("BEGIN:VALARM\r\nDESCRIPTION:ring\r\nDURATION:PT9M\r\nSUMMARY:no\r\nEND:VALARM\r\nEND:VEVENT\r\nEND:VCALENDAR"))
    return e.select(F.lit("cc").alias("source"), F.col("event_id").alias("seq"), F.lit("UTC").alias("timezone"), F.lit("me@x.org").alias("owner"), text.alias("payload"))


@query("usable_calendars", """
SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 <> 1 AND s_suppkey % 3 <> 1""")
def usable_calendars(spark, folder):
    from letterloom.operators.agenda import usable_calendars as usable
    found = C.table(spark, folder, "supplier").selectExpr(
        "s_suppkey", "if(s_suppkey % 4 = 1, 'freeBusyReader', 'reader') AS access_role",
        "CASE s_suppkey % 3 WHEN 0 THEN array('VEVENT', 'VTODO') WHEN 1 THEN array('VTODO') END AS components")
    return usable(found).select("s_suppkey")


@query("vcards", """
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Full; Name ' || c_custkey WHEN 1 THEN 'Dr. Ann Mid Doe;S Jr.' WHEN 2 THEN c_name ELSE '' END AS display_name,
  '+31 ' || c_custkey || '|010' AS phones, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'Me@x.org' || '|o' || c_custkey || '@y.org' END AS emails FROM customer""")
def vcards(spark, folder):
    """Address-book text: folded lines, groups, parameters, escapes, names without FN."""
    c = C.table(spark, folder, "customer")
    k = F.col("c_custkey").cast("string")
    name = (F.when(F.expr("c_custkey % 4 = 0"), F.concat(F.lit("FN:Full\\; Na\r\n me "), k, F.lit("\r\nN:Other;Name;;;")))
            .when(F.expr("c_custkey % 4 = 1"), F.lit("N;CHARSET=UTF-8:Doe\\;S;Ann;Mid;Dr.;Jr."))
            .when(F.expr("c_custkey % 4 = 2"), F.concat(F.lit("item1.fn:"), "c_name")).otherwise("N:;;;;"))
    mail = F.when(F.expr("c_custkey % 3 <> 0"), F.concat(F.lit("EMAIL;type=HOME:Me@X.org\r\nemail:o"), k, F.lit("@Y.ORG\r\nEMAIL:Me@x.ORG")))
    text = F.concat_ws("\r\n", F.lit("TEL:000\r\nBEGIN:VCARD\r\nVERSION:3.0"), name, F.concat(F.lit("item2.TEL;type=CELL:+31 "), k, F.lit("\r\nTEL:010\r\nTEL;x=y:010\r\nTEL:")), mail, F.lit("END:VCARD\r\nTEL:999"))
    found = cards.parse_cards(c.select(F.col("c_custkey").alias("seq"), text.alias("payload")))
    return found.select(F.col("seq").alias("c_custkey"), "display_name", F.array_join("phones", "|").alias("phones"), F.array_join("emails", "|").alias("emails"))


@query("listing_providers", with_views(MSG) + f"""
, n AS (SELECT date, sender FROM ({NOTIFIED})),
seen AS (SELECT 'mail' AS kind, date, sender FROM msg UNION ALL SELECT 'github', date, sender FROM n)
SELECT 'all' AS scan, kind, count(*) AS n, max(date) AS newest FROM seen GROUP BY ALL
UNION ALL SELECT 'sender', kind, count(*), max(date) FROM seen WHERE contains(lower(sender), '1') AND kind = 'mail' GROUP BY ALL""")
def listing_providers(spark, folder):
    """Calendars and contacts are in no message scan, notifications in none that asks for a sender."""
    from letterloom.operators import filters
    mail = C.messages(spark, folder).select("provider", "date", "sender", F.lit("mail").alias("kind"))
    notes = tracker.notifications(notification_raw(spark, folder)).select(F.lit("github").alias("provider"), "date", "sender", F.lit("github").alias("kind"))
    events = C.events(spark, folder).select(F.lit("gcal").alias("provider"), F.col("start").alias("date"), F.col("organizer").alias("sender"), F.lit("event").alias("kind"))
    people = C.contacts(spark, folder).select(F.lit("carddav").alias("provider"), F.lit("2001").alias("date"), F.col("alias").alias("sender"), F.lit("contact").alias("kind"))
    rows = mail.unionByName(notes).unionByName(events).unionByName(people)
    counted = lambda df, scan: df.groupBy("kind").agg(F.count("*").alias("n"), F.max("date").alias("newest")).select(F.lit(scan).alias("scan"), "*")
    return counted(filters.listing(rows, now=C.NOW), "all").unionByName(counted(filters.listing(rows, now=C.NOW, sender="1"), "sender"))
