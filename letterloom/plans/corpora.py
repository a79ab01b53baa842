"""The given tables seen as messages, chats, bodies, pages, events and contacts.

``orders`` with ``customer`` are mail and chat headers, ``conversations`` chat transcripts,
``documents`` plain bodies, ``pages`` HTML bodies, ``events`` a calendar, ``customer`` an
address book. What the tables lack, such as signatures or reply marks, is added by key, so
that every rule has rows to act on. The SQL of the same views is in ``sql_views``.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.functions.headers import clean_headers
from letterloom.schema import SOURCES, struct

# Relative bounds count from here; the orders end shortly before.
NOW = datetime(2001, 8, 2, tzinfo=timezone.utc)

SOURCE_ROWS = [
    ("g", "gmail", "me@example.com", None, None, None, "Europe/Amsterdam", "modify", 1),
    ("o", "o365", "me@example.com", None, "app", None, "UTC", "readonly", 2),
    ("w", "whatsapp", None, None, None, None, None, "modify", 3),
    ("gw", "gmail", "work@example.com", None, None, None, None, "draft", 4),
    ("h", "http", None, None, None, None, None, None, 5),
    ("gc", "gcal", "me@example.com", None, None, None, "Asia/Tokyo", "send", 6),
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def constant(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A few rows of configuration as an inline table, whose size the optimiser knows."""
    fields = struct(ddl).fields
    cells = F.array(*[
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields)]) for row in rows])
    return spark.range(1).select(F.inline(cells))


def sources(spark: SparkSession) -> DataFrame:
    return constant(spark, SOURCE_ROWS, SOURCES)


def raw_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Messages as a provider would deliver them, before their headers are cleaned."""
    orders, customers = table(spark, folder, "orders"), table(spark, folder, "customer")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).selectExpr(
        "*", "CASE o_orderstatus WHEN 'F' THEN 'g' WHEN 'O' THEN 'o' ELSE 'w' END AS source",
        "concat('P ', o_orderpriority, ' #', o_custkey % 50) AS plain",
    ).selectExpr(
        "concat(source, ':m', o_orderkey) AS id",
        "source",
        "CASE source WHEN 'g' THEN 'gmail' WHEN 'o' THEN 'o365' ELSE 'whatsapp' END AS provider",
        "CASE source WHEN 'g' THEN 1 WHEN 'o' THEN 2 ELSE 3 END AS source_ord",
        "CASE WHEN source <> 'w' AND o_orderkey % 10 <> 0 THEN concat(source, ':t', o_custkey) END AS thread_id",
        "CASE WHEN source = 'w' THEN concat(o_custkey, if(o_custkey % 4 = 0, '@g.us', '@s.whatsapp.net')) END AS chat_jid",
        "source = 'w' AND o_custkey % 4 = 0 AS is_group",
        "CASE WHEN source = 'w' THEN c_name ELSE concat('User ', o_custkey, ' <u', o_custkey, '@', c_mktsegment, '.Example.COM>') END AS sender",
        "concat('Team <team', o_custkey % 20, '@EXAMPLE.org>') AS to",
        """CASE o_orderkey % 4 WHEN 0 THEN concat('Re: RE:  fw: ', plain) WHEN 1 THEN concat('Fwd: Re: ', plain)
           WHEN 2 THEN plain ELSE concat('  re:  ', plain, '  ') END AS subject""",
        "date_format(CAST(o_orderdate AS TIMESTAMP) + make_dt_interval(0, 0, 0, o_orderkey % 86400), \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS date",
        """CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN ''
           ELSE concat('Order ', o_orderkey, ' | ', o_orderpriority, '\\n', 'for ', c_name,
                       if(o_orderkey % 3 = 0, ' awaiting confirmation by the owner of the account', '')) END AS snippet""",
        "concat('Body ', o_orderkey, ' ', o_orderpriority) AS body",
        "o_orderkey % 5 = 0 AS unread",
        """filter(array(if(o_orderkey % 3 <> 0, 'INBOX', NULL), if(o_orderkey % 5 = 0, 'UNREAD', NULL),
                  if(o_orderkey % 4 = 0, 'CATEGORY_UPDATES', NULL), if(o_orderkey % 4 = 1, 'CATEGORY_SOCIAL', NULL),
                  if(o_orderkey % 97 = 0, 'TRASH', NULL)), x -> x IS NOT NULL) AS labels""",
        "CASE o_orderkey % 6 WHEN 0 THEN 'ci' WHEN 1 THEN 'mention' WHEN 2 THEN 'review' END AS category",
        """CASE WHEN source = 'g' THEN if(o_orderkey % 13 = 0, 'gmail:old@example.com', 'gmail:me@example.com')
           WHEN source = 'o' THEN if(o_orderkey % 13 = 1, 'o365:old@example.com', 'o365:me@example.com') ELSE '' END AS mailbox""",
        "if(o_orderkey % 17 = 0, 2, 3) AS _schema_version",
        "o_orderkey AS seq",
    )


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Messages with clean headers."""
    df = clean_headers(raw_messages(spark, folder), ("sender", "to", "subject", "date"))
    return df.withColumn("snippet", F.coalesce("snippet", "body"))


def contacts(spark: SparkSession, folder: str) -> DataFrame:
    """The contact map: some customers have identifiers under some sources; a few are claimed twice."""
    people = table(spark, folder, "customer").selectExpr(
        "lower(c_name) AS alias", "c_custkey AS k", "c_name",
        "concat('u', c_custkey, '@', lower(c_mktsegment), '.example.com') AS mail")
    k, alias, mail = F.col("k"), F.col("alias"), F.col("mail")

    def edge(holds, alias, prefix, value, ord_):
        return F.when(holds, F.struct(alias.alias("alias"), F.concat(F.lit(prefix), value).alias("identifier"),
                                      ord_.cast("int").alias("ord")))

    edges = F.array(
        edge(k % 3 == 0, alias, "g:", mail, F.lit(1)), edge(k % 3 == 1, alias, "gw:", mail, F.lit(1)),
        edge(k % 5 == 0, alias, "o:", mail, F.lit(2)), edge(k % 7 == 0, alias, "w:", F.col("c_name"), F.lit(3)),
        edge(k % 11 == 0, F.concat(F.lit("aa"), (k % 10).cast("string")), "g:", mail, k + 1))
    return people.select(F.inline(F.filter(edges, lambda x: x.isNotNull())))


def chat(spark: SparkSession, folder: str) -> DataFrame:
    """Chat transcripts; hours pass between turns, so a chat spans days."""
    return table(spark, folder, "conversations").selectExpr(
        "concat('w:', conv_id, '/', turn) AS id", "'w' AS source", "concat('w:', conv_id) AS thread_id",
        "concat(conv_id, '@g.us') AS chat_jid", "role AS sender", "concat('chat ', conv_id % 10) AS subject",
        "date_format(timestamp '2023-12-20 00:00:00' + make_dt_interval(0, CAST(conv_id + turn * 7 AS INT), CAST(turn AS INT)), \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS date",
        "text AS body", "turn AS seq", "false AS unread", "CAST(NULL AS STRING) AS snippet")


def bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Plain bodies with quoted replies, signatures, footers and loose white space added by key."""
    noise = (
        (r"\n\nOn Mon, 1 Jan 2024, Bob Stone wrote:\n> first\n> second\n\nrest", 0),
        (r"\n-- \nJane Roe\nExample Corp", 1),
        (r"\n\nClick here to unsubscribe from this list\nbye", 2),
        (r"   \n\n\n\n\nlast line \t ", 3),
        (r"\n> quoted\n  > quoted deeper\nafter the quote", 4),
        (r"\n\nThis message is confidential and meant for you\nplease delete", 5),
        (r"\n\n**On Tue, 2 Jan 2024, Ann Lee wrote:**\nolder text", 6),
        (r"\n\n**Kind regards,**\nAnn", 7),
        (r"\n\n-----Original Message-----\nFrom: x\nold", 8),
        (r"\nSent from my phone", 9),
    )
    cases = " ".join(f"WHEN {n} THEN '{text}'" for text, n in noise)
    return table(spark, folder, "documents").selectExpr(
        "doc_id", "lang", "source", f"concat(text, CASE doc_id % 10 {cases} END) AS body")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """HTML bodies; some get a data table, a layout table, hidden text or a tracking image."""
    return table(spark, folder, "pages").selectExpr("page_id", "url", """concat(html, CASE page_id % 5
        WHEN 0 THEN '<table><tr><th>Item</th><th>Price</th></tr><tr><td>Tea</td><td>3</td></tr><tr><td>Milk</td></tr></table>'
        WHEN 1 THEN '<table><tr><td>only</td></tr><tr><td>layout</td></tr></table>'
        WHEN 2 THEN '<div style="display:none">hidden words</div><p hidden>more hidden</p>'
        WHEN 3 THEN '<img src="https://x.example/pixel.gif" width="1" height="1"><p>See <a href="https://click.example/z">here</a></p>'
        ELSE '<p>Write to <a href="mailto:a@b.example">a@b.example</a>, see <a href="https://self.example/">https://self.example/</a> or <a href="#top">top</a></p>' END) AS html""")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """A calendar: sign-ups are all-day events, the users are recurring series."""
    return table(spark, folder, "events").selectExpr(
        "*", "date_trunc('MINUTE', CAST(ts AS TIMESTAMP)) AS t", "CAST(value AS INT) % 180 AS mins",
        "event_type = 'signup' AS all_day",
    ).selectExpr(
        "concat('c', user_id % 3, ':', event_id) AS id", "concat('c', user_id % 3) AS source",
        "concat(event_type, ' ', user_id) AS title",
        "if(all_day, date_format(t, 'yyyy-MM-dd'), date_format(t, \"yyyy-MM-dd'T'HH:mm:ss'+00:00'\")) AS start",
        """if(all_day, date_format(date_add(CAST(t AS DATE), 1 + CAST(event_id % 3 AS INT)), 'yyyy-MM-dd'),
              date_format(t + make_dt_interval(0, 0, mins), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")) AS end""",
        "all_day", "if(all_day, NULL, CAST(mins AS BIGINT)) AS duration_minutes",
        "if(event_id % 4 = 0, concat('Room ', event_id % 9), '') AS location",
        "concat('u', user_id, '@example.com') AS organizer",
        "if(event_id % 5 = 0, concat(event_id % 7 + 1, ' people'), '') AS attendees_summary",
        "'confirmed' AS status", "if(event_type = 'error', 'declined', NULL) AS your_status",
        "if(event_type = 'view', concat('c', user_id % 3, ':s', user_id), NULL) AS recurring_event_id", "event_id")
