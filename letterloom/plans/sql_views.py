"""The views of ``corpora`` in standard SQL, as the first parts of the checking queries."""

RAW_MSG = r"""
raw_msg AS (
  SELECT source || ':m' || o_orderkey AS id, source,
    CASE source WHEN 'g' THEN 'gmail' WHEN 'o' THEN 'o365' ELSE 'whatsapp' END AS provider,
    CASE source WHEN 'g' THEN 1 WHEN 'o' THEN 2 ELSE 3 END AS source_ord,
    CASE WHEN source <> 'w' AND o_orderkey % 10 <> 0 THEN source || ':t' || o_custkey END AS thread_id,
    CASE WHEN source = 'w' THEN o_custkey || CASE WHEN o_custkey % 4 = 0 THEN '@g.us' ELSE '@s.whatsapp.net' END END AS chat_jid,
    source = 'w' AND o_custkey % 4 = 0 AS is_group,
    CASE WHEN source = 'w' THEN c_name ELSE 'User ' || o_custkey || ' <u' || o_custkey || '@' || c_mktsegment || '.Example.COM>' END AS raw_sender,
    CASE WHEN source = 'w' THEN c_name ELSE 'u' || o_custkey || '@' || lower(c_mktsegment) || '.example.com' END AS sender,
    CASE o_orderkey % 4 WHEN 0 THEN 'Re: RE:  fw: ' || plain WHEN 1 THEN 'Fwd: Re: ' || plain
      WHEN 2 THEN plain ELSE '  re:  ' || plain || '  ' END AS raw_subject,
    CASE o_orderkey % 4 WHEN 0 THEN 'Re: ' || plain WHEN 1 THEN 'Fwd: ' || plain WHEN 2 THEN plain ELSE 'Re: ' || plain END AS subject,
    strftime(o_orderdate + to_seconds(o_orderkey % 86400), '%Y-%m-%dT%H:%M:%SZ') AS date,
    CASE WHEN o_orderkey % 7 = 0 THEN 'Body ' || o_orderkey || ' ' || o_orderpriority WHEN o_orderkey % 11 = 0 THEN ''
      ELSE 'Order ' || o_orderkey || ' | ' || o_orderpriority || chr(10) || 'for ' || c_name
        || CASE WHEN o_orderkey % 3 = 0 THEN ' awaiting confirmation by the owner of the account' ELSE '' END END AS snippet,
    'Body ' || o_orderkey || ' ' || o_orderpriority AS body,
    o_orderkey % 5 = 0 AS unread,
    list_filter([CASE WHEN o_orderkey % 3 <> 0 THEN 'INBOX' END, CASE WHEN o_orderkey % 5 = 0 THEN 'UNREAD' END,
      CASE WHEN o_orderkey % 4 = 0 THEN 'CATEGORY_UPDATES' END, CASE WHEN o_orderkey % 4 = 1 THEN 'CATEGORY_SOCIAL' END,
      CASE WHEN o_orderkey % 97 = 0 THEN 'TRASH' END], lambda x: x IS NOT NULL) AS labels,
    CASE o_orderkey % 6 WHEN 0 THEN 'ci' WHEN 1 THEN 'mention' WHEN 2 THEN 'review' END AS category,
    CASE WHEN source = 'g' THEN CASE WHEN o_orderkey % 13 = 0 THEN 'gmail:old@example.com' ELSE 'gmail:me@example.com' END
      WHEN source = 'o' THEN CASE WHEN o_orderkey % 13 = 1 THEN 'o365:old@example.com' ELSE 'o365:me@example.com' END ELSE '' END AS mailbox,
    CASE WHEN o_orderkey % 17 = 0 THEN 2 ELSE 3 END AS schema_version,
    o_orderkey AS seq, o_custkey AS custkey
  FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'g' WHEN 'O' THEN 'o' ELSE 'w' END AS source,
          'P ' || o_orderpriority || ' #' || (o_custkey % 50) AS plain
        FROM orders JOIN customer ON o_custkey = c_custkey)
)"""

MSG = RAW_MSG + ", msg AS (SELECT * FROM raw_msg)"

CONTACTS = r"""
contact_ids AS (
  SELECT a AS alias, identifier, ord FROM (
    SELECT lower(c_name) AS a, 'g:' || mail AS identifier, 1 AS ord FROM cust WHERE k % 3 = 0
    UNION ALL SELECT lower(c_name), 'gw:' || mail, 1 FROM cust WHERE k % 3 = 1
    UNION ALL SELECT lower(c_name), 'o:' || mail, 2 FROM cust WHERE k % 5 = 0
    UNION ALL SELECT lower(c_name), 'w:' || c_name, 3 FROM cust WHERE k % 7 = 0
    UNION ALL SELECT 'aa' || (k % 10), 'g:' || mail, k + 1 FROM cust WHERE k % 11 = 0)
)"""
CUST = r"""
cust AS (SELECT c_custkey AS k, c_name, 'u' || c_custkey || '@' || lower(c_mktsegment) || '.example.com' AS mail FROM customer)"""

CHAT = r"""
chat AS (
  SELECT 'w:' || conv_id || '/' || turn AS id, 'w' AS source, 'w:' || conv_id AS thread_id, conv_id || '@g.us' AS chat_jid,
    role AS sender, 'chat ' || (conv_id % 10) AS subject,
    strftime(TIMESTAMP '2023-12-20 00:00:00' + to_hours(conv_id + turn * 7) + to_minutes(turn), '%Y-%m-%dT%H:%M:%SZ') AS date,
    text AS body, turn AS seq
  FROM conversations
)"""

BODIES = r"""
bodies AS (
  SELECT doc_id, lang, source, text || CASE doc_id % 10
    WHEN 0 THEN E'\n\nOn Mon, 1 Jan 2024, Bob Stone wrote:\n> first\n> second\n\nrest'
    WHEN 1 THEN E'\n-- \nJane Roe\nExample Corp'
    WHEN 2 THEN E'\n\nClick here to unsubscribe from this list\nbye'
    WHEN 3 THEN E'   \n\n\n\n\nlast line \t '
    WHEN 4 THEN E'\n> quoted\n  > quoted deeper\nafter the quote'
    WHEN 5 THEN E'\n\nThis message is confidential and meant for you\nplease delete'
    WHEN 6 THEN E'\n\n**On Tue, 2 Jan 2024, Ann Lee wrote:**\nolder text'
    WHEN 7 THEN E'\n\n**Kind regards,**\nAnn'
    WHEN 8 THEN E'\n\n-----Original Message-----\nFrom: x\nold'
    ELSE E'\nSent from my phone' END AS body
  FROM documents
)"""

PAGES = r"""
page AS (
  SELECT page_id, url, html || CASE page_id % 5
    WHEN 0 THEN '<table><tr><th>Item</th><th>Price</th></tr><tr><td>Tea</td><td>3</td></tr><tr><td>Milk</td></tr></table>'
    WHEN 1 THEN '<table><tr><td>only</td></tr><tr><td>layout</td></tr></table>'
    WHEN 2 THEN '<div style="display:none">hidden words</div><p hidden>more hidden</p>'
    WHEN 3 THEN '<img src="https://x.example/pixel.gif" width="1" height="1"><p>See <a href="https://click.example/z">here</a></p>'
    ELSE '<p>Write to <a href="mailto:a@b.example">a@b.example</a>, see <a href="https://self.example/">https://self.example/</a> or <a href="#top">top</a></p>' END AS html
  FROM pages
)"""

EVENTS = r"""
cal AS (
  SELECT 'c' || (user_id % 3) || ':' || event_id AS id, 'c' || (user_id % 3) AS source,
    event_type || ' ' || user_id AS title,
    CASE WHEN all_day THEN strftime(t, '%Y-%m-%d') ELSE strftime(t, '%Y-%m-%dT%H:%M:%S+00:00') END AS start,
    CASE WHEN all_day THEN strftime(t + to_days(CAST(1 + event_id % 3 AS INT)), '%Y-%m-%d') ELSE strftime(t + to_minutes(mins), '%Y-%m-%dT%H:%M:%S+00:00') END AS "end",
    t AS start_utc, t + to_minutes(mins) AS end_utc, CAST(t AS DATE) AS first_day,
    CAST(t AS DATE) + CAST(1 + event_id % 3 AS INT) AS after_day,
    all_day, CASE WHEN NOT all_day THEN CAST(mins AS BIGINT) END AS duration_minutes,
    CASE WHEN event_id % 4 = 0 THEN 'Room ' || (event_id % 9) ELSE '' END AS location,
    'u' || user_id || '@example.com' AS organizer,
    CASE WHEN event_id % 5 = 0 THEN (event_id % 7 + 1) || ' people' ELSE '' END AS attendees_summary,
    CASE WHEN event_type = 'error' THEN 'declined' END AS your_status,
    CASE WHEN event_type = 'view' THEN 'c' || (user_id % 3) || ':s' || user_id END AS recurring_event_id, event_id
  FROM (SELECT *, date_trunc('minute', ts) AS t, CAST(trunc(value) AS INT) % 180 AS mins, event_type = 'signup' AS all_day FROM events)
)"""

SOURCES = """
sources(prefix, provider, email, mailbox, client_id, tenant_id, tz, level, ord) AS (VALUES
  ('g', 'gmail', 'me@example.com', NULL, NULL, NULL, 'Europe/Amsterdam', 'modify', 1),
  ('o', 'o365', 'me@example.com', NULL, 'app', NULL, 'UTC', 'readonly', 2),
  ('w', 'whatsapp', NULL, NULL, NULL, NULL, NULL, 'modify', 3),
  ('gw', 'gmail', 'work@example.com', NULL, NULL, NULL, NULL, 'draft', 4),
  ('h', 'http', NULL, NULL, NULL, NULL, NULL, NULL, 5),
  ('gc', 'gcal', 'me@example.com', NULL, NULL, NULL, 'Asia/Tokyo', 'send', 6))"""


def with_views(*views: str) -> str:
    return "WITH " + ",".join(views)
