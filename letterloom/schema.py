"""The tables of the corpus, as Spark DDL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ATTACHMENTS = "ARRAY<STRUCT<filename:STRING,mime_type:STRING,size:BIGINT>>"

MESSAGES = f"""
id STRING, source STRING, provider STRING, mailbox STRING, thread_id STRING, chat_jid STRING,
sender STRING, `to` STRING, cc STRING, subject STRING, date STRING, ts TIMESTAMP,
snippet STRING, body STRING, size STRING, unread BOOLEAN, is_group BOOLEAN,
is_from_me BOOLEAN, category STRING, labels ARRAY<STRING>, link STRING,
attachments {ATTACHMENTS}, seq BIGINT"""

THREAD_ROWS = """
id STRING, thread_id STRING, source STRING, subject STRING, participants STRING,
participant_count BIGINT, message_count BIGINT, first_date STRING, date STRING,
snippet STRING, unread BOOLEAN, first_seq BIGINT"""

EVENTS = """
id STRING, source STRING, title STRING, start STRING, end STRING, all_day BOOLEAN,
duration_minutes BIGINT, location STRING, organizer STRING, attendees_summary STRING,
status STRING, your_status STRING, recurring_event_id STRING"""

EVENT_DETAILS = EVENTS + """,
attendees ARRAY<STRUCT<name:STRING,email:STRING,status:STRING>>, description STRING,
meeting_link STRING, recurrence STRING, recurrence_summary STRING, created STRING,
updated STRING"""

CONTACT_IDS = "alias STRING, identifier STRING, ord INT"
CARDS = "seq BIGINT, display_name STRING, phones ARRAY<STRING>, emails ARRAY<STRING>"
SOURCES = """
prefix STRING, provider STRING, email STRING, mailbox STRING, client_id STRING,
tenant_id STRING, timezone STRING, level STRING, ord INT"""
FILTER_RULES = "rule_type STRING, value STRING"
OFFSETS = "key STRING, source STRING, ts STRING"
REFS = "scope STRING, ref BIGINT, id STRING"
METERS = """
source STRING, polled_at TIMESTAMP,
meters ARRAY<STRUCT<label:STRING,count:BIGINT,link:STRING>>"""
USAGE_LOG = "command STRING, source STRING, bytes_in BIGINT, bytes_out BIGINT, messages BIGINT"
LABEL_STATS = "source STRING, provider STRING, name STRING, total BIGINT, unread BIGINT"
RAW = "source STRING, provider STRING, seq BIGINT, payload STRING"


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Project ``df`` onto a table, adding the columns it lacks as NULL."""
    present = set(df.columns)
    return df.select(*[
        (F.col(f"`{f.name}`") if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in struct(ddl)
    ])
