"""Issue-tracker payloads: notifications, issues, comments, reviews and search hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.functions import patterns as P
from letterloom.functions.headers import either, lit_map
from letterloom.session import spread
from letterloom.sources.landing import FORMS, form, prefixed, rows_of, text

NOTIFICATION = ("STRUCT<id:STRING,unread:BOOLEAN,reason:STRING,updated_at:STRING,"
                "subject:STRUCT<title:STRING,url:STRING,type:STRING>,repository:STRUCT<full_name:STRING>>")
ISSUE = ("STRUCT<number:STRING,title:STRING,body:STRING,user:STRUCT<login:STRING>,created_at:STRING,"
         "updated_at:STRING,state:STRING,comments:BIGINT,html_url:STRING,pull_request:STRING,url:STRING,"
         "repository_url:STRING>")
COMMENT = "STRUCT<id:STRING,user:STRUCT<login:STRING>,body:STRING,created_at:STRING,html_url:STRING>"
REVIEW = ("STRUCT<id:STRING,user:STRUCT<login:STRING>,body:STRING,submitted_at:STRING,state:STRING,"
          "html_url:STRING>")

# The kinds of ids, most special first, with their shapes and the names of their parts.
ID_SHAPES = (
    ("notification", r"^(\d+)$", ("number",)),
    ("review_comment", r"^([^/\s]+)/([^/#\s]+)/pull-comments/(\d+)$", ("owner", "repo", "number")),
    ("review", r"^([^/\s]+)/([^/#\s]+)/pulls/(\d+)/reviews/(\d+)$", ("owner", "repo", "pull", "number")),
    ("comment", r"^([^/\s]+)/([^/#\s]+)/comments/(\d+)$", ("owner", "repo", "number")),
    ("issue", r"^([^/\s]+)/([^/#\s]+)#(\d+)$", ("owner", "repo", "number")),
)
ID_PARTS = ("owner", "repo", "pull", "number")


def category(kind: Column, title: Column, reason: Column) -> Column:
    """The category of a notification: its subject type, a version bump, then its reason."""
    return F.coalesce(
        F.try_element_at(lit_map(P.SUBJECT_CATEGORIES), text(kind)),
        F.when((kind == "PullRequest") & text(title).rlike(P.VERSION_BUMP_TITLE), F.lit("dependabot")),
        F.try_element_at(lit_map(P.REASON_CATEGORIES), text(reason)),
        F.nullif(reason, F.lit("")), F.lit("other"))


def _path(url: Column) -> Column:
    return F.split(F.trim(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/")), "/")


def repository(url: Column) -> Column:
    """``owner/repo`` of an API address; NULL for other addresses."""
    p = _path(url)
    return F.when((F.size(p) >= 3) & (p[0] == "repos"), F.concat(F.get(p, F.lit(1)), F.lit("/"), F.get(p, F.lit(2))))


def issue_ref(url: Column) -> Column:
    """``owner/repo#42`` of an issue or pull request; NULL for anything else."""
    p = _path(url)
    return F.when(
        F.get(p, F.lit(3)).isin("issues", "pulls") & F.get(p, F.lit(4)).rlike(r"^\d+$"),
        F.concat(repository(url), F.lit("#"), F.get(p, F.lit(4))))


def classify_ids(ids: DataFrame, name: str = "id") -> DataFrame:
    """The kind and parts of each id; ids of no known shape have a NULL kind: rejects.

    Parts that a kind does not have are empty; ``pull`` is the pull request of a review.
    """
    kind = F.lit(None).cast("string")
    parts = dict.fromkeys(ID_PARTS, kind)
    for label, shape, names in reversed(ID_SHAPES):
        fits = F.col(name).rlike(shape)
        kind = F.when(fits, F.lit(label)).otherwise(kind)
        for part in ID_PARTS:
            value = F.regexp_extract(name, shape, names.index(part) + 1) if part in names else F.lit("")
            parts[part] = F.when(fits, value).otherwise(parts[part])
    return ids.select("*", kind.alias("kind"), *[value.alias(part) for part, value in parts.items()])


@form("github", NOTIFICATION, lambda payload: F.from_json(payload, NOTIFICATION), one=True)
def _item_columns(df: DataFrame, item: str) -> tuple[DataFrame, dict[str, Column]]:
    n = F.col(item)
    subject = n["subject"]
    kind = category(subject["type"], subject["title"], n["reason"])
    return df, {
        "id": prefixed(F.col("source"), n["id"]),
        "thread_id": F.coalesce(F.concat("source", F.lit(":"), issue_ref(subject["url"])), F.lit("")),
        "sender": text(n["repository"]["full_name"]), "subject": F.trim(F.concat(F.lit("["), kind, F.lit("] "), text(subject["title"]))),
        "date": text(n["updated_at"]), "category": kind, "unread": F.coalesce(n["unread"], F.lit(False))}


def notifications(raw: DataFrame, unread_only: bool = False) -> DataFrame:
    """Notifications; the sender is the repository, the category leads the subject."""
    rows = rows_of(raw, FORMS["github"]).drop("pos")
    return rows.where("unread") if unread_only else rows


def issues(raw: DataFrame) -> DataFrame:
    """Issues and pull requests as the heads of their threads; ``ref`` is ``owner/repo#42``."""
    i = F.col("i")
    thread = F.concat("source", F.lit(":"), "ref")
    return spread(raw).withColumn("i", F.from_json("payload", ISSUE)).select(
        "source", "seq", thread.alias("id"), thread.alias("thread_id"), text(i["user"]["login"]).alias("sender"),
        text(i["title"]).alias("subject"), text(i["created_at"]).alias("date"), text(i["body"]).alias("body"),
        text(i["state"]).alias("state"), text(i["html_url"]).alias("link"),
        F.coalesce(i["comments"], F.lit(0)).alias("comment_count"),
        F.get_json_object("payload", "$.pull_request").isNotNull().alias("is_pull_request"))


def _reply_columns(item: Column, kind: str, date: Column) -> list[Column]:
    repo = F.substring_index("ref", "#", 1)
    middle = F.concat(F.lit("/pulls/"), F.substring_index("ref", "#", -1), F.lit("/reviews/")) if kind == "reviews" else F.lit(f"/{kind}/")
    return [
        F.col("source"), F.col("seq"),
        F.concat("source", F.lit(":"), repo, middle, text(item["id"])).alias("id"),
        F.concat("source", F.lit(":"), "ref").alias("thread_id"), text(item["user"]["login"]).alias("sender"),
        text(date).alias("date"), text(item["html_url"]).alias("link")]


def comments(raw: DataFrame, kind: str = "comments") -> DataFrame:
    """Comments on issues; ``kind='pull-comments'`` for those on lines of a pull request."""
    c = F.col("c")
    return spread(raw).withColumn("c", F.from_json("payload", COMMENT)).select(
        *_reply_columns(c, kind, c["created_at"]), text(c["body"]).alias("body"))


def reviews(raw: DataFrame) -> DataFrame:
    """Reviews; their verdict leads the body."""
    r = F.col("r")
    state = F.upper(text(r["state"]))
    body = F.when(state == "", text(r["body"])).otherwise(
        F.trim(F.concat(F.lit("["), state, F.lit("] "), text(r["body"]))))
    return spread(raw).withColumn("r", F.from_json("payload", REVIEW)).select(
        *_reply_columns(r, "reviews", r["submitted_at"]), body.alias("body"), state.alias("state"))


def search_hits(raw: DataFrame) -> DataFrame:
    """Search hits; those whose repository cannot be told are dropped."""
    i = F.col("i")
    ref = F.coalesce(issue_ref(i["url"]), F.concat(repository(i["repository_url"]), F.lit("#"), text(i["number"])))
    thread = F.concat("source", F.lit(":"), "_ref")
    return spread(raw).withColumn("i", F.from_json("payload", ISSUE)).withColumn("_ref", ref).where("_ref IS NOT NULL").select(
        "source", "seq", thread.alias("id"), thread.alias("thread_id"), text(i["user"]["login"]).alias("sender"),
        text(i["title"]).alias("subject"), either(i["updated_at"], i["created_at"]).alias("date"),
        F.substring(text(i["body"]), 1, 200).alias("snippet"), text(i["state"]).alias("state"),
        F.get_json_object("payload", "$.pull_request").isNotNull().alias("is_pull_request"))
