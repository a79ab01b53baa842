"""Clean-up of plain-text bodies, wholly inside the JVM, on whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.functions import patterns as P
from letterloom.functions.headers import SPACES, once, strip
from letterloom.session import spread


def is_html(text: Column) -> Column:
    return text.rlike(P.HTML)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def strip_replies(df: DataFrame, name: str) -> DataFrame:
    """Cut from the first header of a quoted message, then drop quoted lines.

    The header is looked for in a copy without emphasis marks; the cut is made in the text
    itself, at the same line. Each step is a column of its own, so it is computed once.
    """
    text = F.col(name)
    df = df.withColumn("_copy", F.translate(text, "*_", ""))
    df = df.withColumn("_at", F.regexp_instr("_copy", F.lit(P.REPLY_HEADER)))
    before = F.substring(F.col("_copy"), F.lit(1), F.col("_at") - 1)
    n_lines = F.length(before) - F.length(F.replace(before, F.lit("\n")))
    head = F.rtrim(F.array_join(F.slice(_lines(text), F.lit(1), n_lines), "\n"), F.lit(SPACES))
    df = df.withColumn(name, F.when(F.col("_at") > 0, head).otherwise(text))
    unquoted = F.array_join(F.filter(_lines(text), lambda x: ~x.rlike(P.QUOTED_LINE)), "\n")
    return df.withColumn(
        name, F.when(F.instr(text, ">") > 0, unquoted).otherwise(text)).drop("_copy", "_at")


def _opens_signature(line: Column) -> Column:
    def opens(line):
        return (
            line.rlike(P.SIGNATURE)
            | F.translate(line, "*_", "").rlike(P.SIGNATURE)
            | line.rlike(P.CONFIDENTIALITY))

    return once(strip(line), opens)


def strip_signature(df: DataFrame, name: str) -> DataFrame:
    """Cut from the first signature line among the last two fifths, or the last 15 lines."""
    total = F.size("_lines")
    skipped = F.greatest(
        F.lit(0), total - F.greatest(F.floor(total * 2 / 5).cast("int"), F.lit(15)))
    at = F.col("_at")
    return (
        df.withColumn("_lines", _lines(F.col(name)))
        .withColumn("_skip", skipped)
        .withColumn("_at", F.array_position(
            F.transform(F.slice("_lines", F.col("_skip") + 1, F.size("_lines")), _opens_signature),
            True).cast("int"))
        .withColumn(name, F.when(
            at > 0, F.array_join(F.slice("_lines", F.lit(1), F.col("_skip") + at - 1), "\n"),
        ).otherwise(F.col(name)))
        .drop("_lines", "_skip", "_at"))


def strip_boilerplate(df: DataFrame, name: str) -> DataFrame:
    """Blank the lines about unsubscribing and viewing in a browser."""
    return df.withColumn(name, F.regexp_replace(name, P.BOILERPLATE_LINE, ""))


def collapse_blank(df: DataFrame, name: str) -> DataFrame:
    """No trailing blanks, at most one empty line in a row, no empty edges."""
    text = F.regexp_replace(name, r"(?md)[ \t]+$", "")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return df.withColumn(name, F.regexp_replace(text, r"^\n+|\n+\z", ""))


def strip_edges(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, strip(F.col(name)))


TEXT_STAGES = (
    strip_edges, strip_replies, strip_signature, strip_boilerplate, collapse_blank, strip_edges)


def clean_text(df: DataFrame, name: str) -> DataFrame:
    """Every plain-text stage in order, over the text column ``name``."""
    df = spread(df)
    for stage in TEXT_STAGES:
        df = stage(df, name)
    return df


def simple_html_to_text(html: Column) -> Column:
    """Text of a page whose structure needs no tree: block ends become line ends.

    Only regular steps, so the whole conversion stays in the JVM. A link keeps its target in
    brackets unless that tells nothing: places on the page itself, mail addresses, click
    trackers and targets that are also the text leave the text only.
    """
    text = F.regexp_replace(html, r"(?is)<!--.*?-->", "")
    text = F.regexp_replace(text, r"(?is)<(style|script|head)\b[^>]*>.*?</\1\s*>", "")
    text = F.regexp_replace(text, r"(?i)<img\b[^>]*>", "")
    text = F.regexp_replace(text, r"\s+", " ")
    text = F.regexp_replace(text, rf"""(?is)<a\b[^>]*?\bhref="(?:#|mailto:|[^"]*(?:{P.LINK_TRACKER}))[^"]*"[^>]*>([^<]*)</a>""", "$1")
    text = F.regexp_replace(text, r"""(?is)<a\b[^>]*?\bhref="([^"]+)"[^>]*>\s*\1\s*</a>""", "$1")
    text = F.regexp_replace(text, r"""(?is)<a\b[^>]*?\bhref="([^"]+)"[^>]*>([^<]*)</a>""", "$2 ($1)")
    text = F.regexp_replace(
        text, r"(?i)<(?:br|/p|/div|/li|/tr|/h[1-6]|/ul|/ol|/blockquote|/article|/footer|/nav)\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]+>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                         ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.regexp_replace(text, r" *\n *", "\n")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))
