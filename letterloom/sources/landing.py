"""Landed provider payloads: how they are read, checked and turned into messages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.functions import dates
from letterloom.functions.headers import clean_headers
from letterloom.operators.agenda import duration_minutes
from letterloom.schema import EVENTS, MESSAGES, RAW, conform, struct
from letterloom.session import spread

# A mapper turns raw payloads of one provider into message rows, or into event rows.
Mapper = Callable[[DataFrame], DataFrame]
MAPPERS: dict[str, Mapper] = {}
EVENT_MAPPERS: dict[str, Mapper] = {}
# Providers whose payloads are text of another form, which their mappers check line by line.
TEXT_FORMS: set[str] = set()


@dataclass(frozen=True)
class Form:
    """Payloads of a provider taken apart by columns alone, so that all forms share one scan.

    ``items`` gives the items of a payload, an array of type ``kind``, or the item itself where
    a payload is always ``one``; ``columns`` takes the rows with an item in the named column and
    gives them, with helper columns if it needs any, and the target's columns as expressions
    over them.
    """

    kind: str
    items: Callable[[Column], Column]
    columns: Callable[[DataFrame, str], tuple[DataFrame, dict[str, Column]]]
    one: bool = False


FORMS: dict[str, Form] = {}
EVENT_FORMS: dict[str, Form] = {}


def form(provider: str, kind: str, items: Callable[[Column], Column], events: bool = False, json: bool = True, one: bool = False):
    """Register how the payloads of a provider are taken apart; decorates the ``columns`` of the form."""
    def register(columns):
        (EVENT_FORMS if events else FORMS)[provider] = Form(kind, items, columns, one)
        if not json:
            TEXT_FORMS.add(provider)
        return columns

    return register


def mapper(provider: str, events: bool = False, json: bool = True) -> Callable[[Mapper], Mapper]:
    """Register the mapper of a provider; users add their own the same way."""
    def register(function: Mapper) -> Mapper:
        (EVENT_MAPPERS if events else MAPPERS)[provider] = function
        if not json:
            TEXT_FORMS.add(provider)
        return function

    return register


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Raw payload rows, best kept partitioned by provider; a file that cannot be read is an error."""
    return spark.read.schema(struct(RAW)).option("mode", "PERMISSIVE").json(path)


def split_malformed(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Payloads that are JSON, and the others with their source as a warning."""
    checked = raw.withColumn("_ok", F.try_parse_json("payload").isNotNull())
    bad = checked.where("NOT _ok").select("source", "seq", F.lit("payload is not JSON").alias("error"))
    return checked.where("_ok").drop("_ok"), bad


def failures(raw: DataFrame, bad: DataFrame) -> DataFrame:
    """Per source: payloads, failed ones, and whether nothing of it was usable."""
    broken = bad.groupBy("source").agg(F.count("*").alias("failed"))
    return raw.groupBy("source").agg(F.count("*").alias("payloads")).join(broken, "source", "left").select(
        "source", "payloads", F.coalesce("failed", F.lit(0)).alias("failed"),
        (F.coalesce("failed", F.lit(0)) == F.col("payloads")).alias("all_failed"))


def as_messages(df: DataFrame) -> DataFrame:
    """Clean headers and the full message schema; ``ts`` follows from ``date``.

    A snippet that is absent falls back to the body; an empty one stays empty.
    """
    df = clean_headers(conform(df, MESSAGES))
    return df.withColumns({
        "ts": dates.parse_iso(F.col("date")),
        "snippet": F.coalesce("snippet", "body", F.lit("")),
    })


def _broken() -> Column:
    """Whether a payload is not JSON where it has to be."""
    return ~F.coalesce(F.col("provider").isin(*TEXT_FORMS), F.lit(False)) & F.try_parse_json("payload").isNull()


def rejects(raw: DataFrame) -> DataFrame:
    """Payloads that ``land`` and ``land_events`` leave out, and why: source, provider, seq, error."""
    known = F.coalesce(F.col("provider").isin(*FORMS, *EVENT_FORMS, *MAPPERS, *EVENT_MAPPERS), F.lit(False))
    error = F.when(~known, F.lit("unknown provider")).when(_broken(), F.lit("payload is not JSON"))
    return raw.select("source", "provider", "seq", error.alias("error")).where("error IS NOT NULL")


def _by_provider(values: dict[str, Column]) -> Column:
    """The value of the row's provider."""
    out = F.lit(None)
    for provider, value in values.items():
        out = F.when(F.col("provider") == provider, value).otherwise(out)
    return out


def _items(forms: dict[str, Form]) -> Column:
    """The items of a payload, each in the field of its provider; one without any where the payload is the item."""
    lists = {p: f for p, f in forms.items() if not f.one}

    def tagged(provider):
        def tag(item):
            return F.struct(*[(item if p == provider else F.lit(None).cast(f.kind)).alias(p) for p, f in lists.items()])
        return F.transform(lists[provider].items(F.col("payload")), tag)

    none = F.array(F.lit(None).cast(f"STRUCT<{', '.join(f'`{p}`: {f.kind}' for p, f in lists.items())}>"))
    return _by_provider({p: none if f.one else tagged(p) for p, f in forms.items()})


def _taken_apart(raw: DataFrame, forms: dict[str, Form], target: str) -> DataFrame:
    """The rows of all forms in one pass: a payload is read by its provider's form only.

    Broken payloads have no items. A filter on them would move below what makes the payload,
    which would then be made twice. A payload that is one item is read where its columns are,
    so of one that few columns are asked of no more is read than those.
    """
    rows = spread(raw.where(F.col("provider").isin(*forms)))
    rows = rows.withColumn("_one", F.when(F.col("provider").isin(*[p for p, f in forms.items() if f.one]), F.col("payload")))
    rows = rows.select(*[c for c in rows.columns if c != "payload"], F.posexplode(F.when(~_broken(), _items(forms))).alias("pos", "_item"))
    found = {}
    for provider, each in forms.items():
        item = each.items(F.when(F.col("provider") == provider, F.col("_one"))) if each.one else F.col(f"_item.{provider}")
        rows, found[provider] = each.columns(rows.withColumn(f"_{provider}", item), f"_{provider}")
    def column(field):
        own = {p: c[field.name].cast(field.dataType) for p, c in found.items() if field.name in c}
        return (_by_provider(own) if own else F.col(f"`{field.name}`")).alias(field.name)

    fields = [f for f in struct(target).fields if f.name not in ("source", "seq", "provider")]
    there = {n for c in found.values() for n in c}
    return rows.select("source", "seq", "provider", *[column(f) for f in fields if f.name in there])


def _landed(raw: DataFrame, forms: dict[str, Form], mappers: dict[str, Mapper], target: str, finish: Mapper) -> DataFrame:
    """The rows of all forms, and those of mappers, which see the sound payloads of their provider only."""
    out = finish(_taken_apart(raw, forms, target))
    for provider, function in mappers.items():
        part = raw.where((F.col("provider") == provider) & ~_broken())
        out = out.unionByName(finish(function(part).withColumn("provider", F.lit(provider))))
    return out


def land(raw: DataFrame) -> DataFrame:
    """Messages of all providers in one table; see ``rejects`` for the payloads left out."""
    return _landed(raw, FORMS, MAPPERS, MESSAGES, as_messages)


def land_events(raw: DataFrame) -> DataFrame:
    """Calendar events of all providers in one table; the raw rows may name ``timezone`` and ``owner``."""
    raw = raw.withColumns({c: F.lit(None).cast("string") for c in ("timezone", "owner") if c not in raw.columns})

    def finish(df):
        if "duration_minutes" not in df.columns:
            df = df.withColumn("duration_minutes", F.when(~F.col("all_day"), duration_minutes(F.col("start"), F.col("end"))))
        return conform(df, f"{EVENTS}, provider STRING")

    return _landed(raw, EVENT_FORMS, EVENT_MAPPERS, EVENTS, finish)


def rows_of(raw: DataFrame, own: Form, *keep: str) -> DataFrame:
    """The rows of payloads of one form: source, seq, the kept columns, pos and what the form gives."""
    raw, items = spread(raw), own.items(F.col("payload"))
    found = [F.lit(0).alias("pos"), items.alias("_item")] if own.one else [F.posexplode(items).alias("pos", "_item")]
    items = raw.select(*[c for c in raw.columns if c != "payload"], *found)
    df, columns = own.columns(items, "_item")
    return df.select("source", "seq", *keep, "pos", *[c.alias(n) for n, c in columns.items()])


def prefixed(source: Column, id_: Column) -> Column:
    return F.concat(source, F.lit(":"), F.coalesce(id_.cast("string"), F.lit("")))


def text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def first_where(items: Column, test) -> Column:
    return F.get(F.filter(items, test), F.lit(0))
