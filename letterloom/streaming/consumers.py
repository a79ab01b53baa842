"""Pages of a message stream for many consumers, each with offsets that move as it reads.

Every micro-batch is one poll of every consumer. A consumer is a key of
``transformWithState``: its state holds an offset per source, the rows that a later page can
still show, and its number of polls. A page of ``count`` rows never needs more than the
newest ``count`` rows of a source, and one row more tells whether a source was cut. So each
task first reduces what it read to that many rows a source, only those are dealt to the
consumers, and the state of a consumer is bounded by its sources, whatever the stream brings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROWS = "source string, date string, seq long, id string"
#: Delivered rows have a place and an id; offsets that moved have ``ts`` instead.
OUTPUT = "key string, poll long, source string, place long, id string, date string, ts string"
#: A source that no message has: its row polls a consumer for which nothing came.
TICK = ""


def _newest(rows: pd.DataFrame, count: int) -> pd.DataFrame:
    """The newest ``count`` rows of each source; rows of one date by arrival."""
    return rows.sort_values(["date", "seq"], ascending=[False, True], kind="stable").groupby("source", sort=False).head(count)


def _reduced(count: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = pd.DataFrame({"source": [TICK], "date": [""], "seq": [0], "id": [""]})
        for batch in batches:
            best = _newest(pd.concat([best, batch]), count)
        yield best

    return run


class Reader(StatefulProcessor):
    """One poll: the page of a consumer from what it holds and what came, and where its offsets go."""

    def __init__(self, count: int):
        self.count = count

    def init(self, handle) -> None:
        self.offsets = handle.getMapState("offsets", "source string", "ts string")
        self.held = handle.getListState("held", "source string, source_ord int, date string, seq long, id string")
        self.polls = handle.getValueState("polls", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        columns = ["source", "source_ord", "date", "seq", "id"]
        offsets = {k[0]: v[0] for k, v in self.offsets.iterator()}
        held = pd.DataFrame(list(self.held.get()), columns=columns)
        policy = "compatible"
        for batch in rows:
            policy = batch["policy"].iloc[0]
            fresh = batch[batch["source"] != TICK]
            fresh = fresh[fresh["date"] >= fresh["source"].map(offsets).fillna(fresh["since"])]
            held = _newest(pd.concat([held, fresh[columns]]) if len(held) else fresh[columns], self.count + 1)
        poll = (self.polls.get()[0] if self.polls.exists() else 0) + 1
        self.polls.update((poll,))

        page = held.sort_values(["date", "source_ord", "seq"], ascending=[False, True, True], kind="stable").head(self.count)
        there, shown = held.groupby("source").size(), page.groupby("source")
        moved = {}
        for source, dates in shown["date"]:
            cut = there[source] > len(dates)
            if not (cut and policy == "lossless"):
                moved[source] = dates.min() if cut else dates.max()
        for source, ts in moved.items():
            self.offsets.updateValue((source,), (ts,))
        held = held[held["date"] >= held["source"].map(moved).fillna("")]
        if len(held):
            self.held.put([(r.source, int(r.source_ord), r.date, int(r.seq), r.id) for r in held.itertuples()])
        else:
            self.held.clear()

        out = page.assign(place=range(1, len(page) + 1), ts=None)[["source", "place", "id", "date", "ts"]]
        out = [out] if len(out) else []
        if moved:
            out.append(pd.DataFrame({"source": list(moved), "place": None, "id": None, "date": None, "ts": list(moved.values())}))
        for part in out:
            part = part.assign(key=key[0], poll=poll)
            part["place"] = part["place"].astype("Int64")
            yield part[["key", "poll", "source", "place", "id", "date", "ts"]]


def pages(stream: DataFrame, follows: DataFrame, count: int) -> DataFrame:
    """The pages and offsets of every consumer, poll by poll; see OUTPUT.

    ``stream`` has source, date, seq and id; undated rows are on no page. ``follows`` has a
    row for each consumer and source: key, source, source_ord, ``since``, from where it reads
    if it has not read yet, and its ``policy``, which is that of ``feed.advanced``.
    """
    polled = follows.groupBy("key").agg(F.first("policy").alias("policy")).select(
        "key", F.lit(TICK).alias("source"), F.lit(0).alias("source_ord"), F.lit("").alias("since"), "policy")
    to = follows.select("key", "source", F.col("source_ord").cast("int").alias("source_ord"), "since", "policy").unionByName(polled)
    newest = stream.where("date IS NOT NULL").select("source", "date", F.col("seq").cast("long").alias("seq"), "id").mapInPandas(_reduced(count + 1), ROWS)
    return newest.join(to, "source").groupBy("key").transformWithStateInPandas(
        Reader(count), outputStructType=OUTPUT, outputMode="Append", timeMode="None")


def read_pages(stream: DataFrame, follows: DataFrame, count: int, out: str, checkpoint: str) -> StreamingQuery:
    """Append pages and offsets to a table until all that is there is read; restarts go on."""
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER)
    # Keyed state of several variables needs this store; a query keeps the one it started with.
    spark.conf.set(PROVIDER, ROCKS)
    try:
        query = pages(stream, follows, count).writeStream.format("parquet").outputMode("append").option("path", out).option(
            "checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return query


def delivered(rows: DataFrame) -> DataFrame:
    return rows.where("place IS NOT NULL").select("key", "poll", "place", "source", "id", "date")


def offsets(rows: DataFrame, before: DataFrame) -> DataFrame:
    """(key, source, ts): the offsets after the last poll, and those from before that did not move."""
    moved = rows.where("place IS NULL").groupBy("key", "source").agg(F.max_by("ts", "poll").alias("_new"))
    return before.select("key", "source", "ts").join(moved, ["key", "source"], "full_outer").select(
        "key", "source", F.coalesce("_new", "ts").alias("ts"))
