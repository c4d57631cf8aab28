"""Milestones by arbitrary state (ST3): the first events of each user and kind are kept between batches.

First events are held for (user, kind, part), a part being a share of the events
by hash: a user with a third of all events is spread over ``PARTS`` of them, and
each keeps its first ``top`` events by (ts, event_id) only, however late they
come.  One that changes puts out all of its first events; the latest
output of each is what it holds, and the first ``top`` over a user's
parts are those over all events.  State is in RocksDB, below the checkpoint, in
``SHARES`` groups by hash of (user, kind, part): a group's call, its state and its
output cost the same for many users as for one, so calls do not grow with users.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from answerlake.streaming.live import first_rows, run_to_table

PARTS = 8
#: Groups that state is held in.
SHARES = 1024
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_GROUP = ["user", "kind", "part"]
_EVENT = [*_GROUP, "at", "event_id"]
#: Stands for a NULL time or id on the way; before all others, as NULL is.
_NONE = -(1 << 63)


class FirstEvents(StatefulProcessor):
    """The first ``top`` (ts, event_id) of each user, kind and part of a share."""

    def __init__(self, top: int):
        self.top = top

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("first", "users array<string>, kinds array<string>, parts array<int>, ats array<long>, ids array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = pd.DataFrame(dict(zip(_EVENT, map(list, self.held.get())))).assign(new=False) if self.held.exists() else None
        for batch in rows:
            batch = batch[_EVENT].assign(new=True)
            # A replayed event is the same row again: the one that is held stays.
            both = (batch if first is None else pd.concat([first, batch])).drop_duplicates(_EVENT).sort_values(_EVENT)
            first = both[both.groupby(_GROUP, sort=False).cumcount() < self.top]
        if first is not None and first["new"].any():
            self.held.update(tuple(first[c].tolist() for c in _EVENT))
            yield first.loc[first.groupby(_GROUP, sort=False)["new"].transform("any"), _EVENT]

    def close(self) -> None:
        pass


def _told(col: str):
    """A value as text that is never NULL."""
    return F.coalesce(F.concat(F.lit("="), F.col(col).cast("string")), F.lit(""))


def _meant(col: str):
    return F.when(F.col(col) != "", F.substr(F.col(col), F.lit(2)))


def first_events(spark: SparkSession, events: DataFrame, top: int, path: str | None = None, name: str = "first-events") -> DataFrame:
    """The first ``top`` events of each user and kind of a stream of (user_id, kind, ts, event_id), run to its present end.

    Calling again with the same ``path`` goes on after the last finished batch,
    with the state of then.
    """
    keyed = events.select(_told("user_id").alias("user"), _told("kind").alias("kind"), F.pmod(F.xxhash64("event_id"), F.lit(PARTS)).cast("int").alias("part"),
                          F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(_NONE)).alias("at"), F.coalesce(F.col("event_id").cast("long"), F.lit(_NONE)).alias("event_id"))
    user = events.schema["user_id"].dataType
    changed = keyed.withColumn("share", F.pmod(F.xxhash64(*_GROUP), F.lit(SHARES)).cast("int")).groupBy("share").transformWithStateInPandas(
        FirstEvents(top), "user string, kind string, part int, at long, event_id long", "Update", "none")

    def plain(batch: DataFrame) -> DataFrame:
        some = [F.when(F.col(c) != _NONE, F.col(c)).alias(c) for c in ("at", "event_id")]
        return batch.select(_meant("user").cast(user).alias("user_id"), _meant("kind").alias("kind"), "part", *some)

    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        out = run_to_table(spark, changed, name, mode="update", batch_fn=plain, path=path)
    finally:
        spark.conf.set(_PROVIDER, before)
    group = ["user_id", "kind", "part"]
    latest = out.groupBy(*group).agg(F.max("epoch").alias("epoch"))
    held = out.join(latest, [*group, "epoch"]).select("user_id", "kind", F.timestamp_micros("at").cast(events.schema["ts"].dataType).alias("ts"), "event_id")
    return first_rows(held, ["user_id", "kind"], ["ts", "event_id"], top)
