"""Streams that keep one row per key in the state store, updated in place, and the state read as a table.

No table is read again or written whole for a batch: a batch touches the keys it has rows for. The state lives in
RocksDB and its changes below the checkpoint, from which a stream that stopped goes on, and from which ``state_table`` reads the
rows of all keys.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

# executors get these classes with the job and need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROVIDER = ("spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def rocksdb(spark: SparkSession):
    """The state store that keyed state needs; the session's own setting is put back."""
    name, wanted = PROVIDER
    before = spark.conf.get(name, None)
    spark.conf.set(name, wanted)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


MICROS = "__micros"  # state holds instants as microseconds, in columns of this ending


def _with_micros(rows: DataFrame, *kept: str) -> DataFrame:
    return rows.select(*kept, *[
        F.unix_micros(F.col(f"`{f.name}`")).alias(f.name + MICROS) if f.dataType.typeName() == "timestamp" else F.col(f"`{f.name}`")
        for f in rows.schema.fields])


def _with_instants(rows: DataFrame) -> DataFrame:
    return rows.select(*[
        F.timestamp_micros(F.col(f"`{c}`")).alias(c.removesuffix(MICROS)) if c.endswith(MICROS) else F.col(f"`{c}`")
        for c in rows.columns])


def _order(values: tuple) -> tuple:
    """A key under which rows compare like columns: null lowest, NaN highest."""
    return tuple((v is not None, v != v, v if v is not None and v == v else 0) for v in values)


class _Newest(StatefulProcessor):
    """Of each key the newest row; of equally new ones the highest. Rows that come late or again change nothing."""

    def __init__(self, names: list[str], schema: str, ttl: timedelta | None):
        self.names, self.schema, self.ttl = names, schema, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", self.schema)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        before = tuple(self.newest.get()) if self.newest.exists() else None
        best = before
        for row in rows:
            values = tuple(row[n] for n in self.names)
            if best is None or _order(values) > _order(best):
                best = values
        if best != before:
            self.newest.update(best)
            if self.ttl:
                if before is not None:
                    self.handle.deleteTimer(_due(before[0], self.ttl))
                self.handle.registerTimer(_due(best[0], self.ttl))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.newest.clear()
        yield from ()

    def close(self) -> None:
        pass


def _due(micros: int, after: timedelta) -> int:
    """The time of a timer, in milliseconds."""
    return (micros + after // timedelta(microseconds=1)) // 1000


def newest_rows(updates: DataFrame, key: str, ttl: timedelta | None = None, lateness: str = "1 hour") -> DataFrame:
    """A stream that keeps, in state ``newest``, the last update of every key by event_timestamp. With a time to live, a
    key is dropped once the watermark is so far beyond its last update, and updates older than the watermark
    come too late. Updates without a time say nothing. Gives no rows itself."""
    first = "event_timestamp"
    updates = updates.select(key, first, *[c for c in updates.columns if c not in (key, first)]).where(F.col(first).isNotNull())
    if ttl:
        updates = updates.withWatermark(first, lateness)
    rows = _with_micros(updates, *([first] if ttl else []))  # the watermark's own column has to stay
    names = [c for c in rows.columns if c not in (key, first)]
    kinds = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)
    return rows.groupBy(key).transformWithState(
        _Newest(names, kinds, ttl), f"`{key}` {rows.schema[key].dataType.simpleString()}", "Append", "EventTime" if ttl else "None")


class _Activity(StatefulProcessor):
    """Of each user the number of events and the first and last time; given out and forgotten once idle for long."""

    def __init__(self, key: str, idle: timedelta):
        self.key, self.idle = key, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.activity = handle.getValueState("activity", f"event_count long, first_ts{MICROS} long, last_ts{MICROS} long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        times = [row["micros"] for row in rows]
        count = len(times)
        if self.activity.exists():
            before, first, last = self.activity.get()
            self.handle.deleteTimer(_due(last, self.idle))
            count, times = count + before, [*times, first, last]
        first, last = min(times), max(times)
        self.activity.update((count, first, last))
        self.handle.registerTimer(_due(last, self.idle))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        count, first, last = self.activity.get()
        self.activity.clear()
        yield Row(**{self.key: key[0], "event_count": count, f"first_ts{MICROS}": first, f"last_ts{MICROS}": last})

    def close(self) -> None:
        pass


def activity_rows(events: DataFrame, key: str = "user_id", idle: timedelta = timedelta(days=90),
                  lateness: str = "1 hour") -> DataFrame:
    """A stream that keeps, in state ``activity``, event_count, first_ts and last_ts of every user, and gives out those
    of users who have been idle for ``idle``, when the watermark passes it; then the state forgets them. Events without
    a time or user count nowhere."""
    kind = events.schema[key].dataType.simpleString()
    known = events.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).select(key, "ts")
    timed = known.withWatermark("ts", lateness).withColumn("micros", F.unix_micros("ts"))
    return _with_instants(timed.groupBy(key).transformWithState(
        _Activity(key, idle), f"`{key}` {kind}, event_count long, first_ts{MICROS} long, last_ts{MICROS} long",
        "Append", "EventTime"))


def run_state(stream: DataFrame, checkpoint: str, out: str | None = None) -> StreamingQuery:
    """Process what is there, then stop; rows that are given out are appended to ``out``. Run again with the same
    checkpoint, it goes on where it stopped."""
    with rocksdb(stream.sparkSession):
        writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        query = writer.format("parquet").option("path", out).start() if out else writer.format("noop").start()
        query.awaitTermination()
    return query


def state_table(spark: SparkSession, checkpoint: str, state: str) -> DataFrame:
    """The rows of all keys as the last batch left them."""
    rows = spark.read.format("statestore").option("stateVarName", state).load(checkpoint)
    return _with_instants(rows.select("key.*", "value.*"))
