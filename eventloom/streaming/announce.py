"""Announce once: keyed state with time to live, and windows over late and repeated rows.

An item is announced when it is seen for the first time, and again only if it was not
seen for longer than ``KEEP``. The state of an item is one value (when it was last seen)
and one event-time timer, so the state holds the items of the last ``KEEP`` only, and a
restart goes on where the checkpoint ends. Rows of an item may come in any order within
a batch: a task keeps the first and last time of each day, not the rows.

Defined cases: rows with a null key or time are dropped; repeated rows count once;
rows later than the watermark allows are dropped by Spark.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

#: How long an item is remembered after it was last seen.
KEEP = timedelta(days=14)
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Announcer(StatefulProcessor):
    """Rows (key, ts) of one item -> (key, announced_at) for every time that it counts as new."""

    def __init__(self, keep: timedelta) -> None:
        self.keep = keep // timedelta(microseconds=1)

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        days: dict[int, tuple[int, int]] = {}
        for row in rows:
            low, high = days.get(row.at // 86_400_000_000, (row.at, row.at))
            days[row.at // 86_400_000_000] = min(low, row.at), max(high, row.at)
        last = self.seen.get()[0] if self.seen.exists() else None
        for low, high in sorted(days.values()):
            if last is None or low - last > self.keep:
                yield Row(key=key[0], at=low)
            last = high if last is None else max(last, high)
        self.seen.update((last,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((last + self.keep) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.seen.clear()
        yield from ()

    def close(self) -> None:
        pass


@contextlib.contextmanager
def kept_state(spark: SparkSession):
    """State with timers needs Spark's RocksDB store; the session's setting is put back once the stream has ended."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def announced(stream: DataFrame, key: str, ts: str = "ts", keep: timedelta = KEEP, late: str = "1 hour") -> DataFrame:
    """(key, announced_at) of a stream's items."""
    marked = stream.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts")).withColumn("at", F.unix_micros("ts")).withWatermark("ts", late)
    kind = stream.schema[key].dataType.simpleString()
    told = marked.groupBy("key").transformWithState(Announcer(keep), f"key {kind}, at long", "Append", "EventTime")
    return told.select(F.col("key").alias(key), F.timestamp_micros("at").cast(stream.schema[ts].dataType).alias("announced_at"))


def run_available(out: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """What a stream gives for all that is available now, added to a folder; the folder's rows. A repeated batch replaces its files."""
    spark = out.sparkSession
    with kept_state(spark):
        query = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


def settled_windows(stream: DataFrame, width: str = "1 day", late: str = "1 hour", key: str = "event_id") -> DataFrame:
    """Counts and sums by type and tumbling window, of each event once, when a window can change no more; rows that come later than ``late`` are dropped."""
    kind = stream.schema["ts"].dataType
    once = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
    by = once.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return by.select(F.col("w.start").cast(kind).alias("start"), "event_type", "n", "total")
