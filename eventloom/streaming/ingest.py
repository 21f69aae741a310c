"""Micro-batch ingest: keyed upsert of a file stream into the store, and windowed counts."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import Table


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def latest_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Per key: number of rows, first and last time seen, and the other columns of the last row."""
    rest = [c for c in df.columns if c != key]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), last.alias("last"))


def fold_state(old: DataFrame | None, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """State after another batch's state."""
    if old is None:
        return new
    both = old.unionByName(new)
    return both.groupBy(key).agg(
        F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.max_by("last", F.struct(*[F.col(f"last.{c}") for c in order])).alias("last"),
    )


def upsert_stream(stream: DataFrame, target: Table, checkpoint: str, key: str, order: list[str]) -> None:
    """Run what is available into the store, batch by batch. A version carries its batch's number, so a batch that a restart repeats is not folded in twice."""
    stream_id = zlib.crc32(checkpoint.encode())

    def write(batch: DataFrame, number: int) -> None:
        tag = f"stream{stream_id}.{number}"
        if not target.has(tag):
            target.replace(fold_state(target.read(), latest_per_key(batch, key, order), key, order), tag)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_counts(df: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts by type and tumbling window; on a stream, rows later than ``late`` are dropped."""
    marked = df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if df.isStreaming else df
    return marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("start"), "event_type", "n", "total"
    )
