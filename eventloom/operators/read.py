"""Read queries over event records: buckets, filters, search, pages, counts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as dt
from ..functions import text as tx


def list_events(
    events: DataFrame, first: date | None = None, last: date | None = None, free: bool = False, categories: list[str] | None = None, min_sources: int = 0
) -> DataFrame:
    """Records that overlap [first, last] and pass all filters given."""
    out = events
    if first:
        out = out.filter(F.col("end") >= F.lit(first))
    if last:
        out = out.filter(F.col("start") <= F.lit(last))
    if free:
        out = out.filter("is_free")
    if categories:
        out = out.filter(F.col("category").isin(categories))
    if min_sources > 1:
        out = out.filter(F.col("source_count") >= min_sources)
    return out


def in_bucket(events: DataFrame, bucket: str, ref: date) -> DataFrame:
    return list_events(events, *dt.bucket_bounds(bucket, ref))


def search(events: DataFrame, needle: str, limit: int, order: list) -> DataFrame:
    """Text search among the first max(20 * limit, 500) records in order, then at most ``limit`` of them."""
    found = events.orderBy(*order).limit(max(20 * limit, 500))
    plain = tx.fold(F.lit(needle))
    key = tx.normalize_title(F.lit(needle))
    text = tx.fold(F.concat_ws(" ", "title", F.coalesce("venue", F.lit(""))))
    hit = F.contains(text, plain) | ((key != "") & F.contains(tx.normalize_title(F.col("title")), key))
    return found.filter(hit).orderBy(*order).limit(limit)


def page(events: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    return events.orderBy(*order).offset(offset).limit(limit)


def counts(events: DataFrame, ref: date) -> DataFrame:
    """Total, upcoming, free and multi-source upcoming records in one pass."""
    ahead = F.col("end") >= F.lit(ref)
    return events.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ahead).alias("upcoming"),
        F.count_if(ahead & F.col("is_free")).alias("free"),
        F.count_if(ahead & (F.col("source_count") > 1)).alias("multi_source"),
    )


def category_counts(events: DataFrame, ref: date) -> DataFrame:
    return events.filter(F.col("end") >= F.lit(ref)).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def unannounced(events: DataFrame, ref: date, limit: int) -> DataFrame:
    return events.filter(~F.col("announced") & (F.col("end") >= F.lit(ref))).orderBy("start", "title", "uid").limit(limit)


def mode_per(df: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key, ties to the smaller."""
    n = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value), F.max("n").alias("n"))


def best_strategy(rows: DataFrame, structured: list[str], enough: int = 5) -> DataFrame:
    """The strategy of each page (page, strategy, strategy_ord): most rows, ties to the earlier one.

    Strategies after a structured one with enough rows are not considered.
    """
    n = rows.groupBy("page", "strategy", "strategy_ord").agg(F.count(F.lit(1)).alias("n"))
    stop = n.filter(F.col("strategy").isin(structured) & (F.col("n") >= enough)).groupBy("page").agg(F.min("strategy_ord").alias("stop"))
    n = n.join(stop, "page", "left").filter("stop IS NULL OR strategy_ord <= stop")
    return n.groupBy("page").agg(F.min_by("strategy", F.struct(-F.col("n"), "strategy_ord")).alias("strategy"), F.max("n").alias("n"))


def label_bucket(start: Column, end: Column, ref: date) -> Column:
    return dt.classify(start, end, ref)
