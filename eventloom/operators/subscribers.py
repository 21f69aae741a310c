"""Subscribers of chats: keyed upsert, flags, lists, and their replies with saved filters.

A subscriber has chat_id, title, active, digest_enabled, notify_new, free_only,
categories and keywords.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import notify, read

#: Events that one reply lists at most.
REPLY_LIMIT = 40


def upsert(subscribers: DataFrame, changes: DataFrame) -> DataFrame:
    """``subscribers`` after ``changes``, one row per chat_id with some of the other columns.

    A null changes nothing, nor does an empty title; new subscribers get the usual
    settings where nothing is given.
    """
    usual = {
        "active": F.lit(True), "digest_enabled": F.lit(True), "notify_new": F.lit(True), "free_only": F.lit(False),
        "categories": F.array().cast("array<string>"), "keywords": F.array().cast("array<string>"),
    }
    both = subscribers.alias("s").join(changes.alias("c"), F.col("s.chat_id") == F.col("c.chat_id"), "full")
    out = []
    for name in subscribers.columns:
        given = F.col(f"c.{name}") if name in changes.columns else F.lit(None)
        if name == "title":
            given = F.nullif(given, F.lit(""))
        out.append(F.coalesce(given, F.col(f"s.{name}"), *([usual[name]] if name in usual else [])).alias(name))
    return both.select(*out)


def deactivate(subscribers: DataFrame, gone: DataFrame) -> DataFrame:
    """Subscribers whose chat_id is in ``gone`` are kept, but no longer active."""
    hit = gone.select("chat_id").distinct().withColumn("__gone", F.lit(True))
    return subscribers.join(hit, "chat_id", "left").withColumn("active", F.col("active") & F.col("__gone").isNull()).drop("__gone").select(*subscribers.columns)


def listed(subscribers: DataFrame, digest_only: bool = False, notify_only: bool = False) -> DataFrame:
    """Active subscribers, if asked only those who want digests or news."""
    out = subscribers.filter("active")
    if digest_only:
        out = out.filter("digest_enabled")
    return out.filter("notify_new") if notify_only else out


def bucket_replies(events: DataFrame, subscribers: DataFrame, bucket: str, ref: date, order: list[str], limit: int = REPLY_LIMIT) -> DataFrame:
    """(chat_id, n, event columns): each subscriber's first ``limit`` events of a bucket under the saved filters; keywords do not count here.

    Subscribers with the same filters get the same reply, so a reply is made once per
    distinct setting and then joined to its subscribers.
    """
    wanted = F.array_sort(F.array_distinct(F.coalesce("categories", F.array().cast("array<string>"))))
    wish = F.struct(F.coalesce("free_only", F.lit(False)).alias("free"), wanted.alias("kinds"))
    asked = subscribers.select("chat_id", wish.alias("__wish"), "free_only", "categories")
    settings = asked.groupBy("__wish").agg(F.first("free_only").alias("free_only"), F.first("categories").alias("categories"))
    settings = settings.select(F.col("__wish").alias("chat_id"), F.coalesce("free_only", F.lit(False)).alias("free_only"), "categories", F.array().cast("array<string>").alias("keywords"))
    found = notify.matches(read.in_bucket(events, bucket, ref), settings).select(F.col("chat_id").alias("__wish"), *events.columns)
    top = found.withColumn("n", F.row_number().over(Window.partitionBy("__wish").orderBy(*order))).filter(F.col("n") <= limit)
    return asked.select("chat_id", "__wish").join(top, "__wish").drop("__wish")
