"""A small event store on Parquet: keyed upsert, pruning, health and run logs.

Writes go to a new version folder and a pointer file names the current one, so a
reader never sees half a table and a table can be rewritten from its own rows.
"""

from __future__ import annotations

import uuid
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEPT = ("first_seen", "announced")


class Table:
    """A versioned Parquet table in a folder that Spark can reach."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[str]:
        marks = self._Path(f"{self.path}/_versions")
        if not self._fs.exists(marks):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(marks))

    def read(self) -> DataFrame | None:
        versions = self._versions()
        return self.spark.read.parquet(f"{self.path}/{versions[-1]}") if versions else None

    def has(self, tag: str) -> bool:
        """Whether a version with this tag was completed."""
        return any(v.endswith(f"-{tag}") for v in self._versions())

    def replace(self, df: DataFrame, tag: str | None = None) -> DataFrame:
        """A new version; with a tag, what an interrupted write of it left is overwritten.

        The last version stays for its readers, rows of those before go; their marks stay and tell finished tags.
        """
        name = f"{len(self._versions()):08d}-{tag or uuid.uuid4().hex}"
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        self._fs.create(self._Path(f"{self.path}/_versions/{name}")).close()
        for old in self._versions()[-3:-2]:
            self._fs.delete(self._Path(f"{self.path}/{old}"), True)
        return self.read()


def one_per_key(batch: DataFrame, key: str, order: list) -> DataFrame:
    by = Window.partitionBy(key).orderBy(*order)
    return batch.withColumn("__n", F.row_number().over(by)).filter("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, key: str, now, kept: tuple[str, ...] = KEPT) -> DataFrame:
    """Full outer merge: new columns win, but ``kept`` columns stay as stored; last_seen is ``now`` for rows in the batch."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    here = F.col(f"n.{key}").isNotNull()
    columns = []
    for c in old.columns:
        if c == key:
            value = F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
        elif c == "last_seen":
            value = F.when(here, F.lit(now)).otherwise(F.col("o.last_seen"))
        elif c == "first_seen":
            value = F.coalesce(F.col("o.first_seen"), F.lit(now))
        elif c in kept:
            value = F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}") if c in new.columns else F.lit(False))
        else:
            value = F.when(here, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        columns.append(value.alias(c))
    return joined.select(*columns)


def split_batch(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` with is_new."""
    known = old.select(key).distinct().withColumn("__known", F.lit(True))
    return new.join(known, key, "left").withColumn("is_new", F.col("__known").isNull()).drop("__known")


def prune_stale(events: DataFrame, now: datetime, days: int = 14) -> DataFrame:
    """Without rows last seen more than ``days`` ago; 0 or less disables."""
    return events.filter(F.col("last_seen") >= F.lit(now - timedelta(days=days))) if days > 0 else events


def prune_old(events: DataFrame, ref: date, days: int = 30) -> DataFrame:
    """Without rows that ended more than ``days`` before ``ref``."""
    return events.filter(F.col("end") >= F.lit(ref - timedelta(days=days)))


def prune_all(events: DataFrame) -> DataFrame:
    """No rows, for a full new scan."""
    return events.limit(0)


def pruned(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One row: how many of the rows ``before`` are not in ``after``."""
    return before.select(key).join(after.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("deleted"))


def mark_announced(events: DataFrame, uids: DataFrame) -> DataFrame:
    hit = uids.select("uid").distinct().withColumn("__hit", F.lit(True))
    return events.join(hit, "uid", "left").withColumn("announced", F.col("announced") | F.coalesce("__hit", F.lit(False))).drop("__hit")


def update_health(health: DataFrame, results: DataFrame, now) -> DataFrame:
    """health(source, failures, last_success, last_error) after results(source, ok, errors array)."""
    j = health.join(results, "source", "full")
    ran = F.col("ok").isNotNull()
    return j.select(
        "source",
        F.when(~ran, F.col("failures")).when(F.col("ok"), 0).otherwise(F.coalesce("failures", F.lit(0)) + 1).cast("int").alias("failures"),
        F.when(F.coalesce("ok", F.lit(False)), F.lit(now)).otherwise(F.col("last_success")).alias("last_success"),
        F.when(ran & ~F.col("ok"), F.array_join(F.slice("errors", 1, 3), "; ")).otherwise(F.when(~ran, F.col("last_error"))).alias("last_error"),
    )


def consecutive_failures(history: DataFrame, key: str, order: str, failed: str) -> DataFrame:
    """Failures of each key since its last success."""
    last_ok = history.groupBy(key).agg(F.max(F.when(~F.col(failed), F.col(order))).alias("ok_at"))
    after = history.join(last_ok, key).filter(F.col(failed) & (F.col("ok_at").isNull() | (F.col(order) > F.col("ok_at"))))
    return last_ok.join(after.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("failures"))


def run_log(results: DataFrame) -> DataFrame:
    """One row of counters from results(source, kept, errors array), with the first 20 errors by source."""
    told = results.select(*(["source"] if "source" in results.columns else []), F.posexplode("errors").alias("at", "error"))
    first = told.orderBy(*[c for c in ("source", "at", "error") if c in told.columns]).limit(20)
    first = first.agg(F.collect_list("error").alias("errors"))
    return results.agg(
        F.sum("kept").alias("kept"),
        F.count(F.lit(1)).alias("sources"),
        F.count_if(F.size("errors") > 0).alias("failed"),
    ).join(first, F.lit(True))
