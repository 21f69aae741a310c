"""An event store laid out by start date and key: an upsert rewrites the parts it touches, a read opens the parts it asks for.

A part is a span of start dates and a slice of the keys' hashes, a folder of Parquet files sorted by key. A write
puts new versions of the parts it touches beside the old ones and then a mark; a reader takes each part's last marked
version, so it never sees half a write. One writer at a time.
"""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .resolve import checkpointed

PARTS = "span date, slice int, version string"


class DatedTable:
    """Rows with a key, ``start`` and ``end`` dates, ``first_seen``, ``last_seen`` and ``announced``.

    ``schema`` is the rows' schema as DDL. ``grain`` is what a span covers (day, month, year), ``slices`` the number of key
    slices: choose them so that a part fits a few tasks (a part that is too large for one is written by several).
    Keys are not null; a null start or end is kept, in a span of its own, and lies in no range of dates.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, grain: str = "month", slices: int = 16) -> None:
        self.spark, self.path, self.key, self.grain, self.slices = spark, path.rstrip("/"), key, grain, slices
        self.schema = spark.createDataFrame([], schema).schema
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, pattern: str) -> list[str]:
        found = self._fs.globStatus(self._Path(f"{self.path}/{pattern}"))
        return [s.getPath().toString() for s in found or []]

    def versions(self) -> list[str]:
        return sorted(p.rsplit("/", 1)[1] for p in self._names("_versions/*"))

    def parts(self) -> list[str]:
        """The folders that readers open: of each part the last marked version."""
        marked, last = set(self.versions()), {}
        for p in self._names("data/span=*/slice=*/version=*"):
            part, version = p.rsplit("/version=", 1)
            if version in marked and version > last.get(part, ""):
                last[part] = version
        return sorted(f"{part}/version={version}" for part, version in last.items())

    def _span(self, start: Column) -> Column:
        return F.date_trunc(self.grain, start).cast("date")

    def _slice(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.slices)).cast("int")

    def _opened(self, folders: list[str]) -> DataFrame:
        """Rows of the folders with the part's columns; partition columns let Spark skip folders."""
        shape = self.schema
        for field in self.spark.createDataFrame([], PARTS).schema.fields:
            shape = type(shape)(shape.fields + [field])
        if not folders:
            return self.spark.createDataFrame([], shape)
        return self.spark.read.schema(shape).option("basePath", f"{self.path}/data").parquet(*folders)

    def read(self) -> DataFrame:
        return self._opened(self.parts()).select(*self.schema.names)

    def between(self, first: date, last: date) -> DataFrame:
        """Rows whose days overlap first..last: spans by folder, ends by the files' statistics."""
        rows = self._opened(self.parts()).filter((F.col("span") <= F.lit(last)) & (F.col("start") <= F.lit(last)) & (F.col("end") >= F.lit(first)))
        return rows.select(*self.schema.names)

    def get(self, *keys) -> DataFrame:
        """Rows of some keys: the slices of the keys, and in files the row groups that may hold them."""
        wanted = self.spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in keys])).alias("k"))
        slices = [r[0] for r in wanted.select(self._slice(F.col("k").cast(self.schema[self.key].dataType))).distinct().collect()]
        return self._opened(self.parts()).filter(F.col("slice").isin(slices) & F.col(self.key).isin(*keys)).select(*self.schema.names)

    def _touched(self, *rows: DataFrame) -> set[tuple[str, int]]:
        """The parts that rows with (span, slice) lie in; as many as there are parts, not rows."""
        asked = rows[0]
        for more in rows[1:]:
            asked = asked.unionByName(more)
        return {(str(r["span"]) if r["span"] else "__HIVE_DEFAULT_PARTITION__", r["slice"]) for r in asked.distinct().collect()}

    def _folders(self, touched: set[tuple[str, int]]) -> list[str]:
        ends = {f"/span={span}/slice={k}" for span, k in touched}
        return [p for p in self.parts() if "/span=" + p.rsplit("/version=", 1)[0].rsplit("/span=", 1)[1] in ends]

    def _write(self, rows: DataFrame, touched: set[tuple[str, int]], tag: str) -> None:
        """``rows`` are all rows of the touched parts from now on."""
        marked = set(self.versions())
        for p in self._names("data/span=*/slice=*/version=*"):
            if p.rsplit("/version=", 1)[1] not in marked:  # what an interrupted write left
                self._fs.delete(self._Path(p), True)
        name = f"{len(marked):08d}-{uuid.uuid4().hex}-{tag}"
        placed = rows.select(*self.schema.names, self._span(F.col("start")).alias("span"), self._slice(F.col(self.key)).alias("slice"), F.lit(name).alias("version"))
        # small parts share a task, a part that is too large for one is split
        (placed.hint("rebalance", "span", "slice").sortWithinPartitions("span", "slice", self.key)
            .write.mode("append").option("parquet.bloom.filter.enabled#" + self.key, "true").partitionBy("span", "slice", "version").parquet(f"{self.path}/data"))
        for span, k in touched:  # a part that lost all its rows has a version without files
            self._fs.mkdirs(self._Path(f"{self.path}/data/span={span}/slice={k}/version={name}"))
        self._fs.create(self._Path(f"{self.path}/_versions/{name}")).close()
        self._drop_old(sorted(marked))

    def _drop_old(self, before: list[str]) -> None:
        """Keep for each part its last version and the one that readers of the mark before this write may have open."""
        by_part: dict[str, list[str]] = {}
        for p in self._names("data/span=*/slice=*/version=*"):
            part, version = p.rsplit("/version=", 1)
            if version in before:
                by_part.setdefault(part, []).append(version)
        for part, found in by_part.items():
            for version in sorted(found)[:-1]:
                self._fs.delete(self._Path(f"{part}/version={version}"), True)

    def upsert(self, batch: DataFrame, now: datetime, tag: str = "") -> None:
        """Full outer merge by key as ``store.upsert``; of a key's rows in the batch any one counts (deduplicate by an order before).

        A key whose start moved leaves its old part: where the batch's keys lie is looked up in the key and part columns of
        the batch's slices. Only those parts and the batch's own are read and written. An empty batch writes nothing.
        A tag names the batch: one whose tag is marked already is not folded in again.
        """
        if tag and any(v.endswith(f"-{tag}") for v in self.versions()):
            return
        new = checkpointed(batch.filter(F.col(self.key).isNotNull()).dropDuplicates([self.key]), "batch")
        here = new.select(self._span(F.col("start")).alias("span"), self._slice(F.col(self.key)).alias("slice")).distinct()
        old = self._opened(self.parts())
        slices = [r[0] for r in here.select("slice").distinct().collect()]
        known = old.filter(F.col("slice").isin(slices)).select(self.key, "span", "slice").join(new.select(self.key), self.key, "left_semi")
        touched = self._touched(here, known.select("span", "slice"))
        if touched:
            stored = self._opened(self._folders(touched)).select(*self.schema.names)
            self._write(store.upsert(stored, new, self.key, now), touched, tag)

    def drop(self, condition: Column) -> None:
        """Remove the rows for which the condition is true; parts without such rows stay as they are."""
        touched = self._touched(self._opened(self.parts()).filter(condition).select("span", "slice"))
        if touched:
            self._write(self._opened(self._folders(touched)).filter(~F.coalesce(condition, F.lit(False))), touched, "")
