"""Helpers that the training-data operators share: table access, staging, text rules."""

from __future__ import annotations

import contextlib
import uuid
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of anything but space, tab, newline, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the bitmaps that ``with_likely`` broadcasts: 4 MB at most, however many keys.
LIKELY_BITS = 1 << 25
#: Bits of one bitmap, as ``bitmap_construct_agg`` has them.
BITMAP_BITS = 1 << 15

_scratch: ContextVar[tuple[list[str], ...]] = ContextVar("eventloom_scratch", default=())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; only a local session may leave it unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def staged(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage: lost executors lose no staged rows, and readers do not
    repeat the work above. The folder name is unique to the call.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/eventloom-{label}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    for made in _scratch.get():
        made.append(path)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Folders that are staged inside are deleted at the end, but those taken out of the list that it gives.

    For use where all that still reads them has been written; ``made.pop()`` lets the last one stay.
    """
    made: list[str] = []
    token = _scratch.set((*_scratch.get(), made))
    try:
        yield made
    finally:
        _scratch.reset(token)
        for name in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def with_likely(df: DataFrame, on: str, keys: DataFrame, key: str) -> DataFrame:
    """``df`` with __el_likely: true wherever ``on`` (a long) is among the ``key`` values, and rarely elsewhere.

    Bitmaps of the keys' hashes are broadcast, of a fixed size in all, so that only likely rows need
    to travel to an exact join with ``keys``. Nulls count as a value.
    """

    def place(c: str) -> Column:
        return F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(LIKELY_BITS))

    def bit(c: str) -> Column:
        return place(c) % BITMAP_BITS

    bitmaps = keys.groupBy(F.floor(place(key) / BITMAP_BITS).alias("__el_part")).agg(F.bitmap_construct_agg(bit(key)).alias("__el_bits"))
    byte = F.conv(F.hex(F.substr("__el_bits", F.floor(bit(on) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    joined = df.join(F.broadcast(bitmaps), F.floor(place(on) / BITMAP_BITS) == F.col("__el_part"), "left")
    return joined.select(*(df[f"`{c}`"] for c in df.columns), F.coalesce(F.getbit(byte, (bit(on) % 8).cast("int")) == 1, F.lit(False)).alias("__el_likely"))


def likely(df: DataFrame, on: str, keys: DataFrame, key: str) -> DataFrame:
    """The likely rows of ``df``, see ``with_likely``."""
    return with_likely(df, on, keys, key).filter("__el_likely").drop("__el_likely")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII takes the fast built-in, the rest ``translate``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def fold(holds: Column) -> Column:
    """crc32 of the id as text, mod 5."""
    return F.crc32(holds.cast("string").cast("binary")) % 5


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int = 1000):
    """Batches of at most ``rows`` rows to Python for the jobs inside, so that long texts fit in memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
