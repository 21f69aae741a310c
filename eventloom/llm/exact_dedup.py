"""Exact dedup with a heavy-hitter split.

A Misra-Gries summary (the frequent-items sketch behind ``approx_top_k``, which
merges partial summaries map-side) names at most ``HEAVY_ITEMS`` candidate
digests. A second pass counts exactly those digests and fixes their winners;
that verified table has at most ``HEAVY_ITEMS`` rows, so it is broadcast and
every row of a heavy digest is decided where it lies. All other digests have few
copies (at most rows / ``SKETCH_ITEMS`` each) and meet in an ordinary shuffle of
the digest, never of the text.

Defined cases: a null text counts as empty; of equal texts the largest id stays,
null ids lose against any id; rows that repeat id and text keep exactly one;
empty tables give empty results; an input column with the name of an output
column is replaced, other extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import LOWER, UPPER, ascii_lower, staged, table

#: Digests that may be decided by broadcast: a fixed bound, about 100 bytes each.
HEAVY_ITEMS = 512
#: Counters of the summary.
SKETCH_ITEMS = 8192
#: Verified copies from which a digest counts as heavy.
HEAVY_COPIES = 16

_DIGEST, _ROW, _ORDER = "__el_digest", "__el_row", "__el_order"


def with_digest(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(_DIGEST, F.sha2(ascii_lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), 256))


def heavy_winners(digests: DataFrame) -> DataFrame:
    """(digest, winner, copies) of the frequent digests, counted exactly, at most HEAVY_ITEMS rows."""
    summary = digests.select(F.expr(f"approx_top_k({_DIGEST}, {HEAVY_ITEMS}, {SKETCH_ITEMS})").alias("top"))
    named = summary.select(F.explode("top").alias("t")).select(F.col("t.item").alias(_DIGEST))
    found = (
        digests.join(F.broadcast(named), _DIGEST, "left_semi")
        .groupBy(_DIGEST)
        .agg(F.max(_ORDER).alias("__el_winner"), F.count(F.lit(1)).alias("__el_copies"))
        .filter(F.col("__el_copies") >= HEAVY_COPIES)
    )
    return staged(found, "heavy")


def mark_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` with keep_id, group_size, kept and text_sha256.

    ``keep_text=False`` drops the text as soon as its digest is known, so that
    only ids and digests are staged and shuffled.
    """
    spark = df.sparkSession
    marked = with_digest(df, text_col)
    if not keep_text:
        marked = marked.drop(text_col)
    marked = marked.withColumn(_ROW, F.monotonically_increasing_id())
    if not keep_text:
        marked = staged(marked, "digests")
    order = F.struct(F.col(id_col).alias("id"), F.col(_ROW).alias("row")).alias(_ORDER)
    digests = marked.select(_DIGEST, order)
    if not isinstance(df.schema[id_col].dataType, (T.LongType, T.IntegerType, T.StringType)):
        raise TypeError(f"{id_col} must be an integer or a string")
    heavy = heavy_winners(digests)
    decided = marked.withColumn(_ORDER, F.struct(F.col(id_col).alias("id"), F.col(_ROW).alias("row")))
    hot = decided.join(F.broadcast(heavy), _DIGEST, "inner")
    rest = decided.join(F.broadcast(heavy.select(_DIGEST)), _DIGEST, "left_anti")
    same = Window.partitionBy(_DIGEST)
    rest = rest.withColumns(
        {"__el_winner": F.max(_ORDER).over(same), "__el_copies": F.count(F.lit(1)).over(same)}
    )
    both = hot.unionByName(rest)
    return both.withColumns(
        {
            "keep_id": F.col("__el_winner.id"),
            "group_size": F.col("__el_copies").cast("long"),
            "kept": F.col(_ORDER) == F.col("__el_winner"),
            "text_sha256": F.col(_DIGEST),
        }
    ).drop(_DIGEST, _ROW, _ORDER, "__el_winner", "__el_copies")


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns of ``df``."""
    names = df.columns
    safe = df.select(*names, F.col(id_col).alias("__el_id"), F.col(text_col).alias("__el_text"))
    marks = mark_duplicates(
        safe.select("__el_id", "__el_text", F.struct(*names).alias("__el_all")), "__el_id", "__el_text"
    )
    return marks.filter("kept").select("__el_all.*")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mark_duplicates(docs, keep_text=False).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM d
"""
