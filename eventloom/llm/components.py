"""Connected components by alternating large-star and small-star rounds, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _both(edges)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether edges u > v are stars already: no vertex is an end of both kinds, and none has two edges down."""
    ends = edges.select("u", F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    sums = ends.groupBy("u").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return sums.filter("down > 1 OR down = 1 AND up = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every vertex but its component's least, with that least vertex. Edges are longs u, v.

    Defined cases: edges from a vertex to itself, repeated edges and edges with a null end
    count for nothing; other columns are ignored; no edges give no rows. Edges that are
    stars of least vertices take no round.
    """
    now = staged(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _stars(now):
        now = staged(_small_star(_large_star(now)), "stars")
    return now
