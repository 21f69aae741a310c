"""Nearest neighbours with vantage-point trees, one per shard.

Rows are dealt evenly to shards of about ``SHARD_ROWS``, queries to blocks of about
``QUERY_ROWS``. Each query first searches one shard; its k-th distance there bounds
the search of all others, where a task builds the tree of one shard and searches it
for one block, so no task holds more than a shard and a block. A node
keeps a vantage point and, for either half of its rows, the least and greatest
distance to it. By the triangle inequality a query at distance d from the vantage
point is at least max(low - d, d - high) from every row of that half; the greatest
such bound on the way to a leaf bounds the leaf. Leaves are visited in the order of
their bounds until bound * ``factor`` exceeds the distance of the k-th best so far.
Factor 1 is exact search; a greater factor visits fewer leaves. What the shards find
within the bound, k a query at most, meets in one small shuffle.

Distances are Euclidean in double precision on the vectors as given; ties go to the
smaller id. Defined cases: vectors that are null, zero, or hold null or non-finite
components take no part, as rows or as queries; vectors of another length than the
query's are no candidates; rows that repeat id and vector are candidates of their
own, but a query never finds its own id; queries that repeat id and vector count once
(an id with several vectors gets the k nearest to any of them); with fewer than k candidates all are
returned; null ids take no part; empty tables give empty results; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged, table

SHARD_ROWS = 4096
LEAF_ROWS = 128
#: Queries of a task; they are searched QUERY_BLOCK at a time.
QUERY_ROWS = 8192
QUERY_BLOCK = 1024
#: Pruning factor of the production query. Recall against brute force is measured in the tests.
FACTOR = 3.0
NEAREST = 10
SLACK = 1e-9


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All Euclidean distances between rows of ``a`` and ``b`` in double precision, by differences."""
    out = np.empty((len(a), len(b)))
    step = max(1, 2_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        d = a[i : i + step, None, :] - b[None, :, :]
        out[i : i + step] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
    return out


class VantageTree:
    """Balanced tree: rows are split at the median distance to a vantage point, ties by position."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.squares = np.einsum("ij,ij->i", self.vectors, self.vectors)
        self.points: list[int] = []
        self.leaves: list[np.ndarray] = []
        #: Per leaf: (vantage point number, low, high) of each node on its path.
        self.paths: list[list[tuple[int, float, float]]] = []
        rng = np.random.default_rng(len(ids))
        todo = [(np.arange(len(ids)), [])] if len(ids) else []
        while todo:
            rows, path = todo.pop()
            if len(rows) <= leaf_rows:
                self.leaves.append(rows)
                self.paths.append(path)
                continue
            tried = rng.choice(rows, min(4, len(rows)), replace=False)
            seen = rng.choice(rows, min(64, len(rows)), replace=False)
            spread = distances(self.vectors[tried], self.vectors[seen]).var(axis=1)
            point = int(tried[np.argmax(spread)])
            d = distances(self.vectors[point : point + 1], self.vectors[rows])[0]
            by = np.argsort(d, kind="stable")
            rows, d, half = rows[by], d[by], len(rows) // 2
            at = len(self.points)
            self.points.append(point)
            todo.append((rows[:half], [*path, (at, d[0], d[half - 1])]))
            todo.append((rows[half:], [*path, (at, d[half], d[-1])]))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Least possible distance of each query to each leaf."""
        out = np.zeros((len(queries), len(self.leaves)))
        if self.points:
            d = distances(queries, self.vectors[self.points])
            for leaf, path in enumerate(self.paths):
                for at, low, high in path:
                    np.maximum(out[:, leaf], np.maximum(low - d[:, at], d[:, at] - high), out=out[:, leaf])
        return out

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, distances) of the k best of each query, no farther than ``within``; -1 and inf where fewer; leaves visited."""
        n = len(queries)
        within = np.full(n, np.inf) if within is None else within
        best_d, best_i = np.full((n, k), np.inf), np.full((n, k), -1, np.int64)
        square = np.einsum("ij,ij->i", queries, queries)
        bound = self.bounds(queries)
        order = np.argsort(bound, axis=1, kind="stable")
        active, visited = np.arange(n), 0
        for turn in range(len(self.leaves)):
            leaf_of = order[active, turn]
            go = bound[active, leaf_of] * factor <= np.minimum(best_d[active, -1], within[active]) + SLACK
            active, leaf_of = active[go], leaf_of[go]
            if not len(active):
                break
            visited += len(active)
            for leaf in np.unique(leaf_of):
                q = active[leaf_of == leaf]
                rows = self.leaves[leaf]
                # a product of matrices tells which pairs may matter; only those get an exact distance
                near = self.squares[rows] + square[q, None] - 2 * (queries[q] @ self.vectors[rows].T)
                limit = np.minimum(best_d[q, -1:], within[q, None]) ** 2
                one, row = np.nonzero(near <= limit + 1e-9 * (1 + limit + square[q, None] + self.squares[rows]))
                pair = queries[q[one]] - self.vectors[rows[row]]
                d = np.full(near.shape, np.inf)
                d[one, row] = np.sqrt(np.einsum("ij,ij->i", pair, pair))
                ids = np.broadcast_to(self.ids[rows], d.shape)
                d = np.where((ids == query_ids[q, None]) | (d > within[q, None]), np.inf, d)
                all_d = np.concatenate([best_d[q], d], axis=1)
                all_i = np.where(np.isinf(all_d), -1, np.concatenate([best_i[q], ids], axis=1))
                by = np.lexsort((all_i, all_d), axis=1)[:, :k]
                best_d[q], best_i[q] = np.take_along_axis(all_d, by, 1), np.take_along_axis(all_i, by, 1)
        return best_i, best_d, visited


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector of doubles) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists(v, lambda x: x != 0)
    return df.filter(F.col(id_col).isNotNull() & v.isNotNull()).filter(~F.coalesce(odd, F.lit(True)) & ~F.coalesce(zero, F.lit(True))).select(
        F.col(id_col).cast("long").alias("id"), v.alias("v")
    )


def stacks(frame: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, matrix, bounds) for each vector length in the frame."""
    lengths = frame.v.map(len)
    for _, part in frame.groupby(lengths, sort=True):
        yield part.id.to_numpy(np.int64), np.stack(part.v.to_list()).astype(np.float64), part.within.to_numpy(np.float64)


def nearest(
    df: DataFrame, queries: DataFrame, id_col="vec_id", vector_col="embedding", k=NEAREST, factor=FACTOR, shard_rows=SHARD_ROWS, leaf_rows=LEAF_ROWS, query_rows=QUERY_ROWS
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of ``df`` found for each row of ``queries``."""
    rows = staged(usable(df, id_col, vector_col), "vectors")
    asked = staged(usable(queries, id_col, vector_col).dropDuplicates(["id", "v"]), "queries")
    shards, blocks = max(1, -(-rows.count() // shard_rows)), max(1, -(-asked.count() // query_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    asked = asked.withColumns({"home": F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shards)), "block": F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks))})

    def search(key, ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        trees = {m.shape[1]: VantageTree(i, m, leaf_rows) for i, m, _ in stacks(ours.assign(within=np.inf))} if len(theirs) else {}
        out = []
        for ids, matrix, within in stacks(theirs):
            tree = trees.get(matrix.shape[1])
            for at in range(0, len(ids) if tree else 0, QUERY_BLOCK):
                some = slice(at, at + QUERY_BLOCK)
                found, d, _ = tree.search(ids[some], matrix[some], k, factor, within[some])
                out.append(pd.DataFrame({"query_id": np.repeat(ids[some], k), "vec_id": found.ravel(), "score": d.ravel()}))
        made = pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        # ids may be negative, so an unused place is told by its infinite distance
        return made[np.isfinite(made.score)] if len(made) else made

    schema = "query_id long, vec_id long, score double"
    at_home = asked.select(F.col("home").alias("shard"), "id", "v", F.lit(float("inf")).alias("within"))
    first = staged(dealt.groupBy("shard").cogroup(at_home.groupBy("shard")).applyInPandas(search, schema), "near-home")
    kth = first.groupBy("query_id").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
    bounded = asked.join(kth.select(F.col("query_id").alias("id"), F.col("score").alias("within")), "id", "left").withColumn("within", F.coalesce("within", F.lit(float("inf"))))
    away = bounded.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))).filter("shard <> home")
    spread = dealt.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    later = spread.groupBy("shard", "block").cogroup(away.select("shard", "block", "id", "v", "within").groupBy("shard", "block")).applyInPandas(search, schema)
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    found = first.unionByName(later)
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_vantage_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0))
