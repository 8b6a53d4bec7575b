"""Nearest neighbours by vantage-point trees, one per shard.

A shard is a hash share of the vectors, small enough for one tree in memory. A tree node halves
its vectors by distance from a vantage point and keeps the least and largest distance of either
half; by the triangle inequality a half cannot hold a vector nearer than its bound. The bound is
multiplied by ``factor`` before it is compared: above one more is pruned, one is exact search.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Vectors of a shard and queries of a block, in expectation; both bound a task's memory.
SHARD = 4096
QUERIES = 1024
LEAF = 64
# Exact search: at factor 1 nothing near is missed.
FACTOR = 1.0
# Rounding of distances must not prune: a bound must exceed the radius by so much, relatively.
SLACK = 1e-9


def distances(vectors: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(((vectors - point) ** 2).sum(axis=1))


class Tree:
    """Vectors as rows of doubles with ids; nodes are (vantage, halves) or a slice of the order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.root = self._node(np.arange(len(ids)))

    def _node(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows, self.vectors[rows], self.ids[rows]
        at = rows[len(rows) // 2]
        rows = rows[rows != at]
        away = distances(self.vectors[rows], self.vectors[at])
        order = np.argsort(away, kind="stable")
        half = len(rows) // 2
        halves = []
        for part in (order[:half], order[half:]):
            halves.append((away[part[0]], away[part[-1]], self._node(np.sort(rows[part]))))
        return self.vectors[at], int(self.ids[at]), halves

    def nearest(self, query: np.ndarray, k: int, own: int | None, factor: float = FACTOR) -> list[tuple[float, int]]:
        """Up to k (distance, id), nearest first, ties to the smaller id; ``own`` is left out."""
        best: list[tuple[float, int]] = []  # a heap of negated pairs: the worst on top

        def offer(distance: float, vec_id: int) -> None:
            if vec_id == own:
                return
            pair = (-distance, -vec_id)
            if len(best) < k:
                heapq.heappush(best, pair)
            elif pair > best[0]:
                heapq.heapreplace(best, pair)

        def visit(node) -> None:
            if len(node[1].shape if isinstance(node[1], np.ndarray) else ()) == 2:
                _, vectors, ids = node
                away = distances(vectors, query)
                radius = -best[0][0] if len(best) == k else np.inf
                for i in np.flatnonzero(away <= radius).tolist():
                    offer(float(away[i]), int(ids[i]))
                return
            vantage, vec_id, halves = node
            d = float(np.sqrt(((vantage - query) ** 2).sum()))
            offer(d, vec_id)
            bounds = [(max(low - d, d - high, 0.0), n) for n, (low, high, _) in enumerate(halves)]
            for bound, n in sorted(bounds):
                if len(best) < k or bound * factor <= -best[0][0] * (1 + SLACK):
                    visit(halves[n][2])

        visit(self.root)
        return sorted((-d, -i) for d, i in best)


def sound(vector: Column) -> Column:
    """Whether a vector is neither null nor zero and all its components are finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest_neighbours(
    rows: DataFrame,
    queries: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    factor: float = FACTOR,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows of every row that ``queries`` selects.

    Score is the Euclidean distance in double precision. Null ids, and vectors that are null,
    zero or not finite in every component, take no part; vectors of other lengths are not
    compared. Rows that repeat an id count once, with the smallest vector. Fewer candidates than
    k give fewer rows; no rows, none. Queries meet shards in blocks, never as pairs of rows.
    """
    own = rows.where(sound(F.col(vector_col)) & F.col(id_col).isNotNull())
    own = own.groupBy(F.col(id_col).cast("bigint").alias("vec_id")).agg(
        F.min(F.col(vector_col).cast("array<double>")).alias("v"), F.max(queries).alias("asks")
    )
    sizes = own.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).head()
    shards, blocks = max(1, -(-sizes["n"] // SHARD)), max(1, -(-sizes["q"] // QUERIES))
    dealt = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    size = F.size("v").alias("size")
    data = own.select("vec_id", "v", size, dealt(shards, 1).alias("shard"), every(blocks).alias("block"))
    asked = own.where("asks").select("vec_id", "v", size, dealt(blocks, 2).alias("block"), every(shards).alias("shard"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, float]] = []
        if len(left) and len(right):
            tree = Tree(left["vec_id"].to_numpy(), np.stack(left["v"].to_numpy()).astype(float))
            for query, v in zip(right["vec_id"].tolist(), right["v"]):
                found += [(query, i, d) for d, i in tree.nearest(np.asarray(v, float), k, query, factor)]
        out = pd.DataFrame(found, columns=["query_id", "vec_id", "score"])
        return out.astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    keys = ("shard", "block", "size")
    met = data.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(search, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
