"""Exact largest inner products by ball trees, branch and bound.

Each shard is a tree of balls: a node splits at the median of the component that varies most,
down to leaves of ``LEAF`` vectors. No vector of a ball has a larger inner product with q than
q . centre + |q| radius, so nodes whose bound is below the query's k-th score are dropped with all
below them. Leaves left are visited in the order of their bounds until the next bound is below the
k-th score. Each query first searches one shard; its k-th score there goes with it to the others.

Components are integers and scores are exact: they are summed in doubles while no sum can pass
2**53, and in 64-bit integers otherwise.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors
from .common import materialize

LEAF = 64
#: Leaves looked at together.
STEP = 8


class BallTree:
    def __init__(self, ids: np.ndarray, data: np.ndarray):
        groups, self.levels = [np.arange(len(ids))], []
        while True:
            self.levels.append(self._balls(data, groups))
            if max(map(len, groups)) <= LEAF:
                break
            groups = [half for g in groups for half in self._split(data, g)]
        order = np.concatenate(groups)
        self.ids, self.data = ids[order], data[order]
        self.end = np.cumsum([len(g) for g in groups])
        self.start = self.end - [len(g) for g in groups]
        self.exact = float(np.abs(data).max(initial=0.0))

    @staticmethod
    def _balls(data, groups):
        centre = np.array([data[g].mean(axis=0) if len(g) else np.zeros(data.shape[1]) for g in groups])
        radius = np.array([np.sqrt(((data[g] - c) ** 2).sum(axis=1).max(initial=0.0)) for g, c in zip(groups, centre, strict=True)])
        return centre, radius

    @staticmethod
    def _split(data, group):
        axis = data[group].var(axis=0).argmax() if len(group) else 0
        order = group[np.argsort(data[group, axis], kind="stable")]
        half = len(order) // 2
        return order[:half], order[half:]

    def _bounds(self, level: int, queries: np.ndarray, norm: np.ndarray) -> np.ndarray:
        centre, radius = self.levels[level]
        bound = queries @ centre.T + norm[:, None] * radius
        return bound + 1e-9 * (1 + np.abs(bound) + norm[:, None] * np.linalg.norm(centre, axis=1))

    def best(self, ids: np.ndarray, queries: np.ndarray, bound: np.ndarray, k: int):
        norm = np.sqrt((queries ** 2).sum(axis=1))
        # Level by level: a node stays if its parent did and its bound reaches the k-th score.
        live = np.ones((len(ids), 1), bool)
        for level in range(len(self.levels)):
            if level:
                live = np.repeat(live, 2, axis=1)
            upper = self._bounds(level, queries, norm)
            live &= upper >= bound[:, None]
        upper = np.where(live, upper, -np.inf)
        doubles = self.exact * np.abs(queries).max(initial=0.0) * queries.shape[1] < 2.0 ** 53
        data = self.data if doubles else self.data.astype(np.int64)
        out = [], [], []
        for q in range(len(ids)):
            order = np.argsort(-upper[q], kind="stable")
            query = queries[q] if doubles else queries[q].astype(np.int64)
            best_id, best, kth = np.zeros(0, np.int64), np.zeros(0, np.int64), bound[q]
            for at in range(0, len(order), STEP):
                leaves = order[at:at + STEP]
                leaves = leaves[(upper[q, leaves] >= kth) & (upper[q, leaves] > -np.inf)]
                if not len(leaves):
                    break
                rows = np.concatenate([np.arange(self.start[x], self.end[x]) for x in leaves.tolist()])
                score = (data[rows] @ query).astype(np.int64)
                take = (self.ids[rows] != ids[q]) & (score >= kth)
                best_id = np.concatenate([best_id, self.ids[rows][take]])
                best = np.concatenate([best, score[take]])
                keep = vectors.top(best_id, best, k)
                best_id, best = best_id[keep], best[keep]
                if len(best) == k:
                    kth = max(kth, best[-1])
            out[0].append(np.full(len(best), q)), out[1].append(best_id), out[2].append(best)
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def top_inner_products(rows: DataFrame, is_query: Column, k: int, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` largest integer inner products.

    ``is_query`` is a condition on ``vec_id``. Components become floor(scale * x). Vectors that are
    null or empty or hold null or non-finite components, and rows without vec_id, take no part;
    vectors of different length are not compared. A query's own vec_id is no candidate; other
    repeated ids are one candidate per distinct score. Ties go to the smaller vec_id. Scores must
    fit 64 bits. No queries or an empty table: no rows.
    """
    clean = vectors.finite(rows).withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))
    clean = materialize(clean, "vectors")
    shards, n = vectors.shards_of(clean)
    queries = clean.withColumnRenamed("id", "vec_id").filter(is_query).withColumnRenamed("vec_id", "id")
    total = queries.count()
    home = vectors.blocks_of(queries, total).withColumn("shard", F.pmod("block", F.lit(n)).cast("int"))
    first = materialize(vectors.search(shards, home, n, BallTree, k, "long"), "topk-home")
    kth = (vectors.ranked(first, k).groupBy("query_id").agg(F.max("rank").alias("n"), F.min("score").alias("kth"))
           .select(F.col("query_id").alias("id"), F.when(F.col("n") == k, F.col("kth").cast("double")).alias("kth")))
    known = queries.join(kth, "id", "left").select("id", "v", F.coalesce("kth", F.lit(float("-inf"))).alias("bound"))
    others = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda s: s != F.pmod(F.col("block"), F.lit(n)))
    rest = vectors.search(shards, vectors.to_shards(vectors.blocks_of(known, total), others), n, BallTree, k, "long")
    return vectors.ranked(first.union(rest), k)
