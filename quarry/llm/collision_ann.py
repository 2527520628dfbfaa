"""Approximate nearest neighbours by collision counting on single projections.

Largest inner products become smallest distances: a vector x gets one more component,
sqrt(M**2 - |x|**2), M the largest norm of the table, and a query gets 0; then the distance falls
as the inner product rises. Every shard sorts its vectors by each of ``projections`` random
projections. A query opens a window around its own projection in each sorted array and counts,
for each vector, the windows that hold it. Virtual rehashing widens all windows by the factor
``GROWTH`` until k vectors are found, then to the distance of the k-th. Vectors counted at least
``threshold`` times are verified on the original vectors. A query ends when its k-th verified
distance lies within the current radius, or when the windows hold all vectors: there is no cap
on candidates.

A vector within the radius meets a window with probability erf(W / sqrt 2), so it is counted in
enough of them with a chance that the projections' number makes as large as wanted.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors
from .common import materialize

PROJECTIONS = 64
#: Windows that must hold a vector, as a part of all.
THRESHOLD = 0.45
#: Half the window's width, in radii.
W = 0.75
GROWTH = 1.3
#: The first radius; vectors nearer than that are found at once.
START = 0.7


class Collisions:
    """One shard's sorted projections.

    ``sorted`` has each projection's values in order, ``place`` each vector's place in it: a window
    around a query is a stretch of places, and a vector collides if its place lies in the stretch.
    """

    def __init__(self, ids: np.ndarray, data: np.ndarray, largest: float, projections: int, threshold: float, seed: int):
        self.ids, self.data, self.largest = ids, data, largest
        self.single = data.astype(np.float32)
        rng = np.random.default_rng(seed)
        self.axes = rng.standard_normal((data.shape[1] + 1, projections))
        rest = np.sqrt(np.maximum(1 - (data ** 2).sum(axis=1) / largest ** 2, 0))
        value = (np.hstack([data / largest, rest[:, None]]) @ self.axes).T
        order = np.argsort(value, axis=1, kind="stable")
        self.sorted = np.take_along_axis(value, order, axis=1)
        self.place = np.empty(order.shape, np.uint16 if len(ids) < 1 << 16 else np.uint32)
        np.put_along_axis(self.place, order, np.arange(len(ids), dtype=self.place.dtype)[None], axis=1)
        self.sums = np.uint8 if projections < 256 else np.uint16
        self.need = max(1, int(np.ceil(threshold * projections)))

    def best(self, ids: np.ndarray, queries: np.ndarray, bound: np.ndarray, k: int):
        """Places of queries, vec_ids and scores of the ``k`` best found for each query.

        All queries that are still open widen their windows together: the ends of all windows are
        found by one search per projection, then each query counts its collisions.
        """
        norm = np.sqrt((queries ** 2).sum(axis=1))
        centre = (queries / norm[:, None]) @ self.axes[:-1]
        n, kind = len(self.ids), self.place.dtype
        open_, radius = np.arange(len(ids)), np.full(len(ids), START)
        out: list = [None] * len(ids)
        while len(open_):
            half = (W * radius[open_])[:, None]
            a, b = (np.stack([np.searchsorted(row, edge[:, j], side) for j, row in enumerate(self.sorted)], axis=1)
                    for edge, side in ((centre[open_] - half, "left"), (centre[open_] + half, "right")))
            left = []
            for q, low, high in zip(open_.tolist(), a, b, strict=True):
                whole = not low.any() and (high == n).all()
                # Places below the stretch wrap round to large numbers.
                inside = (self.place - low.astype(kind)[:, None]) < (high - low).astype(kind)[:, None]
                rows = np.flatnonzero((np.add.reduce(inside.view(np.uint8), axis=0, dtype=self.sums) >= self.need) | whole)
                rows, scores = self._verify(rows[self.ids[rows] != ids[q]], queries[q], k)
                if len(rows) < k and not whole:
                    radius[q] *= GROWTH
                    left.append(q)
                    continue
                out[q] = rows, scores
                # Distance of the k-th, with the query scaled to length 1. Once it lies within the
                # radius the query is done; else that distance is the next radius.
                far = np.sqrt(max(0.0, 2 - 2 * scores[-1] / (norm[q] * self.largest))) if len(rows) else 0.0
                if not whole and far > radius[q]:
                    radius[q] = far
                    left.append(q)
            open_ = np.array(left, np.int64)
        return (np.concatenate([np.full(len(r), q) for q, (r, _) in enumerate(out)]),
                self.ids[np.concatenate([r for r, _ in out])], np.concatenate([v for _, v in out]))

    def _verify(self, rows: np.ndarray, query: np.ndarray, k: int):
        """The ``k`` best of the candidates. A product in single precision finds who may be among
        them; these are summed in double precision row by row, so that equal vectors have equal
        scores."""
        if len(rows) > 4 * k:
            fast = self.single[rows] @ query.astype(np.float32)
            limit = np.partition(fast, len(fast) - k)[len(fast) - k]
            rows = rows[fast >= limit - 1e-5 * self.largest * np.sqrt((query ** 2).sum())]
        scores = (self.data[rows] * query).sum(axis=1)
        keep = vectors.top(self.ids[rows], scores, k)
        return rows[keep], scores[keep]


def nearest(rows: DataFrame, is_query: Column, k: int, projections: int = PROJECTIONS,
            threshold: float = THRESHOLD, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the ``k`` largest inner products found.

    ``is_query`` is a condition on ``vec_id``. Every vector is indexed. Vectors that are null, zero
    or empty or hold null or non-finite components, and rows without vec_id, take no part; vectors
    of different length are not compared. A query's own vec_id is no candidate; other repeated ids
    are one candidate per distinct score. Ties go to the smaller vec_id. Scores are sums in double
    precision over the original vectors. No queries or an empty table: no rows.
    """
    clean = materialize(vectors.finite(rows).filter(F.exists("v", lambda x: x != 0)), "vectors")
    shards, n = vectors.shards_of(clean)
    # The only thing that all shards share: one number.
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    largest = float(np.sqrt(clean.agg(F.max(square)).first()[0] or 1.0))
    queries = clean.withColumnRenamed("id", "vec_id").filter(is_query).withColumnRenamed("vec_id", "id")
    blocks = vectors.to_shards(vectors.blocks_of(queries, queries.count()), F.sequence(F.lit(0), F.lit(n - 1)))
    index = lambda ids, data: Collisions(ids, data, largest, projections, threshold, seed)
    return vectors.ranked(vectors.search(shards, blocks, n, index, k, "double"), k)
