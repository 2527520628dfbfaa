"""Centroid clustering over zone maps: blocks of vectors along a Hilbert curve.

Vectors are ordered by a Hilbert curve, cut into blocks and stored with the block's smallest and
largest value per dimension (its box). A round compares boxes with centroids first: centroid b
can't be nearest to any vector of a block if another one, a, is nearer everywhere in the box. As
|x-a|^2 - |x-b|^2 is linear in x, its largest value over a box is a sum over dimensions. The
vectors of the block are then compared with the candidates left, all at once and in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .entries import is_finite, on_grid

#: Vectors of a block.
BLOCK = 128
#: The curve runs over this many dimensions (those of the largest variance) ...
CURVE_DIMS = 8
#: ... with this many bits each.
CURVE_BITS = 7
#: Largest |x| of a component: squared distances of 64 components then fit a long.
LIMIT = float(1 << 21)
#: Whole numbers below this are exact as doubles.
EXACT = float(1 << 53)

_BLOCKS = "ids array<long>, data binary, lo array<long>, hi array<long>"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of grid cells (n x dims, each below 2**bits), after Skilling's
    transform of axes (2004): undo the excess rotations per bit, then Gray code, then interleave."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for shift in range(bits - 1, 0, -1):
        low = (1 << shift) - 1
        for i in range(dims):
            high = (x[i] >> shift) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for shift in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> shift) & 1 == 1, (1 << shift) - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for shift in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> shift) & 1)
    return key


def kept_vectors(vectors: DataFrame, dims: int) -> DataFrame:
    """id, v (array<long>) of the rows whose vector has ``dims`` finite components."""
    v = F.col("embedding").cast("array<double>")
    fine = vectors.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).filter(is_finite(F.col("v")) & (F.size("v") == dims))
    return fine.select("id", on_grid(F.col("v"), LIMIT).alias("v"))


def first_centroids(kept: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:id``, in that order; equal ids by their
    components, null ids last."""
    drawn = kept.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "v")
    return [r.v for r in drawn.orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()]


def _matrix(column) -> np.ndarray:
    """Arrow lists of equal length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def blocks_of(kept: DataFrame) -> DataFrame:
    """Blocks along the curve: ids, data (int64 rows), lo and hi of the box.

    The curve is the sort key of a range partitioning; a hash of the id breaks ties, so copies of
    one vector, however many, spread over ranges as well.
    """
    span = (kept.select(F.posexplode("v").alias("dim", "x"))
            .groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.var_pop("x").alias("var"))
            .orderBy(F.desc("var"), "dim").limit(CURVE_DIMS).collect())
    dims = [r.dim for r in span]
    lo = np.array([r.lo for r in span], np.float64)
    width = np.array([r.hi - r.lo + 1 for r in span], np.float64)
    bits = CURVE_BITS

    def with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1))[:, dims]
                cells = np.minimum((x - lo) / width * (1 << bits), (1 << bits) - 1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hilbert_keys(cells, bits))], ["id", "v", "key"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1))
            ids = b.column(0)
            rows = [(ids.slice(i, BLOCK).to_pylist(), x[i:i + BLOCK]) for i in range(0, len(x), BLOCK)]
            yield pa.RecordBatch.from_arrays([
                pa.array([i for i, _ in rows], pa.list_(pa.int64())),
                pa.array([m.astype(np.int64).tobytes() for _, m in rows], pa.binary()),
                pa.array([m.min(axis=0).tolist() for _, m in rows], pa.list_(pa.int64())),
                pa.array([m.max(axis=0).tolist() for _, m in rows], pa.list_(pa.int64()))], ["ids", "data", "lo", "hi"])

    keyed = kept.mapInArrow(with_key, "id long, v array<long>, key long").withColumn("tie", F.xxhash64("id", "v"))
    ordered = keyed.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie")
    return materialize(ordered.select("id", "v").mapInArrow(cut, _BLOCKS), "zone-blocks")


def candidates(lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest somewhere in the box, ties included."""
    lo, hi, c = (np.asarray(a, np.float64) for a in (lo, hi, centroids))
    near = int(((c - (lo + hi) / 2) ** 2).sum(axis=1).argmin())
    # Largest |x-near|^2 - |x-b|^2 over the box, per dimension at one of its two ends.
    slope = 2 * (c - c[near])
    worst = np.where(slope > 0, slope * hi, slope * lo) + c[near] ** 2 - c ** 2
    most = worst.sum(axis=1)
    slack = 1e-12 * np.abs(worst).sum(axis=1)  # rounding; no effect below 2**53, where all is exact
    return np.flatnonzero(most >= -slack)


def nearest(x: np.ndarray, centroids: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each vector's nearest centroid among ``some``, ties to the
    smaller number."""
    c = centroids[some]
    if 4.0 * x.shape[1] * max(np.abs(x).max(), np.abs(c).max()) ** 2 < EXACT:
        xf, cf = x.astype(np.float64), c.astype(np.float64)
        d = (xf ** 2).sum(axis=1)[:, None] - 2 * (xf @ cf.T) + (cf ** 2).sum(axis=1)
    else:
        d = np.stack([((x - one) ** 2).sum(axis=1) for one in c], axis=1)
    at = d.argmin(axis=1)
    return some[at], d[np.arange(len(x)), at].astype(np.int64)


def _assign(batches: Iterator[pa.RecordBatch], centroids: np.ndarray):
    """For each block: ids, matrix, candidates, cluster and distance of its vectors."""
    for b in batches:
        for ids, data, lo, hi in zip(b.column(0), b.column(1), b.column(2), b.column(3)):
            x = np.frombuffer(data.as_buffer(), np.int64).reshape(-1, centroids.shape[1])
            some = candidates(lo.values.to_numpy(), hi.values.to_numpy(), centroids)
            yield ids.values, x, some, *nearest(x, centroids, some)


def _totals(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, dim, s, n: sums and counts of each task, added up by Spark."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centroids.shape
        sums, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for _, x, _, cluster, _ in _assign(batches, centroids):
            n += np.bincount(cluster, minlength=k)
            for c in np.unique(cluster):
                sums[c] += x[cluster == c].sum(axis=0)
        for c in np.flatnonzero(n):
            yield pa.RecordBatch.from_arrays(
                [pa.array([c] * dims, pa.int32()), pa.array(range(dims), pa.int32()), pa.array(sums[c]),
                 pa.array([n[c]] * dims, pa.int64())], ["cluster", "dim", "s", "n"])

    part = blocks.mapInArrow(partial, "cluster int, dim int, s long, n long")
    return part.groupBy("cluster", "dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid: one row per kept vector.

    Kept are vectors of exactly ``dims`` components, none null or non-finite, as whole numbers
    floor(64 * x); a component beyond ``LIMIT`` raises an error, as its distances fit no long. The
    first centroids are those of :func:`first_centroids`, fewer than ``k`` if fewer vectors are
    kept. Each round assigns all vectors (ties: smaller number) and moves every non-empty centroid
    to the floor of its vectors' mean; at the end they are assigned once more.

    Repeated rows count each for itself, a null vec_id is kept like any other. No kept vector, or
    an empty table: no rows. Other columns are not read. The driver holds the centroids only.
    """
    kept = materialize(kept_vectors(vectors, dims), "zone-vectors")
    centroids = np.array(first_centroids(kept, k, seed), np.int64).reshape(-1, dims)
    kinds = "vec_id long, cluster int, distance long"
    if not len(centroids):
        none = kept.sparkSession.createDataFrame([], kinds)
        return none.withColumns({"cluster_inertia": F.lit(0).cast("long"), "inertia": F.lit(0).cast("long"),
                                 "centroid": F.array().cast("array<long>")})
    blocks = blocks_of(kept)
    for _ in range(rounds):
        centroids = centroids.copy()
        for r in _totals(blocks, centroids).collect():  # k x dims rows
            centroids[r.cluster, r.dim] = int(r.s) // r.n

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, _, number, distance in _assign(batches, centroids):
            yield pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int32()), pa.array(distance)],
                                             ["vec_id", "cluster", "distance"])

    done = materialize(blocks.mapInArrow(assigned, kinds), "zone-assigned")
    spark = kept.sparkSession
    final = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cluster int, centroid array<long>")
    per = (done.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
           .withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy())).join(final, "cluster"))
    # At most k rows.
    return done.join(F.broadcast(per), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")

