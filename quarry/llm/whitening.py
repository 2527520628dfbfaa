"""Embedding whitening: principal components of the distinct vectors, each scaled to unit variance.

Three passes over the distinct vectors, each a sum of bounded partial sums: counts and sums,
centred second moments (d x d, however many rows), and the whitened vectors' second moments as a
check. Only the d x d matrix reaches the driver, which takes its largest eigenvalues by FEAST.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import feast
from .common import materialize
from .entries import is_finite, on_grid

#: Largest |c| of an entry: 64 * c + SHIFT is then an exact double and long.
LIMIT = float(1 << 45)
SHIFT = 1_000_000


@dataclass
class Model:
    """The fit of one vector width: list size n, sums S, components (columns) and eigenvalues."""

    dim: int
    n: int
    sums: list[int]
    trace: float = 0.0
    values: np.ndarray = None
    vectors: np.ndarray = None
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: the whole part of the mean is taken off in whole numbers first."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        part = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - part

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n*x - S)^2 per row, exact; None beyond a long."""
        sums = np.array(self.sums, object)
        far = max(int(np.abs(x[:, i] * 1.0 * self.n - float(s)).max()) for i, s in enumerate(self.sums)) + 1
        if self.dim * far ** 2 < 1 << 62 and max(map(abs, self.sums)) < 1 << 61:
            part = self.n * x - sums.astype(np.int64)
            return (part * part).sum(axis=1).tolist()
        part = self.n * x.astype(object) - sums
        exact = [int(v) for v in (part * part).sum(axis=1)]
        return [v if v < 1 << 63 else None for v in exact]


def grid_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, x (array<long>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = vectors.select("vec_id", v.alias("v")).filter(is_finite(F.col("v")) & (F.size("v") > 0))
    return fine.select("vec_id", on_grid(F.col("v"), LIMIT, SHIFT).alias("x"))


def _by_width(batch: pa.RecordBatch, column: str = "x") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Width, row places and matrix of the vectors of each width in a batch."""
    lists = batch.column(batch.schema.get_field_index(column))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    widths = np.diff(lists.offsets.to_numpy())
    starts = np.cumsum(widths) - widths
    for d in np.unique(widths):
        at = np.flatnonzero(widths == d)
        yield int(d), at, flat[starts[at][:, None] + np.arange(d)]


def _moments(rows: DataFrame, models: dict[int, Model], of: str) -> dict[int, np.ndarray]:
    """Per width, the sum over ``rows`` of y y^T for y = ``of`` (a method of Model) of each vector.

    Each task adds up its own rows; tasks' entries are added up by Spark, so what the driver gets
    is one matrix per width, not one per task.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, x in _by_width(b):
                y = getattr(models[d], of)(x)
                total[d] = total.get(d, 0) + y.T @ y
        for d, m in total.items():
            i, j = np.triu_indices(len(m))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), d), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(m[i, j])],
                ["dim", "i", "j", "s"])

    sums = rows.mapInArrow(partial, "dim int, i int, j int, s double").groupBy("dim", "i", "j").agg(F.sum("s").alias("s"))
    out: dict[int, np.ndarray] = {}
    for r in sums.collect():
        size = models[r.dim].dim if of == "centred" else len(models[r.dim].values)
        m = out.setdefault(r.dim, np.zeros((size, size)))
        m[r.i, r.j] = m[r.j, r.i] = r.s
    return out


def fit(distinct: DataFrame, components: int) -> dict[int, Model]:
    """A model per vector width, from the distinct vectors (column x)."""
    exact = F.sum(F.col("e").cast("decimal(38,0)"))
    sums = (distinct.select(F.size("x").alias("dim"), F.posexplode("x").alias("i", "e"))
            .groupBy("dim", "i").agg(exact.alias("s"), F.count(F.lit(1)).alias("n")).orderBy("dim", "i"))
    models: dict[int, Model] = {}
    for r in sums.collect():
        models.setdefault(r.dim, Model(r.dim, r.n, [])).sums.append(int(r.s))
    for d, m in _moments(distinct, models, "centred").items():
        cov = m / models[d].n
        models[d].trace = float(np.trace(cov))
        models[d].values, models[d].vectors = feast.largest(cov, components)
    for d, m in _moments(distinct, models, "whitened").items():
        models[d].identity_error = float(np.abs(m / models[d].n - np.eye(len(m))).max())
    return models


def whiten(vectors: DataFrame, components: int = 16) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty or holds null or non-finite entries are dropped; the entries c
    left are taken as x = floor(64 * c) + 1000000. The fit list is each distinct vector x once, so
    copies, however many, don't bend the axes; every row, copies and null ids too, gets its
    components, numbered from 1 by falling eigenvalue. Vectors of different widths can't share a
    covariance: each width is fitted for itself. Components of no variance (eigenvalue zero up to
    rounding: constant or collinear vectors, a single vector) have no scale and no rows.
    ``deviation`` is null where the exact sum doesn't fit a long; an entry beyond 2^45 raises an
    error. Empty table: no rows. Other columns are not read.

    The driver holds a d x d matrix per width. Eigenvectors have their largest entry positive.
    """
    rows = materialize(grid_vectors(vectors), "white-rows")
    # Equal vectors meet after they were made distinct in each task.
    distinct = materialize(rows.select("x").distinct(), "white-distinct")
    models = fit(distinct, components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for d, at, x in _by_width(b):
                m = models[d]
                k = len(m.values)
                if not k:
                    continue
                times = np.repeat(np.arange(len(at)), k)
                deviation = m.deviation(x)
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(at[times])), pa.array(np.tile(np.arange(1, k + 1), len(at)), pa.int32()),
                    pa.array(np.full(len(times), m.n), pa.int64()), pa.array([deviation[i] for i in times], pa.int64()),
                    pa.array(m.whitened(x).ravel()), pa.array(np.tile(m.values / m.trace, len(at))),
                    pa.array(np.full(len(times), m.identity_error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, "
                                "explained double, identity_error double")
