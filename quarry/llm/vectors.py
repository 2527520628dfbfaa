"""Vector tables as shards of numpy arrays, and a search of query blocks against every shard.

Vectors are dealt to shards of bounded size by a hash of their id, queries to blocks of bounded
size. A task holds the index of one shard and lets the query blocks pass: the stated query set
meets all rows, in blocks, and neither side is ever whole in one place.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, materialize

#: Vectors of a shard and queries of a block, on average.
SHARD_ROWS = 8192
BLOCK_ROWS = 512
_PACKED = "dim int, shard int, kind int, block int, ids binary, data binary, bound binary"


def finite(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id (long) and v (array<double>) of the rows that take part: no null id or vector, no empty
    vector, no null or non-finite component."""
    v = F.col(vec_col).cast("array<double>")
    fine: Callable[[Column], Column] = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return (vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
            .filter(F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", fine)))


def _pack(kind: int):
    """Rows of a group as one row of arrays, in id order."""

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        flat = group.column("v").combine_chunks()
        data = flat.values.to_numpy(zero_copy_only=False)[flat.offsets[0].as_py():flat.offsets[-1].as_py()]
        one = lambda c: group.column(c)[0].as_py() if c in group.schema.names else -1
        bound = group.column("bound").to_numpy() if "bound" in group.schema.names else np.zeros(0)
        return pa.table({
            "dim": pa.array([one("dim")], pa.int32()), "shard": pa.array([one("shard")], pa.int32()),
            "kind": pa.array([kind], pa.int32()), "block": pa.array([one("block")], pa.int32()),
            "ids": pa.array([group.column("id").to_numpy().tobytes()]),
            "data": pa.array([np.ascontiguousarray(data).tobytes()]), "bound": pa.array([bound.tobytes()])})

    return pack


def shards_of(vectors: DataFrame) -> tuple[DataFrame, int]:
    """Packed shards of ``vectors`` (id, v), and how many shards a dimension has."""
    n = max(1, math.ceil(vectors.count() / SHARD_ROWS))
    dealt = vectors.select("id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("shard"))
    return materialize(dealt.groupBy("dim", "shard").applyInArrow(_pack(0), _PACKED), "vector-shards"), n


def blocks_of(queries: DataFrame, total: int) -> DataFrame:
    """Packed blocks of ``queries`` (id, v and maybe bound), ``total`` in number."""
    n = max(1, math.ceil(total / BLOCK_ROWS))
    dealt = queries.select("*", F.size("v").alias("dim"), F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(n)).cast("int").alias("block"))
    return dealt.groupBy("dim", "block").applyInArrow(_pack(1), _PACKED)


def search(shards: DataFrame, blocks: DataFrame, n_shards: int, index: Callable, k: int, score: str) -> DataFrame:
    """query_id, vec_id, score: the ``k`` best of each shard for each query of a block.

    ``blocks`` names the shard each copy goes to. ``index(ids, matrix)`` builds a shard's index;
    its ``best(ids, matrix, bound, k)`` gives arrays (place of the query, vec_id, score).
    """
    bound_batches(shards.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, of = None, None
        for b in batches:
            for r in b.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                data = np.frombuffer(r["data"]).reshape(len(ids), r["dim"])
                if r["kind"] == 0:
                    own, of = index(ids, data), (r["dim"], r["shard"])
                elif of == (r["dim"], r["shard"]):  # else this shard has no vectors of the dimension
                    bound = np.frombuffer(r["bound"]) if r["bound"] else np.full(len(ids), -np.inf)
                    at, vec, value = own.best(ids, data, bound, k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(vec), pa.array(value)],
                                                     ["query_id", "vec_id", "score"])

    rows = shards.unionByName(blocks)
    dealt = rows.repartition(4 * n_shards, "dim", "shard").sortWithinPartitions("dim", "shard", "kind", "block")
    return dealt.mapInArrow(run, f"query_id long, vec_id long, score {score}")


def to_shards(blocks: DataFrame, shards: Column) -> DataFrame:
    """Each block once for every shard number in the array ``shards``."""
    return blocks.withColumn("shard", F.explode(shards.cast("array<int>")))


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query over all shards: query_id, rank, vec_id, score."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, ties to the smaller id."""
    if len(ids) > 4 * k:
        limit = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= limit)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]
