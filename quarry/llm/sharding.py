"""Sharding by a keyed permutation of global row numbers (DataFrame functions only).

Every row gets a global row number 0..N-1; a Feistel network over the grid a x b >= N with
cycle walking permutes these numbers, and the permuted number p gives shard p mod n and slot
p div n. Shard sizes are at most one apart, slots have no gaps, and both can be computed from
the row number alone, without a table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Rows of one numbering bucket, on average. Only the bucket totals meet in one task.
BUCKET_ROWS = 50_000
#: Alternating rounds of the network.
ROUNDS = 6
#: Steps of the cycle walk. Fewer than ceil(sqrt(N)) points of the grid lie outside 0..N-1, so
#: up to N = 4096 no walk can be longer; above, one is with a chance below 64 ** -64, and it
#: raises an error.
WALK = 64


def number_rows(rows: DataFrame, by: list[str], seed: int, name: str = "row_no") -> DataFrame:
    """``by`` and a gapless global row number, one output row per input row.

    Equal rows are counted before the shuffle and unfolded after it, so a row that repeats a
    million times is one counter. Buckets are hash classes of the row's own values: running
    again gives the same numbers, whatever the partitioning.
    """
    total = rows.count()
    buckets = max(1, math.ceil(total / BUCKET_ROWS))
    units = (rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_m"))
             .withColumn("_b", F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(buckets))))
    units = materialize(units, "row-units")
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (units.groupBy("_b").agg(F.sum("_m").alias("_t"))
               .select("_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o")))
    inside = Window.partitionBy("_b").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    placed = units.withColumn("_s", F.coalesce(F.sum("_m").over(inside), F.lit(0))).join(offsets, "_b")
    return (placed.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1)))
            .select(*by, (F.col("_o") + F.col("_s") + F.col("_i")).alias(name)))


def quotient(p: Column, n: Column) -> Column:
    """Integer quotient of a non-negative long."""
    return F.call_function("div", p, n)


def permuted(row_no: Column, total: int, seed: int) -> Column:
    """The keyed permutation of 0..total-1 at ``row_no``."""
    a = math.isqrt(max(total, 1) - 1) + 1
    b = math.ceil(max(total, 1) / a)
    A, B = F.lit(a).cast("long"), F.lit(b).cast("long")

    def turn(s, r):
        key = F.xxhash64(F.lit(seed).cast("long"), r, F.when(r % 2 == 0, s["y"]).otherwise(s["x"]))
        return F.struct(
            F.when(r % 2 == 0, F.pmod(s["x"] + F.pmod(key, A), A)).otherwise(s["x"]).alias("x"),
            F.when(r % 2 == 1, F.pmod(s["y"] + F.pmod(key, B), B)).otherwise(s["y"]).alias("y"))

    def once(p):
        start = F.struct(quotient(p, B).alias("x"),
                         F.pmod(p, B).alias("y"))
        return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), start, turn,
                           lambda s: s["x"] * B + s["y"])

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(row_no.cast("long")),
                         lambda p, _: F.when(p < total, p).otherwise(once(p)))
    return F.when(walked < total, walked).otherwise(
        F.raise_error(F.lit("cycle walk did not return; use another seed")).cast("long"))


def shard_rows(rows: DataFrame, by: list[str], shards: int, seed: int = 20_260_101) -> DataFrame:
    """``by``, ``row_no``, ``shard`` (int) and ``slot`` (long) for each row of ``rows``.

    ``by`` names the columns that identify a row; nulls in them are values like any other, and
    rows equal in all of them are interchangeable. An empty table gives an empty result. Other
    columns are not read. Same rows, seed and shard count: same result.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    numbered = number_rows(rows.select(*by), by, seed)
    total = rows.count()
    p = permuted(F.col("row_no"), total, seed)
    return (numbered.withColumn("_p", p)
            .select(*by, "row_no", F.pmod(F.col("_p"), F.lit(shards)).cast("int").alias("shard"),
                    quotient(F.col("_p"), F.lit(shards)).alias("slot")))


def document_shards(docs: DataFrame, shards: int, seed: int = 20_260_101) -> DataFrame:
    """Shards of documents, identified by doc_id, size and the text's crc32.

    ``size`` is the UTF-8 length plus 8; a null text counts as empty (size 8, crc32 0).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"))
    return shard_rows(rows, ["doc_id", "size", "text_crc32"], shards, seed)
