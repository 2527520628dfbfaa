"""Skew-safe building blocks for ordered computations over possibly huge keys.

A plain ``Window.partitionBy(key)`` puts every row of a key in one task. When one key
can hold a third of all rows (one giant repository, one bot client), these helpers
split the ordered work into bounded pieces:

* ``running_sum``   — prefix sums in two levels: per-block totals (a partial aggregate),
  a window over block totals (rows per key = n / block), and a window inside each
  (key, block) pair (at most ``block`` order values).
* ``sliding_count`` — trailing time-window counts on time buckets: each row is counted
  in its own bucket and copied into the next bucket when it falls in that bucket's
  look-back halo, so a window partition is (key, bucket), never a whole key.

Both use frames from the partition's start to the row only: one pass, no moving frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, keys: list[str], order_col: str, value: Column | str, out_col: str,
                tiebreak: list[str] | None = None, block: int = 4096) -> DataFrame:
    """``out_col`` = sum of ``value`` over rows of the same key with a smaller-or-equal
    ``(order_col, *tiebreak)``; ``order_col`` must be integral (ids, sequence numbers,
    epoch micros). Equivalent to ``sum(value) OVER (PARTITION BY keys ORDER BY order,
    tiebreak ROWS UNBOUNDED PRECEDING)``.

    A key's span of order values is cut into as many equal blocks as ``block`` rows each would
    make, so sparse values (epoch micros) give no more blocks than dense ones. Keys must not be
    null."""
    v = F.col(value) if isinstance(value, str) else value
    tb = tiebreak or []
    span = df.groupBy(*keys).agg(F.min(order_col).alias("_rs_min"), F.max(order_col).alias("_rs_max"),
                                 F.count(F.lit(1)).alias("_rs_n"))
    wide = F.ceil((F.col("_rs_max") - F.col("_rs_min") + 1) / F.ceil(F.col("_rs_n") / F.lit(block)))
    span = span.select(*keys, "_rs_min", F.greatest(wide, F.lit(1).cast("long")).alias("_rs_wide"))
    x = (df.withColumn("_rs_v", v.cast("bigint")).join(span, keys)
         .withColumn("_rs_blk", F.floor((F.col(order_col) - F.col("_rs_min")) / F.col("_rs_wide")))
         .drop("_rs_min", "_rs_wide"))
    totals = x.groupBy(*keys, "_rs_blk").agg(F.sum("_rs_v").alias("_rs_bsum"))
    wb = Window.partitionBy(*keys).orderBy("_rs_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_rs_boff", F.coalesce(F.sum("_rs_bsum").over(wb), F.lit(0))).drop("_rs_bsum")
    wi = Window.partitionBy(*keys, "_rs_blk").orderBy(order_col, *tb).rowsBetween(Window.unboundedPreceding, 0)
    inner = x.withColumn("_rs_wsum", F.sum("_rs_v").over(wi))
    return (inner.join(offsets, [*keys, "_rs_blk"], "inner")
            .withColumn(out_col, F.col("_rs_boff") + F.col("_rs_wsum"))
            .drop("_rs_v", "_rs_blk", "_rs_boff", "_rs_wsum"))


def sliding_count(df: DataFrame, keys: list[str], ts_micros: str, window_micros: int, out_col: str,
                  arrival: str, bucket_micros: int | None = None) -> DataFrame:
    """Count, for every row, the rows of its key with ``t > t_row - window`` that arrived
    no later than it (same timestamp: by ``arrival``), itself included.

    Rows are bucketed by ``floor(t / bucket)``; a row within ``window`` of the next
    bucket start is copied there as a non-output halo row, so each (key, bucket)
    partition holds everything its rows can see. Each row is two marks, +1 at its time and -1
    where it leaves the window; the count is one running sum over the marks, so the work is
    linear in the rows however many share a window.
    """
    b = bucket_micros or max(10 * window_micros, 3_600_000_000)
    if b < window_micros:
        raise ValueError("bucket must be at least the window")
    t = F.col(ts_micros)
    bucket = F.floor(t / F.lit(b))
    halo = (t >= (bucket + 1) * F.lit(b) - F.lit(window_micros))
    places = F.array(F.struct(bucket.alias("b"), F.lit(True).alias("own")),
                     F.struct((bucket + 1).alias("b"), F.lit(False).alias("own")))
    x = df.withColumn("_sc", F.explode(F.when(halo, places).otherwise(F.slice(places, 1, 1))))
    marks = F.array(F.struct(t.alias("at"), F.lit(1).alias("step")),
                    F.struct((t + F.lit(window_micros)).alias("at"), F.lit(-1).alias("step")))
    # A row of the window's far edge has left before one that arrives there is counted.
    order = Window.partitionBy(*keys, "_sc.b").orderBy("_sc_m.at", "_sc_m.step", arrival).rowsBetween(
        Window.unboundedPreceding, 0)
    return (x.withColumn("_sc_m", F.explode(marks)).withColumn(out_col, F.sum("_sc_m.step").over(order))
            .filter("_sc.own AND _sc_m.step = 1").drop("_sc", "_sc_m"))
