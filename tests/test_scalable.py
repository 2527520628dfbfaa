"""Skew-safe building blocks against plain windows / brute force, with one hot key."""

import random

from quarry.operators.scalable import running_sum, sliding_count


def test_sliding_count_brute_force(spark):
    random.seed(3)
    rows = [(("hot" if random.random() < 0.6 else "c%d" % random.randint(0, 5)), random.randint(0, 5000), i)
            for i in range(800)]
    df = spark.createDataFrame(rows, "k string, t long, seq long")
    w = 300
    got = {r.seq: r.n for r in sliding_count(df, ["k"], "t", w, "n", arrival="seq", bucket_micros=700).collect()}
    for k, t, s in rows:
        want = sum(1 for k2, t2, s2 in rows if k2 == k and t - w < t2 <= t and (t2 < t or s2 <= s))
        assert got[s] == want


def test_sliding_count_is_linear_in_plan(spark):
    df = spark.createDataFrame([("a", 1, 1)], "k string, t long, seq long")
    plan = sliding_count(df, ["k"], "t", 60, "n", arrival="seq")._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame" not in plan and "unboundedpreceding$(), currentrow$()" in plan


def test_running_sum_blocks_stay_bounded_for_sparse_orders(spark):
    rows = [("a", i * 1_000_000_007, 1) for i in range(5000)] + [("b", i, 2) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    got = {(r.k, r.o): r.s for r in running_sum(df, ["k"], "o", "v", "s", block=64).collect()}
    assert all(got["a", i * 1_000_000_007] == i + 1 for i in range(5000))
    assert all(got["b", i] == 2 * (i + 1) for i in range(300))
