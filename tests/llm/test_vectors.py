"""Operators 5 and 6 against brute force."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import jobs
from quarry.llm.collision_ann import nearest
from quarry.llm.exact_topk import top_inner_products

SCHEMA = "vec_id long, embedding array<float>, label string, v int, id string, shard int"


def brute(rows, modulus, k, exact):
    fine = {}
    for i, x in rows:
        if i is None or not x or any(c is None or not math.isfinite(c) for c in x):
            continue
        x = np.array(x, np.float64)
        x = np.floor(256 * x) if exact else x
        if exact or x.any():
            fine.setdefault(i, []).append(x)
    out = {}
    for q, vs in fine.items():
        if q % modulus == 0:
            found = {(-(v * x).sum(), i) for v in vs for i, xs in fine.items() if i != q for x in xs if len(x) == len(v)}
            out[q] = [(i, -s) for s, i in sorted(found)[:k]]
    return out


def table_of(got):
    out = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).astype(float).tolist()) for i in range(1, 200)]
    rows += [(i, [0.5] * 6) for i in range(200, 420)]  # one common vector
    rows += [(1000, [0.0] * 6), (1050, None), (1100, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1150, [float("nan")] * 6), (None, [1.0] * 6),
             (1200, [float("inf")] + [0.0] * 5), (1250, []), (1300, [1.0, 2.0]), (1301, [2.0, 1.0]), (100, [9.0] * 6), (7, rows[6][1])]
    return spark.createDataFrame([(i, x, "a", 1, "b", 2) for i, x in rows], SCHEMA)


def rows_of(df):
    return [(r.vec_id, r.embedding) for r in df.collect()]


def test_op6_equals_brute_force(spark, folder, odd):
    for df in (odd, spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")):
        got = table_of(jobs.op6_exact_topk(spark, folder(embeddings=df)).collect())
        want = {q: [(i, int(s)) for i, s in v] for q, v in brute(rows_of(df), 50, 5, True).items() if v}
        assert got == want


def test_op6_many_shards(spark, monkeypatch):
    from quarry.llm import vectors

    monkeypatch.setattr(vectors, "SHARD_ROWS", 100)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 4)
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = table_of(top_inner_products(df, F.col("vec_id") % 20 == 0, 7).collect())
    assert got == {q: [(i, int(s)) for i, s in v] for q, v in brute(rows_of(df), 20, 7, True).items()}


def test_op6_large_components(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, (rng.normal(size=4) * 4e5).tolist()) for i in range(120)], "vec_id long, embedding array<double>")
    got = table_of(top_inner_products(df, F.col("vec_id") % 50 == 0, 5).collect())
    fine = {i: [int(math.floor(256 * c)) for c in x] for i, x in rows_of(df)}
    for q, found in got.items():
        want = sorted((-sum(a * b for a, b in zip(fine[q], x)), i) for i, x in fine.items() if i != q)[:5]
        assert found == [(i, -s) for s, i in want]


def recall(got, want, k):
    hit = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in v}) for q, v in want.items())
    return hit / sum(map(len, want.values()))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_op5_recall(spark, sf):
    at = f"/root/testdata/{sf}"
    df = spark.read.parquet(f"{at}/embeddings.parquet")
    got, want = table_of(jobs.op5_ann(spark, at).collect()), brute(rows_of(df), 20, 20, False)
    assert {q: len(v) for q, v in got.items()} == {q: len(v) for q, v in want.items()}
    assert recall(got, want, 20) >= 0.9
    vec = {i: np.array(x, np.float64) for i, x in rows_of(df)}
    for q, found in got.items():
        assert all(math.isclose(s, float((vec[q] * vec[i]).sum()), rel_tol=1e-12, abs_tol=1e-15) for i, s in found)


def test_op5_odd_rows(spark, folder, odd):
    got = table_of(jobs.op5_ann(spark, folder(embeddings=odd)).collect())
    want = brute(rows_of(odd), 20, 20, False)
    assert set(got) == {q for q, v in want.items() if v}
    assert recall(got, {q: v for q, v in want.items() if v}, 20) >= 0.9
    for found in got.values():
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))


def test_empty_and_few(spark, odd):
    for f in (nearest, top_inner_products):
        assert f(odd.limit(0), F.col("vec_id") % 20 == 0, 5).count() == 0
        few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<double>")
        assert [tuple(r)[:3] for r in f(few, F.col("vec_id") == 0, 5).collect()] == [(0, 1, 1)]
