"""Operators 12 and 13 against brute force."""
import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from quarry.llm import feast, jobs, whitening, zone_clustering

SCHEMA = "vec_id long, embedding array<double>, v int, id string, cluster string, x int, n string"


def fine(x):
    return x is not None and all(c is not None and math.isfinite(c) for c in x)


def brute_clusters(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * c) for c in x]) for i, x in rows if fine(x) and len(x) == 64]
    order = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    cents = [list(x) for _, x in sorted(kept, key=order)[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        at = [near(x)[1] for _, x in kept]
        for j in range(len(cents)):
            own = [x for (_, x), a in zip(kept, at) if a == j]
            if own:
                cents[j] = [sum(col) // len(own) for col in zip(*own)]
    out = [(i, *near(x)[::-1]) for i, x in kept]
    per = Counter()
    for _, c, d in out:
        per[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return Counter((i, c, d, per[c], sum(per.values()), sha[c]) for i, c, d in out)


def rows_of(df):
    return [(r.vec_id, r.embedding) for r in df.collect()]


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 64)) * 3
    rows = [(i, (centres[i % 6] + rng.normal(size=64) * .1).tolist()) for i in range(1, 200)]
    rows += [(i, [0.5] * 64) for i in range(200, 500)]  # one common vector
    rows += [(i, centres[0].tolist()) for i in (7, 7, 7)] + [(None, centres[1].tolist()), (None, [0.25] * 64)]
    rows += [(600, None), (601, []), (602, [1.0] * 63), (603, [1.0] * 63 + [None]), (604, [float("nan")] * 64),
             (605, [float("inf")] + [0.0] * 63), (606, [1.0, 2.0]), (607, [3e2] * 64), (608, [-3e2] * 64), (609, [-0.0] * 64)]
    return spark.createDataFrame([(i, x, 1, "a", "b", 2, "c") for i, x in rows], SCHEMA)


@pytest.mark.parametrize("name", ["odd", "sf0.01"])
def test_op12_equals_brute_force(spark, folder, odd, name):
    df = odd if name == "odd" else spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = Counter(tuple(r) for r in jobs.op12_centroids(spark, folder(embeddings=df)).collect())
    assert got == brute_clusters(rows_of(df))


def test_op12_few_empty_and_beyond(spark, odd):
    few = spark.createDataFrame([(1, [1.0] * 64), (2, [1.0] * 64), (3, [9.0] * 64)], "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.distance, r.inertia) for r in zone_clustering.cluster(few).collect()}
    assert got == {1: (0, 0), 2: (0, 0), 3: (0, 0)}
    assert zone_clustering.cluster(odd.limit(0)).count() == 0
    assert zone_clustering.cluster(odd.filter("vec_id in (600, 602)")).count() == 0
    far = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        zone_clustering.cluster(far).count()


def test_hilbert_neighbours():
    """Every cell of the grid has its own place, and cells next to each other on the curve differ by one step."""
    for dims, bits in ((2, 4), (3, 3), (5, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        keys = zone_clustering.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        walk = cells[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_candidates_hold_the_nearest():
    rng = np.random.default_rng(5)
    for width in (1, 20, 200):
        cut = 0
        for _ in range(100):
            c = rng.integers(-100, 100, (16, 8))
            x = rng.integers(-100, 100, 8) + rng.integers(-width, width + 1, (50, 8))
            some = zone_clustering.candidates(x.min(axis=0), x.max(axis=0), c)
            d = ((x[:, None, :] - c) ** 2).sum(axis=2)
            assert set(np.nonzero(d == d.min(axis=1)[:, None])[1]) <= set(some.tolist())
            at, dist = zone_clustering.nearest(x, c, some)
            assert (at == d.argmin(axis=1)).all() and (dist == d.min(axis=1)).all()
            cut += 16 - len(some)
        assert cut > 0 or width == 200


def test_large_components_use_whole_numbers():
    rng = np.random.default_rng(6)
    x, c = rng.integers(-(1 << 27), 1 << 27, (20, 64)), rng.integers(-(1 << 27), 1 << 27, (5, 64))
    at, dist = zone_clustering.nearest(x, c, np.arange(5))
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, w)), j) for j, w in enumerate(c)) for v in x]
    assert [(int(d), int(j)) for d, j in zip(dist, at)] == want


# --- operator 13

def brute_white(rows, most=16):
    """Per width: n, S, eigenvalues, eigenvectors (numpy's own solver) and the rows that take part."""
    by = {}
    for i, x in rows:
        if fine(x) and x:
            by.setdefault(len(x), []).append((i, [math.floor(64 * c) + 1_000_000 for c in x]))
    out = {}
    for d, some in by.items():
        fit = np.array(sorted({tuple(x) for _, x in some}), np.int64)
        n, s = len(fit), fit.sum(axis=0)
        y = fit - s / n
        cov = y.T @ y / n
        e, u = np.linalg.eigh(cov)
        e, u = e[::-1], u[:, ::-1]
        k = int((e[:most] > 1e-9 * max(e[0], 1e-300)).sum()) if n > 1 else 0
        out[d] = (some, n, s, e, u, k, np.trace(cov))
    return out


def check_white(rows, got):
    want = brute_white(rows)
    n_rows = 0
    for d, (some, n, s, e, u, k, trace) in want.items():
        n_rows += len(some) * k
        mine = [r for r in got if r.n == n and r.component <= k] if len(want) > 1 else got
        white = {}
        for r in mine:
            assert r.n == n and abs(r.explained - e[r.component - 1] / trace) <= 1e-9 * r.explained
            assert r.identity_error <= 1e-7
            white.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
        for i, x in some:
            if not k:
                continue
            exact = sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, s))
            assert exact in [r.deviation for r in white[i][1]]
        gap = np.abs(e[:k, None] - e[None, :]) + np.where(np.eye(k, len(e)) > 0, np.inf, 0)
        for c in range(k):  # equal eigenvalues share a space: only single ones have a direction
            if gap[c].min() <= 1e-6 * e[0]:
                continue
            a = np.array([(np.array(x) - s / n) @ u[:, c] / math.sqrt(e[c]) for _, x in some])
            by_id = Counter(i for i, _ in some)
            once = [j for j, (i, _) in enumerate(some) if by_id[i] == 1]
            b = np.array([white[some[j][0]][c + 1][0].whitened for j in once])
            a = a[once]
            assert min(np.abs(a - b).max(), np.abs(a + b).max()) <= 1e-6 * max(1, np.abs(a).max())
    assert len(got) == n_rows


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_op13_equals_dense_solver(spark, sf):
    at = f"/root/testdata/{sf}"
    got = jobs.op13_whitening(spark, at).collect()
    assert got[0]["component"] >= 1 and {r.component for r in got} == set(range(1, 17))
    check_white(rows_of(spark.read.parquet(f"{at}/embeddings.parquet")), got)


def test_op13_odd_rows(spark, folder, odd):
    plain = odd.filter("size(embedding) = 64 or embedding is null")
    check_white(rows_of(plain), jobs.op13_whitening(spark, folder(embeddings=plain)).collect())
    got = whitening.whiten(odd).collect()  # widths 63 (one vector) and 2 (one vector) have no variance
    assert Counter(r.vec_id for r in got) == Counter(r.vec_id for r in whitening.whiten(plain).collect())
    assert whitening.whiten(odd.limit(0)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(9)], "vec_id long, embedding array<float>")
    assert whitening.whiten(same).count() == 0
    line = spark.createDataFrame([(i, [i * 1.0, i * 2.0, 5.0]) for i in range(9)] + [(3, [3.0, 6.0, 5.0])] * 20,
                                 "vec_id int, embedding array<float>")
    got = whitening.whiten(line).collect()
    assert {r.component for r in got} == {1} and len(got) == 29 and got[0].n == 9
    check_white(rows_of(line), got)


def test_deviation_beyond_long_is_null():
    m = whitening.Model(2, 10, [0, 0])
    x = np.array([[1, 2], [1 << 40, 0]])
    assert m.deviation(x) == [500, None]


def test_feast_against_dense_solver():
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.normal(size=(40, 40)))
    cases = [rng.normal(size=(30, d)) for d in (1, 2, 5, 40)]
    cases = [x.T @ x for x in cases] + [np.eye(20), np.diag([5.0] * 12 + [1.0] * 12), (q * 10.0 ** -np.arange(40)) @ q.T,
                                        (q * (1 + 1e-10 * np.arange(40))) @ q.T, np.ones((6, 6)), np.diag([2.0, 0, 0])]
    for a in cases:
        for most in (1, 3, 16):
            v, w = feast.largest(a, most)
            e = np.linalg.eigvalsh(a)[::-1]
            assert len(v) == min(most, int((e > 1e-13 * e[0]).sum())) or e[len(v)] < 1e-12 * e[0]
            assert np.abs(v - e[:len(v)]).max() <= 1e-12 * e[0]
            assert np.abs(w.T @ w - np.eye(len(v))).max() <= 1e-12
            assert np.abs(a @ w - w * v).max() <= 1e-11 * e[0]
    assert len(feast.largest(np.zeros((3, 3)), 16)[0]) == 0


def test_inertia_counts():
    rng = np.random.default_rng(1)
    for _ in range(200):
        b = rng.normal(size=(12, 12))
        b = b + b.T
        if rng.random() < 0.5:
            np.fill_diagonal(b, 0)
        assert feast.negative_pivots(b) == (np.linalg.eigvalsh(b) < 0).sum()
