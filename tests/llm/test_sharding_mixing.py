"""Operators 2 and 8 against brute force and their stated invariants."""
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.llm import jobs, mixing, sharding


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Sources by code point, null last; the excess reshared until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(target.values())
        part = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if part[s] > most * sizes[s]}
        if not over:
            return target | part
        for s in over:
            target[s] = most * sizes[s]
        open_ -= over
    return target


@pytest.mark.parametrize("name", ["edges", "docs"])
def test_op2_targets_and_nearness(spark, folder, request, name):
    df = request.getfixturevalue(name)
    rows = df.select("doc_id", "text", "source").collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, largest = Counter(), Counter()
    for r in rows:
        sizes[r.source] += count(r.text)
        largest[r.source] = max(largest[r.source], count(r.text))
    target = brute_targets(sizes)
    at = folder(documents=df)
    got = jobs.op2_source_mixing(spark, at).collect()
    assert sorted((r.doc_id or -1, r["size"]) for r in got) == sorted((r.doc_id or -1, count(r.text)) for r in rows)
    plan = mixing.mix_decisions(spark.read.parquet(f"{at}/documents.parquet")).collect()
    taken = defaultdict(int)
    for r in plan:
        assert abs(r.target - target[r.source]) <= 1e-6 * max(1, target[r.source])
        assert r.source_size == sizes[r.source]
        assert 0 <= r.extra <= r.m
        taken[r.source] += (r.copies * r.m + r.extra) * r["size"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s]
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    again = jobs.op2_source_mixing(spark, at).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_repeats_rows(spark, edges):
    out = mixing.mix(edges)
    assert out.columns == edges.columns
    plan = mixing.mix_decisions(edges)
    assert out.count() == plan.agg(F.sum(F.col("copies") * F.col("m") + F.col("extra"))).first()[0]
    assert mixing.mix(edges.limit(0)).count() == 0


def test_mix_is_unbiased(spark):
    """Over many seeds each document is taken x times on average."""
    df = spark.range(40).selectExpr("id doc_id", "if(id < 20, 'a', 'b') source", "repeat('w ', cast(1 + id % 7 as int)) text")
    x, n = Counter(), 12
    for seed in range(0, 100 * n, 100):
        for r in mixing.mix_decisions(df, weights=[1, 2], share=0.9, seed=seed).collect():
            x[r.doc_id] += (r.copies + r.extra) / n
            want = r.target / r.source_size
            assert int(want) <= r.copies + r.extra <= int(want) + 1
    for r in mixing.mix_decisions(df, weights=[1, 2], share=0.9).collect():
        assert abs(x[r.doc_id] - r.target / r.source_size) < 0.65


def test_repeated_rows_are_taken_one_by_one(spark, folder):
    """A thousand rows of one document, and few of others: the target is missed by one row at most."""
    rows = [(7, "w " * 10, "a")] * 1000 + [(i, "w " * 10, "b") for i in range(480)] + [(3, "w " * 5, "b")] * 7 + [(None, "w", None)] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    sizes, largest = {"a": 10_000, "b": 4835, None: 30}, {"a": 10, "b": 10, None: 1}
    target = brute_targets(sizes)
    at = folder(documents=df)
    taken = Counter()
    for r in jobs.op2_source_mixing(spark, at).collect():
        source = {10_000: "a", 4835: "b", 30: None}[r.source_size]
        taken[source] += r.taken
        assert 0 <= r.taken <= 2 * r["size"]
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)
    out = mixing.mix(spark.read.parquet(f"{at}/documents.parquet")).withColumn("n", mixing.word_count(F.col("text")))
    got = {r.source: r.n for r in out.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    assert got == dict(taken)


@pytest.mark.parametrize("name", ["edges", "docs"])
def test_op8_rows_law(spark, folder, request, name):
    df = request.getfixturevalue(name)
    at = folder(documents=df)
    got = jobs.op8_sharding(spark, at).collect()
    want = sorted((r.doc_id or -1, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode()))
                  for r in df.select("doc_id", "text").collect())
    assert sorted((r.doc_id or -1, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(24))
    n = [len(slots[s]) for s in range(24)]
    assert max(n) - min(n) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sorted(map(str, jobs.op8_sharding(spark, at).collect())) == sorted(map(str, got))


@pytest.mark.parametrize("n", [1, 2, 3, 10, 101, 5000])
def test_permutation_is_a_bijection(spark, n):
    got = [r.p for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 5).alias("p")).collect()]
    assert sorted(got) == list(range(n))
    if n > 100:
        assert sum(abs(a - b) for a, b in zip(got, got[1:])) > n * n / 5  # far from the identity


def test_op8_repeated_rows_and_empty(spark):
    df = spark.range(3000).selectExpr("1L doc_id", "'same' text")
    got = sharding.document_shards(df, 7).collect()
    assert sorted(r.row_no for r in got) == list(range(3000))
    assert sharding.document_shards(df.limit(0), 7).count() == 0


def test_native_plans(spark, docs):
    for df in (mixing.mix(docs), sharding.document_shards(docs, 24)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def spark_hash(*values):
    """xxhash64 of (value, bytes) pairs as Spark chains it: nulls change nothing."""
    import xxhash
    h = 42
    for value, size in values:
        if value is not None:
            h = xxhash.xxh64_intdigest(value.to_bytes(size, "little", signed=True), seed=h)
    return h - (1 << 64) if h >> 63 else h


@pytest.mark.parametrize("bucket_rows", [50_000, 40])
def test_op8_equals_a_plain_permutation(spark, folder, edges, docs, monkeypatch, bucket_rows):
    """Every row's shard and slot, by a Feistel network of its own."""
    import math
    monkeypatch.setattr(sharding, "BUCKET_ROWS", bucket_rows)
    seed = 20_260_101
    for df in (edges, docs):
        raw = [(r.text or "").encode() for r in df.collect()]
        ids = [r.doc_id for r in df.collect()]
        rows = [(i, len(t) + 8, zlib.crc32(t)) for i, t in zip(ids, raw)]
        n = len(rows)
        buckets = max(1, math.ceil(n / bucket_rows))
        order = sorted(rows, key=lambda r: (spark_hash((seed, 4), (r[0], 8), (r[1], 8), (r[2], 8)) % buckets, r[0] is not None, r))
        a = math.isqrt(n - 1) + 1
        b = math.ceil(n / a)

        def once(p):
            x, y = divmod(p, b)
            for k in range(sharding.ROUNDS):
                if k % 2 == 0:
                    x = (x + spark_hash((seed, 8), (k, 4), (y, 8)) % a) % a
                else:
                    y = (y + spark_hash((seed, 8), (k, 4), (x, 8)) % b) % b
            return x * b + y

        want = []
        for p, (i, size, crc) in enumerate(order):
            p = once(p)
            while p >= n:
                p = once(p)
            want.append((i, size, crc, p % 24, p // 24))
        got = [(r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in jobs.op8_sharding(spark, folder(documents=df)).collect()]
        assert Counter(got) == Counter(want)
