"""Operators 9 and 10 against brute force."""
import hashlib
import random

import numpy as np
import pytest
import xxhash

from quarry.llm import components, jobs, simhash, suffix_dedup


def brute_repeats(rows):
    """rows: (doc_id, text); every 100-byte string looked up in a dictionary."""
    first, out = {}, []
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, t in order:
        b = (t or "").encode()
        for p in range(len(b) - 99):
            at = (-(1 << 63) if i is None else i, p)
            key = b[p:p + 100]
            first[key] = min(first.get(key, at), at)
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if first[b[p:p + 100]] < (-(1 << 63) if i is None else i, p):
                gone[p:p + 100] = True
        edge = np.diff(np.concatenate([[0], gone.astype(int)]))
        out.append((i, len(b), int(gone.sum()), int((edge == 1).sum()),
                    hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def passages():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdéfgh") for _ in range(rng.randint(2, 8)))
    shared = [" ".join(word() for _ in range(rng.randint(15, 60))) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts.append(rng.choice(shared) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(1, 60))))
        text = rng.choice([" ", "", "\n"]).join(parts)
        rows.append((rng.randint(0, 10 ** 12), text))
        if rng.random() < 0.2:
            rows.append((rng.randint(0, 10 ** 12), text[rng.randint(0, 20):]))
    rows += [(3, "a" * 1000), (4, "ab" * 600), (5, "a" * 99), (6, "a" * 100), (7, "x" * 99 + "y"), (8, "x" * 99 + "yx"),
             (None, "a" * 150), (9, None), (10, ""), (11, "long text " * 3000), (12, "same row " * 20), (12, "same row " * 20),
             (12, "other text of the same id " * 20)]
    return rows


def spark_repeats(spark, folder, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return sorted((tuple(r) for r in jobs.op9_suffix_dedup(spark, folder(documents=df)).collect()), key=str)


def test_op9_equals_brute_force(spark, folder):
    rows = passages()
    assert spark_repeats(spark, folder, rows) == brute_repeats(rows)


def test_op9_on_documents_and_edges(spark, folder, docs, edges):
    for df in (docs, edges):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        assert spark_repeats(spark, folder, rows) == brute_repeats(rows)


def test_op9_hot_text_over_many_buckets(spark, folder):
    rng = random.Random(1)
    text = " ".join(str(rng.random()) for _ in range(30))
    rows = [(i, text if i % 3 else text[:200] + str(rng.random()) + text[180:]) for i in range(400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert spark_repeats(spark, folder, rows) == brute_repeats(rows)
    finally:
        spark.conf.unset("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_op9_hot_second_tokens(spark, folder, monkeypatch):
    """With a low limit every shared second token takes the way of the hot ones."""
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    rows = passages()
    assert spark_repeats(spark, folder, rows) == brute_repeats(rows)


def colliding_pair():
    """Two texts of 100 bytes, alike from byte 16 on, whose first grams have the same hash."""
    odd = [int(x) for x in suffix_dedup._ODD]
    full = (1 << 64) - 1
    rng = random.Random(3)
    letters = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789.,-"

    def half(w):  # what a word adds before the next one is added
        h = w * odd[0] & full
        return h ^ h >> 31

    a = bytes(rng.choice(letters) for _ in range(16))
    want = half(int.from_bytes(a[:8], "little")) + int.from_bytes(a[8:], "little") * odd[1]
    inverse = pow(odd[1], -1, 1 << 64)
    while True:
        w = bytes(rng.choice(letters) for _ in range(8))
        rest = ((want - half(int.from_bytes(w, "little"))) * inverse & full).to_bytes(8, "little")
        if all(32 <= c < 127 for c in rest):
            tail = bytes(rng.choice(letters) for _ in range(84))
            return (a + tail).decode(), (w + rest + tail).decode()


def test_op9_colliding_hashes_remove_nothing(spark, folder):
    a, b = colliding_pair()
    pad = bytes(200)
    hashes = [suffix_dedup._gram_hashes(x.encode() + pad, 1)[0] for x in (a, b)]
    assert a != b and hashes[0] == hashes[1]
    rows = [(1, a), (2, b), (3, a + b), (4, "x" + b), (5, a[1:] + "y")]
    assert spark_repeats(spark, folder, rows) == brute_repeats(rows)


@pytest.mark.parametrize("runs,hot", [(40, 4096), (7, 2)])
def test_op9_many_buckets(spark, folder, monkeypatch, docs, runs, hot):
    """Buckets of a few runs: tokens, texts and their first runs span bucket boundaries."""
    monkeypatch.setattr(suffix_dedup, "BUCKET_RUNS", runs)
    monkeypatch.setattr(suffix_dedup, "MOST_BUCKETS", 64)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(300))
    rows = passages() + [(2 * 10 ** 12 + i, f"{i} {passage[:150 + i % 100]} {i * i}") for i in range(200)]
    assert spark_repeats(spark, folder, rows) == brute_repeats(rows)


def test_bucket_of_compares_all_columns():
    rng = np.random.default_rng(2)
    for top in (2, 5, 50):
        cuts = np.unique(rng.integers(0, top, (20, 4)), axis=0)
        rows = rng.integers(0, top, (300, 4))
        got = suffix_dedup.bucket_of(list(cuts.T), list(rows.T))
        assert got.tolist() == [sum(tuple(c) <= tuple(r) for c in cuts) for r in rows]


def test_op9_keeps_columns(spark, edges):
    out = suffix_dedup.without_repeats(edges)
    assert out.columns == edges.columns and out.count() == edges.count()
    assert suffix_dedup.without_repeats(edges.limit(0)).count() == 0


def test_multikey_classes():
    rng = np.random.default_rng(0)
    key = rng.integers(0, 3, 500).astype(np.uint64)
    a, b = rng.integers(0, 3, 500).astype(np.uint64), rng.integers(0, 3, 500).astype(np.uint64)
    got = suffix_dedup.multikey_order([lambda s: a[s], lambda s: b[s]], key)
    want = np.unique(np.stack([key, a, b], 1), axis=0, return_inverse=True)[1].ravel()
    assert (got - 1 == want).all()


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(rows, bits=4):
    prints = [brute_print(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            comp[i] = comp[comp[i]]
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                comp[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, f"{prints[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("name", ["edges", "docs"])
def test_op10_equals_brute_force(spark, folder, request, name):
    df = request.getfixturevalue(name).select("doc_id", "text")
    rows = [tuple(r) for r in df.collect()]
    got = sorted((tuple(r) for r in jobs.op10_simhash(spark, folder(documents=df)).collect()), key=str)
    assert got == brute_components(rows)


def test_op10_long_text():
    text = " ".join(str(i * i % 977) for i in range(70_000))
    assert simhash.fingerprint(text) == brute_print(text)


@pytest.mark.parametrize("bits", [0, 1, 4])
def test_links_connect_what_brute_force_connects(spark, bits):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    codes = set(base.tolist())
    for b in base[:10]:  # dense clusters, chains included
        for _ in range(60):
            x = int(b)
            for k in rng.integers(0, 64, rng.integers(1, 7)):
                x ^= 1 << int(k)
            codes.add(x)
    signed = [(c - (1 << 64) if c >> 63 else c,) for c in codes]
    df = spark.createDataFrame(signed, "fp long").repartition(4)
    got = {r.node: r.root for r in components.components(simhash.link_edges(df, bits)).collect()}
    codes = sorted(codes)
    comp = {c: c for c in codes}

    def find(c):
        while comp[c] != c:
            c = comp[c]
        return c

    for i, a in enumerate(codes):
        for b in codes[:i]:
            if (a ^ b).bit_count() <= bits:
                comp[find(a)] = find(b)
    s = lambda c: c - (1 << 64) if c >> 63 else c
    groups = {}
    for c in codes:
        groups.setdefault(find(c), []).append(s(c))
    for g in groups.values():
        assert {got.get(c, c) for c in g} == {min(g)}


@pytest.mark.parametrize("bits,n", [(1, 10), (4, 1000), (4, 10 ** 7), (4, 10 ** 10)])
def test_some_mask_agrees(bits, n):
    rng = random.Random(n)
    choice = simhash.masks(n, bits)
    for _ in range(300):
        x = sum(1 << k for k in rng.sample(range(64), bits))
        assert any(x & m == 0 for m in choice)


def test_gray_order_neighbours_differ_in_one_bit():
    codes = np.arange(1 << 10, dtype=np.uint64)
    inside = codes[np.argsort(simhash.gray_rank(codes))]
    assert (np.bitwise_count(inside[1:] ^ inside[:-1]) == 1).all()


def test_keep_first(spark, edges, docs):
    for df in (edges, docs):
        kept = simhash.keep_first(df)
        assert kept.columns == df.columns
        n = simhash.near_duplicates(df).select("root").distinct().count()
        assert kept.count() == n
    assert simhash.keep_first(edges.limit(0)).count() == 0
