"""Operator 4 against a plain dictionary model."""
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import jobs, langid, ngram_lm
from quarry.llm.elias_fano import EliasFano, Lists


def brute(rows):
    tokens = []
    for i, text in rows:
        words = (text or "").encode().lower().split()
        held = zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
        tokens.append((i, held, [*words, b"\0end"]))
    c1, c2, c3 = Counter(), defaultdict(Counter), defaultdict(Counter)
    for _, held, t in tokens:
        if not held:
            c1.update(t)
            before = [b"\0start", b"\0start", *t]
            for u, v, w in zip(before, before[1:], t):
                c2[v][w] += 1
                c3[u, v][w] += 1
    total2, total3 = {k: sum(x.values()) for k, x in c2.items()}, {k: sum(x.values()) for k, x in c3.items()}
    n, v_ = sum(c1.values()), len(c1)
    out = []
    for i, held, t in tokens:
        base = score = known = 0
        before = [b"\0start", b"\0start", *t]
        for u, v, w in zip(before, before[1:], t):
            p = single = (c1[w] + 0.1) / (n + 0.1 * (v_ + 1))
            for counts, totals, key in ((c2, total2, v), (c3, total3, (u, v))):
                if key in totals:
                    p = max(counts[key][w] - 0.75, 0) / totals[key] + 0.75 * len(counts[key]) / totals[key] * p
            base, score, known = base + math.log10(single), score + math.log10(p), known + (c1[w] > 0)
        out.append((i, held, len(t), known, n, base, score))
    return out


def compare(spark, folder, df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    want = sorted(brute(rows), key=key)
    got = sorted((tuple(r) for r in jobs.op4_lm_scores(spark, folder(documents=df)).collect()), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert math.isclose(g[5], w[5], rel_tol=1e-9)
        assert abs(g[6] - w[6]) <= 2 * g[2] / ngram_lm.STEPS + 1e-9  # the stored probabilities are rounded down
    return got


def test_op4_equals_brute_force(spark, folder, docs, edges):
    got = compare(spark, folder, docs)
    held = [g for g in got if g[1]]
    assert sum(g[6] for g in held) > sum(g[5] for g in held)
    compare(spark, folder, edges)


def one_task(rows, monkeypatch, fan, shard_bytes, hot=None, chunk_tokens=5000):
    """All steps on one machine, with small chunks and shards (Spark's workers don't see patches)."""
    import pyarrow as pa
    monkeypatch.setattr(ngram_lm, "CHUNK_TOKENS", chunk_tokens)
    monkeypatch.setattr(ngram_lm, "RELAY_ROWS", min(fan, 40))
    monkeypatch.setattr(ngram_lm, "SEEN", 2)
    monkeypatch.setattr(ngram_lm, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("U", (), {"partitionId": staticmethod(lambda: 3)}))}))
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array(held), pa.array([r[1] for r in rows])],
                                       ["doc_id", "held_out", "text"])
    load = defaultdict(lambda: np.zeros(4, np.int64))
    table = lambda batches: pa.Table.from_batches(list(batches))
    streams = table(ngram_lm._chunks(iter([batch])))
    for b in ngram_lm._load(iter(streams.to_batches())):
        for r in b.to_pylist():
            load[r["word"] % (1 << 64)] += np.array([r["contexts"], r["times"], r["seen"], r["train"]])
    hot = {w: (-(-int(x[0]) // hot), int(x[1])) for w, x in load.items() if hot and x[0] > hot}
    common = np.array(sorted(load, key=lambda w: -load[w][2])[:200], np.uint64)
    order = np.argsort(common)
    known = ngram_lm.Known(hot, (order.astype(np.int64), common[order]), sum(int(x[3]) for x in load.values()),
                           sum(bool(x[3] > 0) for x in load.values()))
    levels = ngram_lm._levels(max(1, math.ceil(sum(len((t or "").encode()) for _, t in rows) / shard_bytes)), fan)
    by = lambda t, k="target": [t.filter(pa.compute.equal(t[k], x)) for x in sorted(pa.compute.unique(t[k]).to_pylist())]
    kind = lambda t, k: t.filter(pa.compute.equal(t["kind"], k))
    sent = table(ngram_lm._asks(iter(streams.to_batches()), levels[0], known))
    asked = []

    def exchange(asks, levels):
        asked.append(asks.num_rows)
        if len(levels) == 1:
            return pa.concat_tables([ngram_lm._answer(g) for g in by(asks)])
        relayed = table(ngram_lm._relay(iter(asks.sort_by([("target", "ascending"), ("chunk", "ascending")]).to_batches()),
                                        levels[1] // levels[0], levels[1]))
        answers = exchange(kind(relayed, ngram_lm.ASK), levels[1:])
        return pa.concat_tables([ngram_lm._back(g) for g in by(pa.concat_tables([kind(relayed, ngram_lm.STREAM), answers]))])

    answers = exchange(sent, levels)
    got = [r for g in by(pa.concat_tables([streams, answers])) for r in ngram_lm._score(g, known).to_pylist()]
    want = {w[0]: w for w in brute(rows)}
    assert len(got) == len(want)
    for g in got:
        w = want[g["doc_id"]]
        assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == w[2:5]
        assert math.isclose(g["base_score"], w[5], rel_tol=1e-9) and abs(g["score"] - w[6]) <= 2 * w[2] / ngram_lm.STEPS + 1e-9
    return levels, asked, sent, hot


@pytest.mark.parametrize("fan,shard_bytes", [(1024, 1 << 30), (1024, 5000), (8, 5000), (3, 5000)])
def test_op4_many_shards_chunks_and_relays(docs, monkeypatch, fan, shard_bytes):
    rows = [(r.doc_id, r.text) for r in docs.limit(80).select("doc_id", "text").collect()]
    levels, asked, _, _ = one_task(rows, monkeypatch, fan, shard_bytes)
    assert len(levels) == (1 if fan == 1024 else 2 if fan == 8 else 4) and len(asked) == len(levels)


def test_op4_requests_grow_like_the_corpus(monkeypatch):
    """Twice and four times the documents: the rows asked grow as much, not as the square."""
    import random
    rng = random.Random(3)
    text = lambda: " ".join(f"w{int(rng.expovariate(0.01))}" for _ in range(120))
    rows = [(i, text()) for i in range(400)]
    counts = []
    for n in (100, 200, 400):
        _, asked, _, _ = one_task(rows[:n], monkeypatch, 6, 1500, chunk_tokens=500)
        counts.append(sum(asked))
    assert counts[1] < 2.6 * counts[0] and counts[2] < 2.6 * counts[1]


def test_op4_empty(spark, docs, folder):
    assert jobs.op4_lm_scores(spark, folder(documents=docs.limit(0))).count() == 0


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (5, 3), (1000, 1 << 50), (200_000, 1 << 55), (150_000, 200_000), (3000, 10)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n))
    ef = EliasFano(values)
    assert (ef.get(np.arange(n)) == values).all()
    wanted = np.concatenate([values[::3], rng.integers(0, top, 500), [top + 5, 0]])
    first = np.searchsorted(values, wanted)
    there = np.isin(wanted, values)
    assert (ef.find(wanted) == np.where(there, first, -1)).all()
    if n == 200_000:
        assert len(ef.map) < 0.85 * values.nbytes


def test_lists_look_within_their_range():
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 6, 2000)
    lists = [np.sort(rng.choice(50, k, replace=False)) for k in sizes]
    both = Lists(sizes, np.concatenate(lists))
    which, number = rng.integers(0, 2000, 20_000), rng.integers(0, 50, 20_000)
    at, begin = both.find(which, number)
    starts = np.cumsum(sizes) - sizes
    for k, x, a, b in zip(which.tolist(), number.tolist(), at.tolist(), begin.tolist()):
        place = np.flatnonzero(lists[k] == x)
        assert b == starts[k] and a == (b + place[0] if len(place) else -1)


def skewed(n):
    """Texts in which every other word is the same, and what follows it differs."""
    return [(i, " ".join(f"the w{(37 * i + k) % 900}" for k in range(60))) for i in range(n)]


def test_op4_hot_words_span_shards(spark, folder, docs, monkeypatch):
    """A word's trigrams and bigrams come in pieces to several shards; the scores stay the same."""
    plain = compare(spark, folder, docs)
    monkeypatch.setattr(ngram_lm, "HOT_ENTRIES", 50)
    split = compare(spark, folder, docs)
    for a, b in zip(plain, split):
        assert a[:6] == b[:6] and math.isclose(a[6], b[6], rel_tol=1e-12, abs_tol=1e-9)
    texts = skewed(200)
    compare(spark, folder, spark.createDataFrame(texts, "doc_id long, text string"))
    _, _, sent, hot = one_task(texts, monkeypatch, 1024, 3000, hot=300, chunk_tokens=2000)
    assert hot
    load = Counter()
    for r in sent.to_pylist():
        if r["kind"] == ngram_lm.ASK:
            load[r["target"]] += len(ngram_lm._get(r["i"], np.uint32))
    assert max(load.values()) < 0.25 * sum(load.values())  # the hot word alone brings half of all


def test_op4_tells_documents_that_occur_twice(spark, folder):
    """A held-out document whose copy is learned from scores far above its unigram score."""
    import random
    rng = random.Random(9)
    words = [f"v{k}" for k in range(400)]
    text = lambda: " ".join(rng.choice(words) for _ in range(80))
    held = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 10 == 0]
    kept = [i for i in range(4000) if i not in set(held)]
    copies = [text() for _ in range(40)]
    rows = [*zip(held[:40], copies), *zip(kept[:40], copies), *[(i, text()) for i in (*held[40:120], *kept[40:1200])]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gain = {r.doc_id: (r.score - r.base_score) / r.n_tokens for r in jobs.op4_lm_scores(spark, folder(documents=df)).collect()}
    assert min(gain[i] for i in held[:40]) > max(gain[i] for i in held[40:120]) + 0.5


def test_short_numbers_round_trip():
    ids = np.concatenate([np.arange(65_500, 65_600), [0, 1 << 32, (1 << 40) + 65_534, 5]])
    assert (ngram_lm._get_short(*ngram_lm._put_short(ids)) == ids).all()


def test_a_shard_holds_few_bytes_for_each_entry():
    """What a shard's step holds at most, beside its rows, is bounded by its entries."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    n, words = 300_000, 40_000
    rows = []
    for chunk in range(4):
        sizes = np.full(words, n // 4 // words + 1)
        befores = int(sizes.sum())
        after = rng.integers(0, 1 << 40, befores)
        ask = ngram_lm.Ask(np.sort(rng.integers(0, 1 << 63, words)).astype(np.uint64), np.ones(words, np.int64), np.full(words, -1), sizes,
                           np.ones(befores, np.int64), rng.integers(0, 65_000, befores), after, np.ones(befores, np.int64), np.array([words]))
        rows.append(ngram_lm._row(0, ngram_lm.ASK, chunk, 0, *ask.put()))
    entries = 4 * befores
    table = pa.Table.from_batches([ngram_lm._batch(rows)])
    tracemalloc.start()
    try:
        ngram_lm._answer(table)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 230 * entries, peak / entries


def test_op4_chunks_are_not_shuffled(spark, docs, folder):
    """Answers come to the chunks' buckets; the table that buckets need doesn't stay."""
    out = jobs.op4_lm_scores(spark, folder(documents=docs))
    plan = out._jdf.queryExecution().executedPlan().toString()
    last = plan[plan.index("CoGroups"):]
    chunks = last[:last.index("Exchange")]  # what is read in place comes before the answers' shuffle
    assert "FileScan" in chunks and "Bucketed: true" in chunks and "Union" not in last
    assert out.count() == docs.count()
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("lm_chunks")] == []


def test_op4_hot_pairs_span_shards(spark, folder, monkeypatch):
    """Two words that follow each other in every third place: what follows both comes in pieces too."""
    texts = [(i, " ".join(f"of the w{(37 * i + k) % 900}" for k in range(60))) for i in range(200)]
    pair, n = tuple(xxhash.xxh64_intdigest(w) for w in (b"of", b"the")), 60 * len(texts)
    times = 60 * sum(zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in texts)
    known = ngram_lm.Known
    monkeypatch.setattr(ngram_lm, "Known", lambda *a: known(*a, {pair: (-(-n // 300), times)}))
    _, _, sent, hot = one_task(texts, monkeypatch, 1024, 3000, hot=300, chunk_tokens=2000)  # scores equal brute force
    assert set(pair) <= set(hot)
    held = Counter()
    for r in sent.to_pylist():
        if r["kind"] == ngram_lm.ASK:
            ask = ngram_lm.Ask.get(r)
            c_at, t_at = ask.starts()
            for name, x in zip(ask.vocab.tolist(), np.diff(t_at[c_at])):
                held[name] += int(x)
    assert max(held.values()) < 0.1 * n  # the pair's trigrams were one piece of the word: a third of all
    monkeypatch.undo()
    monkeypatch.setattr(ngram_lm, "HOT_ENTRIES", 300)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    compare(spark, folder, df)
    held_out = df.select("doc_id", langid.held_out(F.col("doc_id"), 10, 0).alias("held_out"), "text")
    chunks, _ = ngram_lm.materialize_by(held_out.mapInArrow(ngram_lm._chunks, ngram_lm._ROW), "lm-test", "target")
    assert ngram_lm.special_words(chunks).pairs[pair] == (-(-n // 300), times)


def test_op4_relays_hold_few_entries(docs, monkeypatch):
    """A relay's batch is full by its entries too, whatever the number of its rows."""
    monkeypatch.setattr(ngram_lm, "RELAY_ENTRIES", 3000)
    rows = [(r.doc_id, r.text) for r in docs.limit(80).select("doc_id", "text").collect()]
    most, kept = [], ngram_lm._joined
    monkeypatch.setattr(ngram_lm, "_joined", lambda asks: most.append(sum(len(a.after) for a in asks)) or kept(asks))
    answer = ngram_lm._answer
    monkeypatch.setattr(ngram_lm, "_answer", lambda group: (lambda n: (answer(group), most.__delitem__(slice(n, None)))[0])(len(most)))
    levels, asked, sent, _ = one_task(rows, monkeypatch, 8, 5000, chunk_tokens=1000)
    largest = max(len(ngram_lm._get(r["i"], np.uint32)) for r in sent.to_pylist())
    assert len(levels) == 2 and 3000 > 2 * largest and max(most) < 3000 + largest
    assert sum(most) > 5 * 3000
