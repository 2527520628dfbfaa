"""The pipeline against a brute-force version of each stage, and its guard in the entry."""
import base64
import subprocess
import sys
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest

import corpus_pipeline as C
from quarry.llm import mixing

from .test_dedup import brute_print
from .test_sharding_mixing import brute_targets

WORDS = mixing.WORD


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage returns on the smallest table with odd rows added."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(10_000, "", "en", "src1", 0), (10_001, None, None, None, 0), (10_002, "12 34 !!", "de", "src2", 8),
                                 (3, docs.filter("doc_id = 3").first().text, "en", "src3", 5)], docs.schema)
    at = str(tmp_path_factory.mktemp("pipeline"))
    docs.union(odd).write.parquet(f"{at}/documents.parquet")
    out = [spark.read.parquet(f"{at}/documents.parquet")]
    for i, (_, stage) in enumerate(C.STAGES):
        stage(spark, out[-1], at).write.parquet(f"{at}/{i}")
        out.append(spark.read.parquet(f"{at}/{i}"))
    return at, out


def test_names_and_columns(stages):
    _, out = stages
    assert [n for n, _ in C.STAGES] == ["language_id", "simhash_near_dedup", "suffix_array_dedup", "source_mixing", "byte_bpe"]
    for df in out[1:-1]:
        assert df.schema.simpleString() == out[0].schema.simpleString()


def test_language_stage_keeps_prose(stages):
    _, out = stages
    before, after = ({r.doc_id for r in df.collect()} for df in out[:2])
    assert {10_000, 10_001, 10_002}.isdisjoint(after)
    assert len(before) - len(after) <= 3 + 0.02 * len(before)


def test_near_duplicate_stage(stages):
    _, out = stages
    rows = out[1].collect()
    prints = {r.doc_id: brute_print(r.text) for r in rows}
    comp = {i: i for i in prints}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids[:ids.index(a)]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    assert sorted(r.doc_id for r in out[2].collect()) == sorted({find(i) for i in ids})


def test_suffix_stage(stages):
    import numpy as np

    _, out = stages
    before = sorted((r.doc_id, r.text) for r in out[2].collect())
    after = {r.doc_id: (r.text, r.n_chars) for r in out[3].collect()}
    first = {}
    for i, t in before:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if first.setdefault(b[p:p + 100], (i, p)) != (i, p):
                gone[p:p + 100] = True
        left = np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        assert after[i] == (left, len(left))
    assert len(after) == len(before)


def test_mixing_stage(stages):
    import re

    _, out = stages
    sizes, largest, taken = Counter(), Counter(), defaultdict(int)
    count = lambda t: len(re.findall(WORDS, t or ""))
    rows = {r.doc_id: r for r in out[3].collect()}
    for r in rows.values():
        sizes[r.source] += count(r.text)
        largest[r.source] = max(largest[r.source], count(r.text))
    copies = Counter(r.doc_id for r in out[4].collect())
    for i, n in copies.items():
        assert n <= 2
        taken[rows[i].source] += n * count(rows[i].text)
    target = brute_targets(sizes)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)


def test_bpe_stage(stages):
    import tiktoken

    _, out = stages
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((r.doc_id, own.encode_ordinary(r.text or "")) for r in out[4].collect())
    got = out[5].collect()
    assert sorted((r.doc_id, list(r.ids)) for r in got) == want
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got)


def test_run_equals_stages_and_takes_empty_tables(spark, stages, tmp_path):
    at, out = stages
    key = lambda r: (r.doc_id, r.n_tokens, r.source)
    assert sorted(map(key, C.run(spark, at).collect())) == sorted(map(key, out[5].collect()))
    out[0].limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_entry_without_the_subpackage():
    """With the subpackage and the pipeline gone, the entry still imports and has the other queries."""
    code = ("import sys; sys.modules['quarry.llm'] = None; sys.modules['corpus_pipeline'] = None; "
            "import __spark_entry__ as e; q = e.queries(); "
            "assert q and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q); assert e.oracle_sql()")
    root = C.__file__.rsplit("/", 1)[0]
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


def test_language_stage_keeps_every_document_with_letters(spark, stages):
    """Also one of a word or two that all languages share: its posterior stays below one half."""
    from quarry.llm import langid

    _, out = stages
    before, after = out[0].collect(), Counter(r.doc_id for r in out[1].collect())
    assert after == Counter(r.doc_id for r in before if langid.words_of(r.text))
    rows = [(i, t, lang, "src0", len(t)) for i, (t, lang) in enumerate(
        (t, lang) for t in ("a", "ok", "radio taxi") for lang in ("da", "nb", "nn", "sv"))]
    short = spark.createDataFrame([*rows, (99, "12", "da", "src0", 2)], out[0].schema)
    kept = C.identify_language(spark, short, "").collect()
    assert sorted(r.doc_id for r in kept) == list(range(len(rows)))


def test_stages_begin_with_small_heaps(spark, docs, monkeypatch):
    """Each stage asks the JVMs to collect before it runs, and they do."""
    import corpus_pipeline
    from quarry.llm import common

    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    collected = lambda: sum(b.getCollectionCount() for b in beans())
    before = collected()
    common.shrink_heaps(spark)
    assert collected() > before
    asked = []
    monkeypatch.setattr(corpus_pipeline, "shrink_heaps", asked.append)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs.limit(20), None)
    assert asked == [spark] * len(corpus_pipeline.STAGES)
