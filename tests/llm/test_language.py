"""Operator 7: the forward pass against an enumeration, and held-out accuracy."""
import zlib
from itertools import product

import numpy as np
import public_tokenizers as P
import pytest

from quarry.llm import jobs, langid

PIECES = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "aba", "é"]


def segmentations(word, pieces):
    if not word:
        yield []
        return
    for n in range(1, len(word) + 1):
        if word[:n] in pieces or n == 1 and word[0] not in {p for p in pieces if len(p) == 1}:
            for rest in segmentations(word[n:], pieces):
                yield [word[:n], *rest]


def all_words():
    return ["".join(w) for n in (1, 2, 3, 4) for w in product("abé?", repeat=n)]


def test_forward_pass_sums_all_segmentations():
    own, rng = langid.Pieces(PIECES), np.random.default_rng(0)
    prob = np.vstack([rng.random((len(PIECES), 2)), np.full((1, 2), langid.UNKNOWN)])
    words = all_words()
    got = 10 ** langid.log_words(own, prob, words)
    for w, g in zip(words, got):
        want = np.zeros(2)
        for s in segmentations("▁" + w, PIECES):
            want += np.prod([prob[PIECES.index(p) if p in PIECES else len(PIECES)] for p in s], axis=0)
        assert np.allclose(g, want, rtol=1e-9)


def test_expected_counts_weigh_all_segmentations():
    own, words = langid.Pieces(PIECES), all_words()
    times = np.arange(1, len(words) + 1.0)
    got, want = langid.expected_counts(own, words, times), np.zeros(len(PIECES))
    for w, t in zip(words, times):
        ways = list(segmentations("▁" + w, PIECES))
        weight = np.array([np.prod([1 / len(PIECES) if p in PIECES else langid.UNKNOWN for p in s]) for s in ways])
        for s, x in zip(ways, weight / weight.sum()):
            for p in s:
                if p in PIECES:
                    want[PIECES.index(p)] += x * t
    assert np.allclose(got, want)


def forward(word, pieces, price):
    """Sum over all segmentations by a plain recursion from the end, with exact fractions of floats."""
    from fractions import Fraction
    single = {p for p in pieces if len(p) == 1}
    ways = [Fraction(0)] * len(word) + [Fraction(1)]
    for i in range(len(word) - 1, -1, -1):
        for n in range(1, min(langid.LONGEST_PIECE, len(word) - i) + 1):
            if word[i:i + n] in pieces or n == 1 and word[i] not in single:
                ways[i] += Fraction(price(word[i:i + n])) * ways[i + n]
    return ways


@pytest.mark.parametrize("word", ["abab" * 10, "abéba?" * 30, "a" * 400, "?" * 200, "ab" * 20 + "é"])
def test_long_words_sum_all_segmentations(word):
    """Words of 40 letters and more: no cut, no new word mark, no underflow."""
    import math
    own, rng = langid.Pieces(PIECES), np.random.default_rng(1)
    prob = np.vstack([rng.random((len(PIECES), 2)) * 1e-3, np.full((1, 2), langid.UNKNOWN)])
    got = langid.log_word(own, prob, word)
    for k in range(2):
        ways = forward("▁" + word, PIECES, lambda p, k=k: float(prob[PIECES.index(p) if p in PIECES else len(PIECES), k]))
        want = math.log10(ways[0].numerator) - math.log10(ways[0].denominator)
        assert math.isclose(got[k], want, rel_tol=1e-9)
    if len(word) < 60:
        assert np.allclose(got, langid.log_words(own, prob, [word])[0])
        assert np.allclose(langid.expected_counts_of(own, word), langid.expected_counts(own, [word], np.ones(1)))
    counts = langid.expected_counts_of(own, word)
    covered = sum(len(p) * c for p, c in zip(PIECES, counts))
    assert abs(covered - (len(word) + 1 - word.count("?"))) < 1e-6 * len(word)


def test_op7_equals_a_plain_model(spark, folder):
    """The query's predictions and posteriors against a model of dictionaries."""
    import math
    pieces = langid.read_pieces(P.path("piece_bpe_32k.model"))
    known, single = set(pieces), {p for p in pieces if len(p) == 1}
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("n_chars < 600")
    rows = df.select("doc_id", "text", "lang").collect()
    assert len(rows) > 20

    def spans(word):
        return [[(n, word[i:i + n] if word[i:i + n] in known else None) for n in range(1, min(langid.LONGEST_PIECE, len(word) - i) + 1)
                 if word[i:i + n] in known or n == 1 and word[i] not in single] for i in range(len(word))]

    def sums(word, price):
        at = spans(word)
        f, b = [1.0] + [0.0] * len(word), [0.0] * len(word) + [1.0]
        for i, here in enumerate(at):
            for n, p in here:
                f[i + n] += f[i] * price(p)
        for i in range(len(word) - 1, -1, -1):
            b[i] = sum(price(p) * b[i + n] for n, p in at[i])
        return at, f, b

    counts, docs_of = {}, {}
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 3 == 1 or r.text is None or r.lang is None:
            continue
        docs_of[r.lang] = docs_of.get(r.lang, 0) + 1
        mine = counts.setdefault(r.lang, {})
        for w in langid.words_of(r.text):
            price = lambda p: 1 / len(pieces) if p else langid.UNKNOWN
            at, f, b = sums("▁" + w, price)
            for i, here in enumerate(at):
                for n, p in here:
                    if p:
                        mine[p] = mine.get(p, 0) + f[i] * price(p) * b[i + n] / f[-1]
    model = {x: (c, sum(c.values()) + langid.SMOOTH * len(pieces)) for x, c in counts.items()}
    total = sum(docs_of.values())
    got = {r.doc_id: r for r in jobs.op7_language(spark, folder(documents=df)).collect()}
    for r in rows:
        words = langid.words_of(r.text)
        if not words:
            assert got[r.doc_id].lang_pred == "und"
            continue
        logs = {}
        for x, (c, mass) in model.items():
            price = lambda p: (c.get(p, 0) + langid.SMOOTH) / mass if p else langid.UNKNOWN
            logs[x] = math.log10(docs_of[x] / total) + sum(math.log10(sums("▁" + w, price)[1][-1]) for w in words)
        best = max(logs, key=lambda x: logs[x])
        assert got[r.doc_id].lang_pred == best
        assert abs(got[r.doc_id].score - 1 / sum(10 ** (v - logs[best]) for v in logs.values())) < 1e-3


def test_op7_held_out_accuracy(spark):
    got = jobs.op7_language(spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(got) == len(truth)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.9


def test_op7_edges(spark, edges, folder):
    got = jobs.op7_language(spark, folder(documents=edges)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == edges.count()
    for i in (1, 2, 3):
        assert by[i].lang_pred == "und" and by[i].score == 0
    assert all(r.lang_pred in {"en", "de", "fr", "es", "und"} for r in got)
    pieces = langid.read_pieces(P.path("piece_bpe_32k.model"))
    nothing = langid.train(edges.limit(0), pieces)
    assert {r.lang_pred for r in langid.predict(edges, pieces, nothing).collect()} == {"und"}
    assert langid.identify(edges.limit(0), P.path("piece_bpe_32k.model")).count() == 0


@pytest.mark.parametrize("text,words", [(None, []), ("12 -- 3", []), ("Ab cd_E2f", ["ab", "cd", "e", "f"]),
                                        ("x" * 70, ["x" * 70]), ("हिन्दी में", ["हिन्दी", "में"]), ("e\u0301te\u0301 \u0301a", ["e\u0301te\u0301", "a"]),
                                        ("中文没有空格的句子" * 9 + "。好", ["中文没有空格的句子" * 9, "好"])])
def test_words(text, words):
    assert langid.words_of(text) == words


def test_op7_learns_every_label(spark):
    """No label is left out, however many there are and however rare it is."""
    pieces = langid.read_pieces(P.path("piece_bpe_32k.model"))
    rows = [("the house and the garden", f"l{i:03}") for i in range(299)] * 2 + [("zwölf boxkämpfer jagen viktor", "zz")]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string").coalesce(2), pieces)
    asked = spark.createDataFrame([("zwölf boxkämpfer jagen",), ("the house and the garden",), ("12",)], "text string")
    got = {r.text: r for r in langid.predict(asked, pieces, model).collect()}
    assert got["zwölf boxkämpfer jagen"].lang_pred == "zz" and got["zwölf boxkämpfer jagen"].score > 0.5
    same = got["the house and the garden"]
    assert same.lang_pred == "l000" and abs(same.score - 1 / 299) < 1e-4
    assert got["12"].lang_pred == "und"


def test_op7_blocks_give_the_same(spark, monkeypatch):
    pieces = langid.read_pieces(P.path("piece_bpe_32k.model"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    run = lambda: {r.doc_id: r for r in langid.predict(docs, pieces, langid.train(docs, pieces)).collect()}
    whole = run()
    for size in (1, 3):
        monkeypatch.setattr(langid, "AT_ONCE", size)
        got = run()
        assert got.keys() == whole.keys()
        for i, r in got.items():
            assert r.lang_pred == whole[i].lang_pred and abs(r.score - whole[i].score) < 1e-6
