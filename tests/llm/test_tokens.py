"""Operators 1 and 3 against the tokenizers' own libraries."""
import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from quarry.llm import bpe, jobs, token_output, units


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in
             map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(encoding, text):
    ids = encoding.encode_ordinary(text or "")
    return (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256((text or "").encode()).hexdigest())


def test_units_join_back():
    for t in ["", " ", "a b", " a  b ", "a\n b c", "a  b c d"]:
        assert " ".join(units.units(t)) == t


def test_op1_equals_library(spark, edges, docs, folder, tiktoken_encoding):
    for df in (edges, docs):
        want = sorted(((r.doc_id or -1, *expected(tiktoken_encoding, r.text)) for r in df.collect()))
        got = jobs.op1_bpe(spark, folder(documents=df)).collect()
        assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want


def test_op1_every_code_point(spark, tiktoken_encoding):
    """White space, letters and numbers are classed as the library classes them."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rows = ["".join(f"a{c}{c}1{c} {c}b" for c in points[i:i + 500]) for i in range(0, len(points), 500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").repartition(8)
    got = {r.doc_id: list(r.ids) for r in bpe.encode_decode(
        df, bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN).collect()}
    assert [i for i, t in enumerate(rows) if got[i] != tiktoken_encoding.encode_ordinary(t)] == []


def test_op1_keeps_columns_and_empty_table(spark, edges):
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    out = bpe.encode_decode(edges, ranks, P.PATTERN)
    assert set(out.columns) == {*edges.columns, "decoded"}
    assert out.count() == edges.count()
    assert bpe.encode_decode(edges.limit(0), ranks, P.PATTERN).count() == 0


def brute_op3(df):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return [(r.doc_id, [*own.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in df.collect()]


def test_op3_equals_library(spark, edges, docs, folder):
    for df in (edges.filter("doc_id <> 5"), docs):
        start, want = 0, []
        for i, ids in sorted(brute_op3(df)):
            want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        got = jobs.op3_token_output(spark, folder(documents=df)).collect()
        assert sorted(map(tuple, got)) == want


def test_op3_special_tokens_as_the_library_takes_them(spark, folder):
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a <|endoftext|><|endoftext|>b", "<|endoftext", "x  <|endoftext|>  y",
             "plain words, other words.", "<|padding|> <|ENDOFTEXT|>", "ünïcode wörds, ôther wörds! été? ﬁ ǅ ª º"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, start = [], 0
    for i, ids in brute_op3(df):
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert 50256 in brute_op3(df)[0][1]
    assert sorted(map(tuple, jobs.op3_token_output(spark, folder(documents=df)).collect())) == want


def test_op3_every_code_point(spark, folder):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rows = ["".join(f"a{c}{c}1{c} {c}b {c}, {c}" for c in points[i:i + 500]) for i in range(0, len(points), 500)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(8)
    want = {i: zlib.crc32(np.array(ids, "<u4").tobytes()) for i, ids in brute_op3(df)}
    got = {r.doc_id: r.ids_crc32 for r in jobs.op3_token_output(spark, folder(documents=df)).collect()}
    assert [i for i in want if got[i] != want[i]] == []


def test_op3_encodes_words_and_marks_apart():
    """A word is encoded once, whatever marks and lines' ends stand beside it."""
    import pyarrow as pa

    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}é" for i in range(200)]
    column = pa.array([f"{a}{m} {b}.\n{a}{m}" for m in (",", "!!", ";", "$$$", ".)", "") for a, b in zip(words, words[1:], strict=False)])
    own, asked = token_output.Encoder(P.path("byte_bpe_50k.json")), []
    encode = own.encode
    own.encode = lambda units, *more: asked.extend(units) or encode(units, *more)
    ids, at = own.texts(column, 2)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [
        [*own.own.encode(t, add_special_tokens=False).ids, 2] for t in column.to_pylist()]
    assert len(asked) < 3 * len(words), len(asked)


def test_op3_units_are_independent():
    """Texts of all kinds of characters, the ones that may not be cut at among them."""
    import random

    import pyarrow as pa

    draw = random.Random(3)
    marks = ["a", "s", "t", "ll", "Zé", "ß", "×", "÷", "ÿ", "\u023f", "\u0240", "ª", "中", "e\u0301", "1", "²", "Ⅷ", "'", "'s", "’", ".", ",", "!!",
             "\\", "`", " ", " ", " ", "  ", "\n", "\n", "\r\n", "\t", "\x1c", "\xa0", "\u2028", "\x00", "🙂", "<|endoftext|>"]
    texts = ["".join(draw.choices(marks, weights=[1] * (len(marks) - 1) + [0.05], k=draw.randrange(25))) for _ in range(20_000)]
    own = token_output.Encoder(P.path("byte_bpe_50k.json"))
    for some in (texts[:7], texts[7:12_000], texts[12_000:]):
        ids, at = own.texts(pa.array(some), 2)
        want = [e.ids for e in own.own.encode_batch(some, add_special_tokens=False)]
        assert [t for t, a, b, w in zip(some, at[:-1], at[1:], want, strict=True) if ids[a:b].tolist() != [*w, 2]] == []


def test_op3_start_follows_the_files(spark, tmp_path):
    """Rows that share a doc_id: start is the place of that very row in the files."""
    texts = ["one two three four five six", "one", "one two three"] * 40
    df = spark.createDataFrame([(5 if i % 2 else i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    path = str(tmp_path / "repeats")
    token_output.write_tokens(df, path, P.path("byte_bpe_50k.json"), 2)
    rows = []
    for f in sorted((tmp_path / "repeats").glob("part-*.orc")):
        rows += spark.read.orc(str(f)).collect()  # small files: one partition, so in file order
    want, start = [], 0
    for r in rows:
        want.append((r.doc_id, start, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())))
        start += len(r.ids)
    assert sorted(map(tuple, token_output.token_index(spark, path).collect())) == sorted(want)


def test_file_numbers(spark):
    names = ["part-00002-ab-c000.zstd.orc", "part-10000-ab-c000.zstd.orc", "part-100000-ab-c000.zstd.orc", "part-100000-ab-c001.zstd.orc",
             "part-10001-ab-c000.zstd.orc"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.n for r in df.orderBy(token_output.file_number(df.n)).collect()]
    assert got == [names[0], names[1], names[4], names[2], names[3]]


def test_op3_repeated_and_null_ids(spark, edges, folder):
    got = sorted(jobs.op3_token_output(spark, folder(documents=edges)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 4, 5, 5, 5, 7, 8, 9, 10, 11, 12]
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]


def test_op3_reads_single_documents(spark, docs, tmp_path):
    path = str(tmp_path / "tokens")
    token_output.write_tokens(docs, path, P.path("byte_bpe_50k.json"), 2)
    some = token_output.read_tokens(spark, path, [3, 77])
    assert "PushedFilters: [In(doc_id, [3,77])]" in some._jdf.queryExecution().toString()
    assert sorted(r.doc_id for r in some.collect()) == [3, 77]
    assert token_output.token_index(spark, path).count() == docs.count()
    empty = str(tmp_path / "none")
    token_output.write_tokens(docs.limit(0), empty, P.path("byte_bpe_50k.json"), 2)
    assert token_output.token_index(spark, empty).count() == 0


def test_merging_many_pieces_holds_few_bytes():
    """Trees are merged in blocks: a worker's memory for them doesn't grow with the pieces, and is small."""
    import tracemalloc

    import numpy as np
    import public_tokenizers

    from quarry.llm import bpe

    ranks = bpe.Ranks(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    raw = np.random.default_rng(1).integers(97, 123, (130_000, 8)).astype(np.uint8).tobytes()
    pieces = [raw[i:i + 8] for i in range(0, len(raw), 8)]
    tracemalloc.start()
    try:
        ids = ranks.encode_pieces(pieces)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [ranks.decode(np.frombuffer(x, np.int32).tolist()) for x in ids[:500]] == pieces[:500]
    assert peak < 70e6, peak
