"""Operator 11 against brute force."""
import hashlib
from collections import Counter, defaultdict

import pytest

from quarry.llm import jobs, line_dedup

SPACE = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, min_docs=5, min_chars=40):
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= min_chars:
                holders[key_of(line)].add(i)
    order = lambda i: (i is not None, i or 0)
    last = {k: max(d, key=order) for k, d in holders.items() if len(d) >= min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key_of(x) not in last or last[key_of(x)] == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


LONG = "This line is held by many documents, over forty code points"
UMLAUT = "Ä" * 20 + "ß" * 19 + "É"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, f"own {i}\n  {LONG if i % 2 else LONG.upper()}\t\r\nend") for i in range(1, 9)]
    rows += [(i, f"{UMLAUT}\n\n{UMLAUT} \n") for i in range(20, 25)]
    rows += [(i, UMLAUT.lower()) for i in range(30, 34)]  # A-Z only: É and é differ
    rows += [(i, "x" * 40 + "\n" + "y" * 39) for i in range(40, 45)]  # 40 counts, 39 doesn't
    rows += [(50, " " + "z" * 40), (51, "z" * 40), (52, "z" * 40), (53, "z" * 40), (54, "z" * 40)]  # no-break space stays
    rows += [(60, None), (61, ""), (62, "\n\n"), (None, LONG), (None, LONG + "\nmore"), (8, LONG), (8, LONG), (7, "other row\n" + LONG)]
    rows += [(70, "\n".join(["a b"] * 30_000 + [LONG] * 5_000)), (71, "q" * 300_000 + "\n" + LONG)]
    rows += [(i, "\n".join(["w" * 50] * 3)) for i in range(80, 84)]  # four documents: stays
    return spark.createDataFrame([(i, t, "x", 1, 2, "k") for i, t in rows],
                                 "doc_id long, text string, row string, pos int, n_lines int, key string")


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_lines_equal_brute_force(spark, folder, odd, docs, edges):
    for df in (odd, docs, edges):
        got = Counter(tuple(r) for r in line_dedup.drop_repeated_lines(df).collect())
        assert got == Counter(brute(rows_of(df)))
        at = folder(documents=df)
        got = Counter(tuple(r) for r in jobs.op11_line_dedup(spark, at).collect())
        assert got == Counter((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, d in brute(rows_of(df)))


def test_other_thresholds(docs):
    for least, chars in ((2, 1), (3, 20)):
        got = Counter(tuple(r) for r in line_dedup.drop_repeated_lines(docs, least, chars).collect())
        assert got == Counter(brute(rows_of(docs), least, chars))


def test_one_line_in_all_documents(spark):
    df = spark.range(3000).selectExpr("id doc_id", f"concat('{LONG}', char(10), id) text")
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.drop_repeated_lines(df).collect()}
    assert got == {i: (str(i), 1) for i in range(2999)} | {2999: (LONG + "\n2999", 0)}


def test_empty_table_and_native_plan(odd):
    assert line_dedup.drop_repeated_lines(odd.limit(0)).count() == 0
    plan = line_dedup.drop_repeated_lines(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("parts", [1, 20, 10 ** 9])
def test_hot_and_other_lines(monkeypatch, docs, odd, parts):
    monkeypatch.setattr(line_dedup, "HOT_PARTS", parts)
    for df in (docs, odd):
        got = Counter(tuple(r) for r in line_dedup.drop_repeated_lines(df).collect())
        assert got == Counter(brute(rows_of(df)))
