"""D1's contains match against a nested loop over LIKE patterns."""
import random
import re

import pytest

from quarry.operators import contains

REPOS = "id long, url string, created_at long"


def brute(pushes, repos):
    out = {}
    for k, url in pushes:
        exact = [(c, i) for i, u, c in repos if u == url and url is not None]
        if exact:
            out[k] = (min(exact)[1], "exact")
            continue
        if url is None:
            out[k] = (None, None)
            continue
        needle = re.sub(r"[.git]+\Z", "", re.sub(r"/+\Z", "", url)).lower()
        pattern = re.compile("".join({"_": ".", "%": ".*"}.get(c, re.escape(c)) for c in needle), re.S)
        near = [(c, i) for i, u, c in repos if u is not None and pattern.search(u.lower())]
        out[k] = (min(near)[1], "contains") if near else (None, None)
    return out


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgit") for _ in range(rng.randint(1, 7)))
    hosts = ["github.com", "GitLab.com", "bitbucket.org"]
    repos = [(i, f"https://{rng.choice(hosts)}/{word()}/{word()}{rng.choice(['', '.git', '/', '_x', '%'])}", rng.randint(0, 50))
             for i in range(400)]
    repos += [(1000, None, 0), (1001, "", 5), (1002, repos[3][1], 99), (1003, "C:\\repos\\x", 3), (1004, "https://ÜMLAUT.de/Ärger", 9)]
    pushes = []
    for i in range(300):
        u = rng.choice(repos[:400])[1]
        a = rng.randint(0, len(u) - 1)
        shape = i % 8
        pushes.append((i, u if shape == 0 else u[a:] if shape == 1 else u[:a] if shape == 2 else u[a:a + rng.randint(1, 9)] if shape == 3
                       else u.replace("t", "_") if shape == 4 else u[:9] + "%" + u[-4:] if shape == 5 else u.upper() if shape == 6 else word()))
    pushes += [(900, None), (901, ""), (902, "/"), (903, "_"), (904, "%"), (905, "_" * 60), (906, "_" * 20 + "%"), (907, ".git"), (908, "repos\\"),
               (909, "a_%_b"), (910, "nothing like it"), (911, "https://"), (912, "ümlaut.de/ärger"), (913, "h%s"), (914, "_%a%_")]
    return pushes, repos


@pytest.mark.parametrize("part,common", [(256, None), (256, 2)])
def test_contains_equals_nested_loop(spark, tables, monkeypatch, part, common):
    if common:
        monkeypatch.setattr(contains, "COMMON_PART", common)  # few grams are common, or most
    pushes, repos = tables
    p, r = spark.createDataFrame(pushes, "k long, repo_url string"), spark.createDataFrame(repos, REPOS)
    got = {x.k: (x.repository_id, x.match) for x in contains.annotate_contains(p, r).collect()}
    want = brute(pushes, repos)
    assert {k: (got[k], want[k], dict(pushes)[k]) for k in want if got[k] != want[k]} == {}


def test_no_nested_loop_and_few_candidates(spark):
    """Ten thousand URLs under one host: a whole URL looks at some of them, not at all."""
    r = spark.range(10_000).selectExpr("id", "concat('https://github.com/org', id % 97, '/repo-', id * 7919 % 100003) url", "id created_at")
    p = r.sample(0.1, seed=1).selectExpr("id k", "concat(upper(url), '.git') repo_url")
    out = contains.annotate_contains(p, r)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert out.filter("match is null").count() == 0
    seen = contains.candidate_report(p, r).collect()
    assert all(1 <= x.matches <= x.candidates for x in seen)
    assert sum(x.candidates for x in seen) < 0.01 * len(seen) * 10_000


def test_empty_tables(spark):
    p, r = spark.createDataFrame([(1, "x")], "k long, repo_url string"), spark.createDataFrame([], REPOS)
    assert [x.match for x in contains.annotate_contains(p, r).collect()] == [None]
    assert contains.annotate_contains(p.limit(0), spark.createDataFrame([(1, "x", 1)], REPOS)).count() == 0
