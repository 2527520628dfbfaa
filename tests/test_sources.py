"""Connector (A8), committed sink (A4/A6), partitioned commit log (D5), glob sets (B4), sketches."""
import datetime as dt
import fnmatch
import glob
import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quarry.functions import globset, keys
from quarry.functions.paths import normalise_glob
from quarry.operators import audit, changes, paths
from quarry.session import checkpoint_path
from quarry.sources import committed, connector


def page(i, n=3, provider="github", repo=None):
    if provider == "github":
        body = {"tree": [{"path": f"src/{i}/{k}.py", "type": "blob", "sha": f"s{i}-{k}", "size": k} for k in range(n)]}
    elif provider == "gitlab":
        body = [{"path": f"src/{i}/{k}.py", "type": "blob", "id": f"s{i}-{k}"} for k in range(n)]
    else:
        body = {"values": [{"path": f"src/{i}/{k}.py", "type": "commit_file", "size": k, "commit": {"hash": f"h{i}"}} for k in range(n)]}
    return json.dumps({"repo_id": repo or f"r{i % 7}", "provider": provider, "ref": "main" if provider == "gitlab" else None, "page": body})


@pytest.fixture
def source(spark):
    spark.dataSource.register(connector.RepoDumpSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return lambda at, **o: spark.read.format("repodump").option("path", str(at)).options(**o)


@pytest.mark.parametrize("end", ["\n", ""])
def test_one_file_is_read_by_many_tasks(source, tmp_path, end):
    (tmp_path / "big.json").write_text("\n".join(page(i) for i in range(400)) + "\n\n" + page(400) + end)
    whole = sorted(map(str, source(tmp_path).load().collect()))
    assert len(whole) == 1203
    for size in (100, 997, 4096, 1 << 20):
        df = source(tmp_path, split_bytes=size).load()
        assert sorted(map(str, df.collect())) == whole
        if size == 4096:
            assert df.rdd.getNumPartitions() > 10


def test_filters_are_pushed(source, tmp_path):
    for k, provider in enumerate(("github", "gitlab", "bitbucket")):
        (tmp_path / f"{provider}.json").write_text("\n".join(page(i, provider=provider) for i in range(k, 90, 3)))
    df = source(tmp_path).load()
    cases = ["repo_id = 'r3'", "provider IN ('gitlab', 'x') AND path LIKE 'src/1%'", "ref = 'h2'", "path = 'src/5/1.py' OR size = 2",
             "repo_id = 'r1' AND repo_id = 'r2'", "provider IS NULL", "size > 1 AND repo_id IN ('r1', 'r2')", "provider <> 'github'"]
    rows = df.collect()
    for c in cases:
        spark = df.sparkSession
        want = sorted(map(str, spark.createDataFrame(rows, df.schema).filter(c).collect()))
        got = sorted(map(str, source(tmp_path, pushdown=True).load().filter(c).collect()))
        assert got == want, (c, len(got), len(want), got[:2], want[:2])
    pushed = source(tmp_path, pushdown=True).load().filter("repo_id = 'r3' AND path LIKE 'src/1%'")
    plan = pushed._jdf.queryExecution().executedPlan().toString()
    assert "r3" not in plan and "src/1" not in plan, plan  # nothing is left for Spark to compare


def test_stream_reads_each_line_once_over_restarts(source, spark, tmp_path):
    landed = tmp_path / "landed"
    landed.mkdir()
    base = checkpoint_path(spark, "test-a8", unique=True)

    def catch_up():
        (spark.readStream.format("repodump").option("path", str(landed)).option("split_bytes", 500).load().writeStream.format("parquet")
         .option("path", base + "/out").option("checkpointLocation", base + "/ck").trigger(availableNow=True).start().awaitTermination())
        return sorted(r.path for r in spark.read.parquet(base + "/out").collect()) if glob.glob(base + "/out/*.parquet") else []

    want = lambda n: sorted(f"src/{i}/{k}.py" for i in n for k in range(3))
    (landed / "a.json").write_text("\n".join(page(i) for i in range(20)) + "\n")
    assert catch_up() == want(range(20))
    (landed / "a.json").write_text("\n".join(page(i) for i in range(25)) + "\n" + page(25)[:40])  # grown, its last line not whole
    assert catch_up() == want(range(25))
    (landed / "a.json").write_text("\n".join(page(i) for i in range(26)) + "\n")
    (landed / "b.json").write_text("\n".join(page(i) for i in range(26, 40)) + "\n")
    assert catch_up() == want(range(40))
    assert catch_up() == want(range(40))


# --- committed sink

SCHEMA = "key string, value long"


@pytest.fixture
def sink(spark):
    spark.dataSource.register(committed.CommittedSink)
    base = checkpoint_path(spark, "test-committed", unique=True)
    put = lambda df, batch: df.write.format("committed").option("path", base).option("batch", batch).mode("append").save()
    return base, put, lambda: committed.read_committed(spark, base, SCHEMA)


def test_failed_job_leaves_no_rows(spark, sink):
    base, put, read = sink
    rows = spark.range(1000).selectExpr("cast(id as string) key", "id value").repartition(4)
    put(rows, "one")
    bad = rows.withColumn("key", F.when(F.col("value") == 777, F.raise_error(F.lit("refused"))).otherwise(F.col("key")))
    with pytest.raises(Exception, match="refused"):
        put(bad, "two")
    assert read().count() == 1000
    committed.sweep(base, older_than_secs=-5)
    assert len(glob.glob(base.removeprefix("file:") + "/data/*.parquet")) == len(committed.commits(base)[0]["files"])
    put(rows, "two")
    assert read().count() == 2000


def test_same_batch_again_leaves_one_copy(spark, sink):
    base, put, read = sink
    rows = spark.range(100).selectExpr("cast(id as string) key", "id value")
    for _ in range(3):
        put(rows, "daily")
    assert read().count() == 100 and [c["rows"] for c in committed.commits(base)] == [100]
    assert len(glob.glob(base.removeprefix("file:") + "/data/*")) == len(committed.commits(base)[0]["files"])
    put(rows.limit(0), "empty")
    assert read().count() == 100
    with pytest.raises(Exception, match="append"):
        rows.write.format("committed").option("path", base).mode("overwrite").save()


def test_stream_batch_after_a_lost_checkpoint_entry(spark, sink):
    """A query that dies between the sink's commit and the checkpoint's writes the batch again."""
    base, _, read = sink
    spark.range(50).selectExpr("cast(id as string) key", "id value").write.parquet(base + "/in")

    def run():
        (spark.readStream.schema(SCHEMA).parquet(base + "/in").writeStream.format("committed").option("path", base)
         .option("checkpointLocation", base + "/ck").trigger(availableNow=True).start().awaitTermination())

    run()
    local = base.removeprefix("file:")
    for f in glob.glob(f"{local}/ck/commits/*") + glob.glob(f"{local}/ck/commits/.*crc"):
        import os
        os.remove(f)
    run()
    assert read().count() == 50


# --- commit log

def scanned(df):
    """Files that the plan's file scan has opened, once it has run."""
    plan = df._jdf.queryExecution().executedPlan()
    todo, files = [plan.finalPhysicalPlan() if "Adaptive" in plan.getClass().getName() else plan], 0
    while todo:
        node = todo.pop()
        name = node.getClass().getName()
        if "QueryStage" in name:
            todo.append(node.plan())
            continue
        if "FileSourceScan" in name and "commit_seq" in node.toString():
            files += node.metrics().apply("numFiles").value()
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return files


def test_commit_log_reads_fewer_files_for_newer_watermarks(spark):
    path = checkpoint_path(spark, "test-log", unique=True)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(f"r{i % 5}", i, t0 + dt.timedelta(hours=6 * i)) for i in range(160)] + [("r0", 999, None)]
    commits = spark.createDataFrame(rows, "repo_id string, commit_seq long, commit_ts timestamp")
    changes.land_commits(commits, path, buckets=2)
    opened = []
    for day in (0, 20, 38):
        wm = spark.createDataFrame([(f"r{k}", t0 + dt.timedelta(days=day)) for k in range(5)], "repo_id string, last_sync timestamp")
        df = changes.commits_since_log(spark, path, wm, buckets=2)
        assert "dynamicpruning" in df._jdf.queryExecution().optimizedPlan().toString()
        assert {r.commit_seq for r in df.collect()} == {s for _, s, t in rows if t and t >= t0 + dt.timedelta(days=day)}
        opened.append(scanned(df))
    assert opened[0] > 1.9 * opened[1] > 6 * opened[2] > 0
    unsynced = spark.createDataFrame([("r0", None)], "repo_id string, last_sync timestamp")
    assert changes.commits_since_log(spark, path, unsynced, buckets=2).count() == 33  # the one without a time, too


# --- glob sets

def brute_match(path, globs):
    hit = False
    for g in globs or []:
        if g and g.strip():
            norm = normalise_glob(g.strip())
            hit = hit or norm is None or fnmatch.fnmatchcase(path, norm)
    return hit


def test_glob_sets_match_as_single_globs_do():
    rng = random.Random(4)
    part = lambda: "".join(rng.choice("ab/._-") for _ in range(rng.randint(0, 4)))
    texts = [part() + part() + part() for _ in range(400)] + ["", "a\nb", "[x]", "a]"]
    for _ in range(300):
        globs = [rng.choice(["*", "", "?", "[ab]", "[!a]", "**/*", "[", "]"]).join([part(), part()]) + rng.choice(["", "*", "/**/*"])
                 for _ in range(rng.randint(1, 6))]
        s = globset.glob_set(globs)
        for t in texts[::7]:
            found = s["all"] or any(s[n] and re.search(s[n].replace(r"\z", r"\Z"), x) for n, x in
                                    (("head", t), ("tail", t[::-1]), ("inner", t), ("other", t)))
            assert bool(found) == brute_match(t, globs), (t, globs, s)
    assert globset.glob_set(None) == {"all": False, "head": None, "tail": None, "inner": None, "other": None}


def test_a_thousand_globs_cost_hardly_more_than_ten(spark):
    files = spark.range(300_000).selectExpr("'r' repo_id", "concat('dir', id % 5000, '/sub', id % 77, '/file', id, '.e', id % 300) path").cache()
    files.count()

    def run(n):
        globs = [f"dir{7 * k}/**/*" for k in range(n // 2)] + [f"*.x{k}" for k in range(n // 4)] + [f"*file{3 * k}1.*" for k in range(n // 4)]
        table = spark.createDataFrame([("r", globs, [f"*.e{k}" for k in range(n // 4)])],
                                      "repo_id string, include_patterns array<string>, exclude_patterns array<string>")
        out, best = paths.select_paths_by_source(files, table), 1e9
        for _ in range(3):
            t = time.perf_counter()
            out.write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - t)
        return best

    ten = run(10)
    assert run(1000) < 2 * ten + 0.3
    files.unpersist()


# --- sketches, strip

def test_sketches_merge_both_ways(spark):
    df = spark.range(60_000).selectExpr("id % 30 day", "id % 2 kind", "cast((id * 7919) % 60000 as double) v")
    day = audit.value_sketches(df, ["day", "kind"], "v")
    assert day.selectExpr("max(length(sketch))").first()[0] < 20_000
    for s in (audit.merge_sketches(day, ["kind"]), audit.merge_sketches(audit.merge_sketches(day, ["day"]), []),
              audit.value_sketches(df, ["kind"], "v")):
        for r in audit.sketch_quantiles(s, [0.0, 0.01, 0.5, 0.99, 1.0]).collect():
            assert abs(r.quantile / 60_000 - r["rank"]) <= audit.SKETCH_RANK_ERROR + 1e-4
            assert r.n in (30_000, 60_000)


def test_strip_is_that_of_python(spark):
    every = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    assert sorted(keys.WHITE_SPACE) == sorted(c for c in map(chr, range(0x110000)) if c.isspace())
    texts = [c + "x" + c for c in every] + ["", " \t\u3000", "a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", keys.py_strip("t").alias("t"))
    got = {r.i: r.t for r in df.collect()}
    assert [texts[i] for i in got if got[i] != texts[i].strip()] == []
