"""Metamorphic properties, defect switches and operator edge cases on small inputs."""

import datetime as dt

from pyspark.sql import functions as F

from quarry.operators import audit, changes, events, paths, registry

OLD = [("r", "a.py", "s1", 1), ("r", "b.py", "s2", 1), ("r", "c.py", "s3", 1), ("r", "d.py", "s4", 1),
       ("r", "e.py", "s5", 1), ("r", "f.py", "s5", 1)]
NEW = [("r", "a.py", "s1", 1), ("r", "b.py", "s2x", 1), ("r", "x/c.py", "s3", 1), ("r", "g.py", "s6", 1),
       ("r", "e.py", "s5", 1), ("r", "f2.py", "s5", 1), ("r", "f3.py", "s5", 1)]
SNAP = "repo_id string, path string, sha string, size long"


def test_diff_snapshots_with_renames(spark):
    o, n = spark.createDataFrame(OLD, SNAP), spark.createDataFrame(NEW, SNAP)
    got = sorted((r.path, r.change, r.old_path) for r in changes.diff_snapshots(o, n).collect())
    assert got == sorted([("b.py", "modified", None), ("x/c.py", "renamed", "c.py"), ("d.py", "removed", None),
                          ("g.py", "added", None), ("f2.py", "renamed", "f.py"), ("f3.py", "added", None)])


def test_diff_of_identical_snapshots_is_empty(spark):
    o = spark.createDataFrame(OLD, SNAP)
    assert changes.diff_snapshots(o, o).count() == 0


def test_apply_events_of_diff_reaches_new_snapshot(spark):
    o, n = spark.createDataFrame(OLD, SNAP), spark.createDataFrame(NEW, SNAP)
    content = lambda df: df.select("repo_id", "path", F.encode(F.concat(F.lit("body-"), "sha"), "UTF-8").alias("content"))  # noqa
    state = content(o).select("repo_id", F.col("path").alias("file_path"),
                              F.col("content").cast("string").alias("content"), F.lit(-1).cast("long").alias("off"))
    repos = spark.createDataFrame([("r", "https://github.com/o/r.git", "u")], "repo_id string, url string, user_id string")
    ev = events.to_file_events(changes.diff_snapshots(o, n), content(n), repos).withColumn("off", F.lit(1).cast("long"))
    after = events.apply_file_events(state, ev)
    want = sorted((r.path, "body-" + r.sha) for r in n.collect())
    assert sorted((r.file_path, r.content) for r in after.collect()) == want
    assert {r.repo_name for r in ev.collect()} == {"o/r"}


def test_net_changes_policies(spark):
    ev = spark.createDataFrame([("r", "a", 1, 1, 0, "created"), ("r", "a", 2, 2, 0, "modified"),
                                ("r", "a", 3, 3, 0, "deleted")],
                               "repo_id string, path string, commit_ts long, commit_seq long, file_seq long, event_type string")
    assert changes.net_changes(ev, "newest").first().event_type == "deleted"
    assert changes.net_changes(ev, "reference").first().event_type == "created"


def test_plan_sync_switch(spark):
    src = spark.createDataFrame([("a", "h1"), ("b", "h1"), ("c", None)], "source_id string, last_commit_hash string")
    heads = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", "h3")], "source_id string, head_sha string")
    modes = lambda **kw: {r.source_id: r.sync_mode for r in changes.plan_sync(src, heads, **kw).collect()}  # noqa
    assert modes() == {"a": "unchanged", "b": "incremental", "c": "full"}
    assert modes(resync_unchanged=True) == {"a": "full", "b": "incremental", "c": "full"}


def test_select_paths_equals_except_all(spark):
    df = spark.createDataFrame([(p,) for p in ["src/a.py", "src/b.md", "docs/x.md", "x/y.py", "src/c/d.py"]], "path string")
    inc, exc = ["src/**/*", "*.md"], ["*.md"]
    picked = paths.select_paths(df, inc, exc)
    included = paths.select_paths(df, inc, None)
    excluded = paths.select_paths(df, ["*.md"], None)
    assert sorted(picked.collect()) == sorted(included.exceptAll(excluded).collect())


def test_upsert_sources_idempotent(spark):
    sources = spark.createDataFrame([("1", "u1", "github", "https://h/1", "one", "active")],
                                    "id string, user_id string, type string, uri string, name string, status string")
    reqs = spark.createDataFrame([(1, "u1", "github", "https://h/1", "uno"), (2, "u2", "github", "https://h/1", "x"),
                                  (3, "u3", "gitlab", "https://h/2", "two"), (4, "u3", "gitlab", "https://h/2", "dos"),
                                  (5, "u1", "url", "https://h/3", "web")],
                                 "req_seq long, user_id string, type string, uri string, name string")
    snap, out = registry.upsert_sources(reqs, sources, "2024-01-01 00:00:00")
    assert {r.req_seq: (r.outcome, r.valid_type) for r in out.collect()} == {
        1: ("updated", True), 2: ("conflict", True), 3: ("inserted", True), 4: ("updated", True), 5: ("inserted", False)}
    names = {r.uri: r.name for r in snap.collect()}
    assert names == {"https://h/1": "uno", "https://h/2": "dos", "https://h/3": "web"}
    snap2, out2 = registry.upsert_sources(reqs, snap.select("id", "user_id", "type", "uri", "name", "status"), "2024-01-02 00:00:00")
    assert {r.uri: r.name for r in snap2.collect()} == names
    assert "inserted" not in {r.outcome for r in out2.collect()}


def test_cascade_delete_rerun_deletes_nothing(spark):
    repos = spark.createDataFrame([("r1", "u1", None, "https://g/a"), ("r2", "u1", "s2", "https://g/b")],
                                  "id string, user_id string, source_id string, url string")
    sources = spark.createDataFrame([("s2", "https://g/b"), ("s9", "https://g/a")], "id string, uri string")
    nodes = spark.createDataFrame([("Repository", "r1", None, "u1"), ("File", "n1", "s2", "u1"), ("File", "n2", "s2", "u2"),
                                   ("File", "n3", "r2", "u1")], "label string, node_id string, source_id string, owner_id string")
    victims = spark.createDataFrame([("r1",), ("r2",)], "id string")
    new, counts = registry.cascade_delete(victims, repos, sources, nodes)
    assert {r.table_name: r.deleted for r in counts.collect()} == {
        "repositories": 2, "sources": 2, "node:Repository": 1, "node:File": 2}
    assert [r.node_id for r in new["nodes"].collect()] == ["n2"]
    _, again = registry.cascade_delete(victims, new["repositories"], new["sources"], new["nodes"])
    assert again.count() == 0


def test_validate_sources_exclude_default(spark):
    req = spark.createDataFrame([("n", "github", "https://github.com/o/r", None, None, [" ", ""], None)],
                                "name string, type string, uri string, branch string, include_patterns array<string>, "
                                "exclude_patterns array<string>, credentials map<string,string>")
    r = registry.validate_sources(req).first()
    assert r.errors == [] and r.clean_include == ["**/*"] and r.clean_exclude == []


def test_rate_limit_vector(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(seconds=i), "c", "/api/x") for i in range(6)]
    log = spark.createDataFrame(rows, "seq long, ts timestamp, client string, path string")
    out = audit.rate_limit_audit(log, {"default": 2}, window_secs=3, bucket_secs=3)
    got = [(r.request_count, r.rejected) for r in out.orderBy("seq").collect()]
    assert [c for c, _ in got] == [1, 2, 3, 3, 3, 3]
    assert [rej for _, rej in got] == [False, False, True, True, True, True]


def test_rate_limit_ties_follow_arrival(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0, "c", "/api/search") for i in range(4)] + [(9, t0, "c", "/health")]
    out = audit.rate_limit_audit(spark.createDataFrame(rows, "seq long, ts timestamp, client string, path string"),
                                 {"default": 120, "/search": 2}, window_secs=60)
    assert [r.request_count for r in out.orderBy("seq").collect()] == [1, 2, 3, 4]


def test_circuit_breaker(spark):
    seq = ["ok", "fail", "skip", "fail", "ok", "fail", "fail", "skip", "fail", "ok", "ok"]
    df = spark.createDataFrame([("s", i, o) for i, o in enumerate(seq)], "sync_id string, seq long, outcome string")
    r = audit.circuit_breaker_replay(df, threshold=3, block=2).first()
    assert (r.sent, r.failed, r.skipped, r.tripped, r.trip_seq, r.remaining) == (2, 5, 2, True, 8, 4)


def test_running_sum_blocks(spark):
    from quarry.operators.scalable import running_sum
    rows = [("k", i, i % 3) for i in range(50)] + [("j", i, 1) for i in range(7)]
    df = spark.createDataFrame(rows, "key string, seq long, v long")
    got = {(r.key, r.seq): r.acc for r in running_sum(df, ["key"], "seq", "v", "acc", block=4).collect()}
    acc = {}
    for k, s, v in rows:
        acc[k] = acc.get(k, 0) + v
        assert got[(k, s)] == acc[k]


def test_retry_ledger(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", t, 1, 503, None), ("a", t, 2, 503, None), ("a", t, 3, 200, None),
            ("b", t, 1, None, "timeout"), ("b", t, 2, 404, None), ("b", t, 3, 200, None)]
    df = spark.createDataFrame(rows, "request_id string, ts timestamp, seq long, status int, error_kind string")
    got = {r.request_id: (r.attempts, r.total_backoff_s, r.outcome) for r in audit.retry_ledger(df).collect()}
    assert got == {"a": (3, 3.0, "success"), "b": (2, 1.0, "client_error")}


def test_write_and_read_events_roundtrip(spark):
    from quarry.session import checkpoint_path
    from quarry.sources import events as src
    base = checkpoint_path(spark, "test-events", unique=True)
    rows = spark.createDataFrame([("STREAMED_FILE", "r1", "o/r1", "", "a.py", "x", False), ("STREAMED_FILE", "r2", "o/r2", "", "b.py", "", True)],
                                 "event_type string, repo_id string, repo_name string, url string, file_path string, "
                                 "content string, is_deleted boolean")
    rec = src.to_event_records(rows).withColumn("event_type", F.lit("STREAMED_FILE"))
    src.write_events(rec, {"format": "parquet", "path": base + "/log"})
    back = spark.read.parquet(base + "/log")
    assert sorted(r.key for r in back.collect()) == ["r1", "r2"]
    raw = back.select("key", F.encode("value", "UTF-8").alias("value"), "topic", F.lit(0).alias("partition"),
                      F.monotonically_increasing_id().alias("offset"), F.current_timestamp().alias("timestamp"))
    raw.write.parquet(base + "/raw")
    typed, rejects = src.decode_events(src.read_events(spark, {"format": "parquet", "path": base + "/raw"}))
    assert typed["STREAMED_FILE"].count() == 2 and rejects.count() == 0


def test_read_registry_parquet(spark):
    from quarry.session import checkpoint_path
    from quarry.sources.registry import read_registry
    base = checkpoint_path(spark, "test-registry", unique=True)
    spark.createDataFrame([("r1", "u", "github", None)], "repo_id string, user_id string, provider string, expires_at timestamp") \
        .write.parquet(base + "/credential_index")
    df = read_registry(spark, base, "credential_index")
    assert df.columns == ["repo_id", "user_id", "provider", "expires_at"] and df.count() == 1


def test_select_paths_pushes_prefix_into_scan(spark):
    from quarry.session import checkpoint_path
    base = checkpoint_path(spark, "test-pushdown", unique=True)
    spark.createDataFrame([("r", "src/a.py", "s", 1, "x"), ("r", "docs/b.md", "t", 2, "y")],
                          "repo_id string, path string, sha string, size long, extra string").write.parquet(base)
    m = spark.read.parquet(base)
    plan = paths.select_paths(m, ["src/**/*"], None).select("path")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(path,src/)" in plan
    assert "ReadSchema: struct<path:string>" in plan


def test_validate_source_ids(spark):
    req = spark.createDataFrame([("n", "url", "x", None, None, None, None, sid) for sid in ["ok-id_1.2", "bad id", "", "a" * 256]],
                                "name string, type string, uri string, branch string, include_patterns array<string>, "
                                "exclude_patterns array<string>, credentials map<string,string>, source_id string")
    errs = [r.errors for r in registry.validate_sources(req).collect()]
    assert errs == [[], ["source_id_invalid"], ["source_id_required"], ["source_id_too_long"]]


def test_rate_limit_key_folds_slashes(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(0, t0, "c", "/api/a/b"), (1, t0 + dt.timedelta(seconds=1), "c", "/api/a_b")]
    out = audit.rate_limit_audit(spark.createDataFrame(rows, "seq long, ts timestamp, client string, path string"),
                                 {"default": 10}, window_secs=60)
    assert [r.request_count for r in out.orderBy("seq").collect()] == [1, 2]


def test_fetch_totals_downloaded_rule(spark):
    df = spark.createDataFrame([("r", 10, True), ("r", None, True), ("r", 5, False)], "repo_id string, size long, ok boolean")
    assert paths.fetch_totals(df).first().total_size == 15
    assert paths.fetch_totals(df, downloaded_col="ok").first().total_size == 10


def test_upsert_repositories_semantics(spark):
    repos = spark.createDataFrame(
        [("1", "u1", "r", "github", "https://github.com/O/r.git", "main", "active", None, dt.datetime(2024, 1, 1), None),
         ("2", "u1", "r", "github", "https://github.com/o/r", "main", "active", "old", dt.datetime(2024, 2, 1), None)],
        "id string, user_id string, name string, provider string, url string, branch string, status string, "
        "source_id string, created_at timestamp, updated_at timestamp")
    reqs = spark.createDataFrame(
        [(1, "u1", "r", "github", "https://github.com/o/r/", None, "s1"),
         (2, "u2", "r", "github", "https://github.com/o/r", "dev", None),
         (3, "u2", "r", "github", "https://github.com/o/r.git", None, "s2")],
        "req_seq long, user_id string, name string, provider string, url string, branch string, source_id string")
    snap, out = registry.upsert_repositories(reqs, repos, "2024-03-01 00:00:00")
    o = {r.req_seq: (r.outcome, r.delta) for r in out.collect()}
    assert o == {1: ("updated", 0), 2: ("inserted", 1), 3: ("updated", 0)}
    rows = {(r.user_id, r.id if r.user_id == "u1" else "new"): (r.status, r.source_id, r.branch) for r in snap.collect()}
    assert rows[("u1", "1")] == ("validation_in_progress", "s1", "main")   # earliest row of the key is updated
    assert rows[("u1", "2")] == ("active", "old", "main")                   # the duplicate is untouched
    assert rows[("u2", "new")] == ("validation_in_progress", "s2", "dev")


def test_read_checkout_binary_files(spark):
    import os
    from quarry.session import checkpoint_path
    from quarry.sources.manifest import content_manifest, read_checkout
    base = checkpoint_path(spark, "test-checkout", unique=True)
    os.makedirs(f"{base}/src/pkg", exist_ok=True)
    for rel, data in {"src/a.py": b"print(1)\n", "src/pkg/b.md": b"# b\n", "README": b"x"}.items():
        with open(f"{base}/{rel}", "wb") as fh:
            fh.write(data)
    blobs = read_checkout(spark, base, "repo1", glob="*.py")
    got = [(r.path, r.byte_size, r.raw_extension) for r in content_manifest(blobs).collect()]
    assert got == [("src/a.py", 9, "py")]


def test_diff_of_null_shas(spark):
    row = "repo_id string, path string, sha string, size long"
    old = spark.createDataFrame([("r", "same", None, 1), ("r", "grown", None, 1), ("r", "odd", None, None), ("r", "gone", None, 3),
                                 ("r", "known", None, 4)], row)
    new = spark.createDataFrame([("r", "same", None, 1), ("r", "grown", None, 2), ("r", "odd", None, None), ("r", "fresh", None, 3),
                                 ("r", "known", "s", 4)], row)
    got = {r.path: r.change for r in changes.diff_snapshots(old, new).collect()}
    assert got == {"grown": "modified", "odd": "unknown", "gone": "removed", "fresh": "added", "known": "modified"}


def test_connector_globs_and_line_ends(spark, tmp_path):
    import json
    from quarry.sources.connector import RepoDumpSource
    entries = [{"path": p, "type": "blob", "sha": "s", "size": 1} for p in ("src/a.py", "b\u2028c.py", "d.png\n")]
    pages = [{"repo_id": "r", "provider": "github", "page": {"tree": entries}},
             {"repo_id": "g", "provider": "gitlab", "ref": "main", "page": [{"path": "x.py", "type": "blob", "id": "i"}]},
             {"repo_id": "b", "provider": "bitbucket", "page": {"values": [{"path": "y.py", "type": "commit_file", "size": 2, "commit": {"hash": "h"}}]}}]
    (tmp_path / "pages.json").write_text("\n".join(json.dumps(p, ensure_ascii=False) for p in pages))
    spark.dataSource.register(RepoDumpSource)
    read = lambda **o: sorted(r.path for r in spark.read.format("repodump").option("path", str(tmp_path)).options(**o).load().collect())
    assert read(include="src/**/*,**/*") == sorted(["src/a.py", "b\u2028c.py", "d.png\n", "x.py", "y.py"])
    assert read(exclude="src/**/*,**/*") == []
    assert read(include="src/**/*") == ["src/a.py"]


def test_binary_suffix_is_at_the_very_end(spark):
    df = spark.createDataFrame([("a.png",), ("a.png\n",)], "path string")
    assert [r.path for r in paths.drop_binary(df).collect()] == ["a.png\n"]
