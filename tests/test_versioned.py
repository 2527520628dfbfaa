"""Versioned tables: atomic commits, pinned readers, retries and conflicts."""
import glob
import os

import pytest
from pyspark.sql import functions as F

from quarry.operators import events
from quarry.session import checkpoint_path
from quarry.sources import versioned as V

STATE = "repo_id string, file_path string, off long, is_deleted boolean, content string"
KEYS, N = {"a": ["k"], "b": ["k"]}, {"a": 4, "b": 3}


def rows(spark, *values):
    return spark.createDataFrame(list(values), "k string, v int")


def seen(snap, name):
    return {r.k: r.v for r in snap.read(name).collect()}


@pytest.fixture
def store(spark):
    path = checkpoint_path(spark, "test-versions", unique=True)
    first = rows(spark, *[(f"k{i}", i) for i in range(20)], (None, -1))
    V.commit(V.snapshot(spark, path), {"a": V.Change(replace=first), "b": V.Change(replace=first)}, KEYS, N)
    return path


def test_readers_see_one_version_of_all_tables(spark, store, monkeypatch):
    """A writer killed after its files are written, and before its rename: the old version stays."""
    old = V.snapshot(spark, store)
    before = seen(old, "a")
    publish = V._publish

    def killed(*args):
        raise KeyboardInterrupt("killed before the rename")

    monkeypatch.setattr(V, "_publish", killed)
    change = {"a": V.Change(upserts=rows(spark, ("k1", 100), ("new", 7))), "b": V.Change(deletes=rows(spark, ("k2", 0), (None, 0)))}
    with pytest.raises(KeyboardInterrupt):
        V.commit(old, change, KEYS, N)
    half = glob.glob(f"{store}/data/*-2-*".replace("file:", ""))
    assert len(half) == 2  # both tables' files are there, and no reader sees them
    now = V.snapshot(spark, store)
    assert now.version == 1 and seen(now, "a") == before and seen(now, "b") == before
    monkeypatch.setattr(V, "_publish", publish)
    new = V.commit(now, change, KEYS, N)
    assert seen(new, "a") == before | {"k1": 100, "new": 7}
    assert seen(new, "b") == {k: v for k, v in before.items() if k not in ("k2", None)}
    assert seen(old, "a") == before and seen(V.snapshot(spark, store, 1), "b") == before  # pinned


def test_killed_in_the_second_table(spark, store, monkeypatch):
    write = V._write_buckets

    def fails(df, path, folder, *rest):
        if "/b-" in folder:
            raise OSError("disk gone")
        return write(df, path, folder, *rest)

    monkeypatch.setattr(V, "_write_buckets", fails)
    base = V.snapshot(spark, store)
    with pytest.raises(OSError):
        V.commit(base, {t: V.Change(upserts=rows(spark, ("k1", 100))) for t in "ab"}, KEYS, N)
    assert V.versions(spark, store) == [1] and seen(V.snapshot(spark, store), "a")["k1"] == 1


def test_second_writer_conflicts_and_tries_again(spark, store):
    one, two = V.snapshot(spark, store), V.snapshot(spark, store)
    V.commit(one, {"a": V.Change(upserts=rows(spark, ("k1", 100)))}, KEYS, N)
    late = {"a": V.Change(upserts=rows(spark, ("k2", 200)))}
    with pytest.raises(V.Conflict):
        V.commit(two, late, KEYS, N)
    got = seen(V.commit(V.snapshot(spark, store), late, KEYS, N), "a")
    assert got["k1"] == 100 and got["k2"] == 200
    assert not glob.glob(f"{store}/versions/*.tmp".replace("file:", ""))


def test_only_touched_buckets_are_written(spark, store):
    base = V.snapshot(spark, store)
    new = V.commit(base, {"a": V.Change(upserts=rows(spark, ("k1", 100)))}, KEYS, N)
    changed = [b for b, f in new.tables["a"]["folders"].items() if f != base.tables["a"]["folders"].get(b)]
    assert len(changed) == 1 and new.tables["b"] == base.tables["b"]


def test_emptied_bucket_and_new_table(spark, store):
    base = V.snapshot(spark, store)
    everything = base.read("a").select("k")
    new = V.commit(base, {"a": V.Change(deletes=everything), "c": V.Change(upserts=rows(spark, ("x", 1)))}, {"c": ["k"]}, {"c": 2})
    assert new.read("a").count() == 0 and new.read("a").columns == ["k", "v"] and seen(new, "c") == {"x": 1}


def test_retried_batch_is_applied_once(spark, store):
    add = lambda cur, new: cur.unionByName(new).groupBy("k").agg(F.sum("v").cast("int").alias("v"))  # noqa: E731  not idempotent
    change = {"a": V.Change(upserts=rows(spark, ("k3", 10)), merge=add)}
    for batch in (0, 0, 1, 1, 0):
        V.commit(V.snapshot(spark, store), change, KEYS, N, applied={"stream": batch})
    assert seen(V.snapshot(spark, store), "a")["k3"] == 23
    assert V.versions(spark, store) == [1, 2, 3]


def test_vacuum_keeps_what_kept_versions_name(spark, store):
    for i in range(4):
        V.commit(V.snapshot(spark, store), {"a": V.Change(upserts=rows(spark, ("k1", 100 + i)))}, KEYS, N)
    held = V.snapshot(spark, store, 4)
    under_way = f"{store}/data/a-6-underway"
    rows(spark, ("k1", 0)).write.parquet(under_way)
    assert len(V.vacuum(spark, store, keep=2)) == 3
    assert V.versions(spark, store) == [4, 5]
    assert seen(held, "a")["k1"] == 102 and seen(V.snapshot(spark, store), "a")["k1"] == 103
    assert spark.read.parquet(under_way).count() == 1


def test_merge_file_state_rewrites_touched_buckets(spark):
    path = checkpoint_path(spark, "test-state", unique=True)
    start = spark.createDataFrame([(f"r{i}", "a", 0, False, "v0") for i in range(20)], STATE)
    events.write_file_state(start.drop("is_deleted"), path, buckets=8)
    b1 = spark.createDataFrame([("r1", "a", 5, True, ""), ("r2", "b", 5, False, "new")], STATE)
    events.merge_file_state(spark, path, b1, buckets=8)
    late = spark.createDataFrame([("r1", "a", 3, False, "stale")], STATE)  # older than the tombstone
    events.merge_file_state(spark, path, late, buckets=8)
    events.merge_file_state(spark, path, b1, buckets=8)  # again: no change
    live = {(r.repo_id, r.file_path): r.content for r in events.read_file_state(spark, path).collect()}
    want = {(f"r{i}", "a"): "v0" for i in range(20) if i != 1}
    assert live == want | {("r2", "b"): "new"}
    assert events.read_file_state(spark, path, version=1).count() == 20
    assert V.snapshot(spark, path).read("files").count() == 21  # r1/a is kept as a tombstone


def test_unreadable_state_fails_the_merge_and_stays(spark):
    path = checkpoint_path(spark, "test-broken", unique=True)
    events.write_file_state(spark.createDataFrame([(f"r{i}", "a", 0, False, "v0") for i in range(50)], STATE), path, buckets=1)
    folder = V.snapshot(spark, path).tables["files"]["folders"]["0"]
    stray = f"{path}/{folder}/part-stray.parquet".removeprefix("file:")
    with open(stray, "w") as f:
        f.write("not parquet")
    b1 = spark.createDataFrame([("r1", "a", 5, False, "new")], STATE)
    with pytest.raises(Exception):
        events.merge_file_state(spark, path, b1, buckets=1)
    os.rename(stray, f"{path}/stray".removeprefix("file:"))
    assert events.read_file_state(spark, path).count() == 50
