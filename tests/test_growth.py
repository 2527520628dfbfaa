"""Steps whose time or memory must grow no faster than the input."""

import datetime as dt

from pyspark.sql import functions as F

from quarry.plans import catalog, streams
from quarry.session import checkpoint_path
from quarry.sources import events as src
from quarry.sources import versioned as V


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_other_types_are_decoded_in_one_pass(spark, tmp_path):
    spark.range(1, 63).select(F.col("id").alias("o_orderkey"), (F.col("id") * 3).alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    out = catalog.queries()["a5_decode_other_types"](spark, str(tmp_path))
    assert plan_of(out).count("FileScan") == 1
    got = {r.offset: (r.type, r.ref, r.number, r.error) for r in out.collect()}
    assert len(got) == 62 and got[12] == ("REPO_INGEST_COMPLETED", "12", 36, None) and got[9] == ("EMBEDDING_GENERATED", "9", 2, None)
    assert got[31] == ("REPO_INGEST_REQUESTED", "31", None, "missing_required:payload.url")
    assert got[62] == ("REPO_INGEST_COMPLETED", "62", 186, "missing_required:payload.repo_id")


def test_one_frame_of_events_is_the_split_ones(spark):
    rows = [("a", b'{"event_type":"STREAMED_FILE","repo_id":"r","file_path":"p","content":"","repo_name":"n","url":""}'),
            ("b", b'{"event_type":"REPO_INGEST_COMPLETED","payload":{"repo_id":"r","stats":{"files_processed":3}}}'),
            ("c", b'{"event_type":"STREAMED_FILE","repo_id":"r"}'), ("d", b"{"), ("e", b'{"event_type":"X"}'), ("f", b""), ("g", None)]
    raw = spark.createDataFrame(rows, "key string, value binary")
    types = ["STREAMED_FILE", "REPO_INGEST_COMPLETED"]
    typed, rejects = src.decode_events(raw, types)
    one = {r.key: r for r in src.decode_events(raw, types, split=False).collect()}
    assert set(one) == {"a", "b", "c", "d", "e"}
    assert {r.key: r.error for r in rejects.collect()} == {k: r.error for k, r in one.items() if r.error}
    for t in types:
        for r in typed[t].collect():
            assert one[r.key].event_type == t and one[r.key].error is None
            assert {k: v for k, v in r.asDict().items() if k != "key"}.items() <= one[r.key].event.asDict().items()


def counted(spark, df, column):
    """The rows, and a counter of how often one of them is made."""
    made = spark.sparkContext.accumulator(0)

    def count(x):
        made.add(1)
        return x
    return df.withColumn(column, F.udf(count, df.schema[column].dataType)(column)), made


def test_a_commit_makes_its_upserts_and_deletes_once(spark):
    path = checkpoint_path(spark, "test-once", unique=True)
    keys, n = {"t": ["id"]}, {"t": 3}
    v1 = V.commit(V.snapshot(spark, path), {"t": V.Change(replace=spark.range(30).withColumn("x", F.lit(0)))}, keys, n)
    rows, made = counted(spark, spark.range(20, 40).withColumn("x", F.lit(1)), "id")
    v2 = V.commit(v1, {"t": V.Change(upserts=rows)}, keys, n)
    assert made.value == 20
    gone, made = counted(spark, spark.range(5), "id")
    v3 = V.commit(v2, {"t": V.Change(deletes=gone)}, keys, n)
    assert made.value == 5
    assert {r.id: r.x for r in v3.read("t").collect()} == {i: int(i >= 20) for i in range(5, 40)}


def test_a_commit_leaves_frames_kept_by_others(spark):
    path = checkpoint_path(spark, "test-kept", unique=True)
    rows = spark.range(7, 12).persist()
    V.commit(V.snapshot(spark, path), {"t": V.Change(upserts=rows)}, {"t": ["id"]}, {"t": 2})
    assert rows.storageLevel.useMemory
    rows.unpersist()


def test_the_sink_has_more_tasks_for_more_values(spark):
    base = checkpoint_path(spark, "test-sink", unique=True)
    rows = spark.range(2000).select(F.lit("r").alias("repo_id"), F.lit("STREAMED_FILE").alias("event_type"), F.col("id").alias("off"))
    rec = src.to_event_records(rows).withColumn("off", F.get_json_object("value", "$.off").cast("long"))
    src.write_events(rec, {"path": base, "task_mb": 0.005}, order_col="off")
    back = spark.read.parquet(base).withColumn("f", F.col("_metadata.file_path"))
    ranges = sorted((r.lo, r.hi, r.n) for r in back.groupBy("f").agg(F.min("off").alias("lo"), F.max("off").alias("hi"), F.count("*").alias("n")).collect())
    assert len(ranges) > 8 and sum(n for _, _, n in ranges) == 2000  # shuffle partitions: 8
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))


def test_status_buckets_follow_the_events(spark, tmp_path, monkeypatch):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(o, n, t0 + dt.timedelta(hours=n), "R" if n == 4 else "N", 1.0) for o in range(15) for n in range(1, 5)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_shipdate timestamp, l_returnflag string, l_quantity double") \
        .write.parquet(f"{tmp_path}/lineitem.parquet")
    asked, start = [], streams.st.start_status_stream
    monkeypatch.setattr(streams.st, "start_status_stream", lambda *a, **k: asked.append(k["buckets"]) or start(*a, **k))
    monkeypatch.setattr(streams, "EVENTS_A_BUCKET", 5, raising=False)
    out = catalog.queries()["l4_latest_status_stream"](spark, str(tmp_path))
    assert {(r.job_id, r.status, r.transitions) for r in out.collect()} == {(o, "failed", 4) for o in range(15)}
    assert asked == [12, 12, 12]


def test_derived_rows_are_made_once_for_all_deliveries(spark):
    class Ended:
        def awaitTermination(self):
            pass
    base = checkpoint_path(spark, "test-landed", unique=True)
    rows, made = counted(spark, spark.range(30).withColumn("part", F.when(F.col("id") != 7, F.col("id"))), "id")
    seen = []
    streams._landed(spark, rows, F.col("part"), base + "/in", lambda stream: seen.append(spark.read.parquet(base + "/in").count()) or Ended(),
                    derived=True)
    assert made.value == 30 and seen == [10, 19, 29]  # a row without a part is in no delivery
    got = spark.read.parquet(base + "/in")
    assert got.columns == ["id", "part"] and {r.id for r in got.collect()} == set(range(30)) - {7}
