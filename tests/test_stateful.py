"""What L4-L6 remember: right over batches in any order, and not for ever."""
import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from quarry.plans import streams
from quarry.session import checkpoint_path
from quarry.streaming import stateful as st

STATUS = "job_id string, ts timestamp, seq long, status string"
CHUNKS = "file_id long, chunk_index int, total_chunks int, chunk_data string, arrived timestamp"
T0 = dt.datetime(2024, 1, 1)


def deliver(spark, base, rows, schema, start):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(base + "/in")
    q = start(spark.readStream.schema(schema).parquet(base + "/in"))
    q.awaitTermination()
    return q


def state_rows(base, spark, column="n"):
    """Rows of the state store after the last batch, and what ``column`` of them holds."""
    found = spark.read.format("statestore").load(base + "/ckpt").collect()
    return [r.value["groupState"] if "groupState" in r.value.asDict() else r.value for r in found]


@pytest.fixture
def few(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_ended_jobs_leave_the_state(few):
    spark, base = few, checkpoint_path(few, "test-l4", unique=True)
    at = lambda k: T0 + dt.timedelta(seconds=k)
    start = lambda s: st.start_status_stream(s, base + "/out", base + "/ckpt", retention_secs=1, buckets=2)
    held = lambda: sum(r["n"] for r in state_rows(base, spark))
    first = [(f"j{i}", at(i), 1, "running") for i in range(10)] + [(None, at(1), 1, "pending")] + [("hot", at(i), i, "running") for i in range(500)]
    deliver(spark, base, first, STATUS, start)
    assert held() == 12
    deliver(spark, base, [(f"j{i}", at(100), 2, "completed") for i in range(8)] + [("j9", at(0), 0, "failed")], STATUS, start)
    assert held() == 12  # just ended: still kept
    time.sleep(1.5)
    deliver(spark, base, [("j8", at(200), 3, "routing"), ("j9", at(200), 3, "routing")], STATUS, start)
    assert held() == 4  # j8, j9 (its late failure didn't end it), hot and the job without an id
    deliver(spark, base, [("j0", at(50), 9, "running"), ("j1", at(500), 9, "running")], STATUS, start)  # after they have gone
    got = {r.job_id: (r.status, r.transitions) for r in st.current_status(spark, base + "/out").collect()}
    want = {f"j{i}": ("completed", 2) for i in range(8)}
    want |= {"j0": ("completed", 3), "j1": ("running", 3), "j8": ("routing", 2), "j9": ("routing", 3), None: ("pending", 1), "hot": ("running", 500)}
    assert got == want


def test_files_are_written_when_complete_or_given_up(few):
    spark, base = few, checkpoint_path(few, "test-l5", unique=True)
    day = lambda k: T0 + dt.timedelta(days=k)
    start = lambda s: st.start_reassembly_stream(s, base + "/out", base + "/ckpt", "arrived", give_up_secs=5 * 86_400, buckets=2)
    deliver(spark, base, [(1, 2, 3, "cc", day(0)), (1, 0, 3, "a", day(0)), (1, 0, 3, "a", day(0)), (2, 0, 2, "x", day(0)), (3, 0, 1, "é", day(0))], CHUNKS, start)
    files = lambda: {r.file_id: (r.chunks_received, r.total_chunks, r.duplicates, r.bytes, r.complete)
                     for r in st.reassembled(spark, base + "/out")[0].collect()}
    assert files() == {3: (1, 1, 0, 2, True)}
    deliver(spark, base, [(1, 1, 3, "bbb", day(1)), (1, 1, 3, "bbb", day(1)), (3, 0, 1, "é", day(1))], CHUNKS, start)
    assert files() == {3: (1, 1, 1, 2, True), 1: (3, 3, 2, 6, True)}
    places = sorted(tuple(r) for r in st.reassembled(spark, base + "/out")[1].collect())
    assert places == [(1, 0, 0, 1), (1, 1, 1, 3), (1, 2, 4, 2), (3, 0, 0, 2)]
    deliver(spark, base, [(None, None, None, None, day(8))], CHUNKS, start)  # a heartbeat
    assert files()[2] == (1, 2, 0, 1, False)
    deliver(spark, base, [(1, 0, 3, "a", day(9)), (2, 1, 2, "y", day(9))], CHUNKS, start)
    assert files()[2] == (1, 2, 1, 1, False)  # after it was given up, a chunk is a re-delivery
    # File 1's mark is over by then: its chunk opens the file anew and is given up; it stays complete.
    deliver(spark, base, [(None, None, None, None, day(40))], CHUNKS, start)
    assert files()[1] == (3, 3, 2, 6, True)
    deliver(spark, base, [(None, None, None, None, day(60))], CHUNKS, start)
    left = [st._unpacked(r["files"], {}).to_dict("records") for r in state_rows(base, spark)]
    assert left == []


def test_redeliveries_are_dropped_and_old_identities_go(few):
    spark, base = few, checkpoint_path(few, "test-l6", unique=True)
    schema = "event_id string, ts timestamp"
    start = lambda s: st.start_dedupe_stream(s, base + "/out", base + "/ckpt", retention_secs=2)
    far = [T0 - dt.timedelta(days=10_000), T0 + dt.timedelta(days=10_000)]  # event times don't matter
    deliver(spark, base, [(f"e{i}", far[i % 2]) for i in range(20)], schema, start)
    deliver(spark, base, [(f"e{i}", far[0]) for i in range(10, 30)], schema, start)
    assert spark.read.parquet(base + "/out").count() == 30
    for k in range(3):
        time.sleep(2.2)
        q = deliver(spark, base, [(f"x{k}", far[0])], schema, start)
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3
    assert spark.read.parquet(base + "/out").count() == 33


def test_identities_take_few_bytes_whatever_their_length(few):
    spark, base = few, checkpoint_path(few, "test-l6-small", unique=True)
    ids = [None, "", "e" * 500, "e" * 499 + "f", "é"]
    for _ in range(2):
        deliver(spark, base, [(i, T0) for i in ids], "event_id string, ts timestamp",
                lambda s: st.start_dedupe_stream(s, base + "/out", base + "/ckpt"))
    assert sorted(r.event_id or "-" for r in spark.read.parquet(base + "/out").collect()) == sorted(i or "-" for i in ids)
    keys = [r.key["_identity"] for r in spark.read.format("statestore").load(base + "/ckpt").collect()]
    assert sorted(len(k) for k in keys if k is not None) == [16] * 4 and len(keys) == 5
    # The state is uploaded in RocksDB's files: none of it is logged and kept in memory until later.
    files = {f.rsplit(".", 1)[-1] for _, _, names in os.walk((base + "/ckpt/state").removeprefix("file:")) for f in names}
    assert "sst" in files and "changelog" not in files


def test_derived_deliveries_are_landed_by_moving_them(spark):
    base = checkpoint_path(spark, "test-landed", unique=True)
    rows = spark.createDataFrame([(i, None if i == 7 else 2 * i) for i in range(20)], "i int, part int")  # deliveries 0 and 2 of 4
    seen = []

    def start(stream):
        left = [f for _, _, names in os.walk((base + "/in-dealt").removeprefix("file:")) for f in names if f.endswith(".parquet")]
        seen.append((spark.read.parquet(base + "/in").select("i").collect(), len(left)))
        return type("Query", (), {"awaitTermination": lambda self: stream.schema})()

    streams._landed(spark, rows.repartition(1), F.col("part"), base + "/in", start, deliveries=4, derived=True)
    parts = [sorted(r.i for r in got) for got, _ in seen]
    assert parts[0] == parts[1] == [i for i in range(0, 20, 2)] and parts[2] == parts[3] == [i for i in range(20) if i != 7]
    assert [n for _, n in seen] == [2, 2, 1, 1]  # of three files; the rows of no delivery stay
