"""Stream = batch: streaming jobs over several micro-batches and a restart from checkpoint."""

import datetime as dt
import time

from pyspark.sql import functions as F

from quarry.operators import audit, events
from quarry.session import checkpoint_path
from quarry.streaming import stateful
from quarry.streaming.common import run_handler, write_batch

LOG = "seq long, ts timestamp, client string, path string"


def _log_rows(start, n, t0):
    return [(i, t0 + dt.timedelta(seconds=7 * i), f"c{i % 2}", "/api/search" if i % 3 else "/api/sources")
            for i in range(start, start + n)]


def test_limiter_stream_equals_batch_across_batches_and_restart(spark):
    base = checkpoint_path(spark, "test-limiter", unique=True)
    t0 = dt.datetime(2024, 1, 1)
    parts = [_log_rows(0, 40, t0), _log_rows(40, 40, t0), _log_rows(80, 40, t0)]
    schema = spark.createDataFrame([], LOG).schema

    def run(n_files):
        for i in range(n_files):
            path = f"{base}/in/part{i}"
            import os
            if not os.path.exists(path):
                spark.createDataFrame(parts[i], LOG).coalesce(1).write.parquet(path)
                time.sleep(1.1)  # distinct modification times keep file order
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1) \
            .option("recursiveFileLookup", "true").parquet(f"{base}/in")
        q = stateful.start_rate_limit_stream(stream, f"{base}/out", f"{base}/ckpt", f"{base}/state",
                                             {"default": 5, "/search": 3, "/sources": 4}, window_secs=60,
                                             trigger={"availableNow": True}, bucket_secs=120)
        q.awaitTermination()
        return q

    q = run(2)
    assert len([p for p in q.recentProgress if p["numInputRows"] > 0]) >= 2
    run(3)  # restart from the checkpoint: only the new file is read
    got = {r.seq: r.request_count for r in spark.read.parquet(f"{base}/out").collect()}
    batch = audit.rate_limit_audit(spark.createDataFrame(parts[0] + parts[1] + parts[2], LOG),
                                   {"default": 5, "/search": 3, "/sources": 4}, window_secs=60)
    want = {r.seq: r.request_count for r in batch.collect()}
    assert got == want


def test_dedupe_stream_across_batches(spark):
    base = checkpoint_path(spark, "test-dedupe", unique=True)
    t0 = dt.datetime(2024, 1, 1)
    rows = [("r", f"p{i}", i, False, f"c{i}", t0 + dt.timedelta(minutes=i)) for i in range(10)]
    schema = "repo_id string, file_path string, off long, is_deleted boolean, content string, ts timestamp"
    spark.createDataFrame(rows[:6], schema).coalesce(1).write.parquet(f"{base}/in/a")
    time.sleep(1.1)
    spark.createDataFrame(rows[4:], schema).coalesce(1).write.parquet(f"{base}/in/b")  # 4, 5 redelivered
    s = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1) \
        .option("recursiveFileLookup", "true").parquet(f"{base}/in")
    stateful.start_dedupe_stream(s, f"{base}/out", f"{base}/ckpt", id_col=None).awaitTermination()
    assert sorted(r.off for r in spark.read.parquet(f"{base}/out").collect()) == list(range(10))


def test_identity_keeps_nulls_apart(spark):
    rows = [(None, "x", 1, False, "c"), ("x", None, 1, False, "c"), ("x", None, 1, False, "c"), ("x", None, 1, None, "c"),
            ("x", "", 1, False, None), ("x", "", 1, False, "")]
    df = spark.createDataFrame(rows, "repo_id string, file_path string, off long, is_deleted boolean, content string")
    assert events.dedupe_events(df, id_col=None).count() == 5


def test_handler_errors_go_to_error_hook(spark):
    base = checkpoint_path(spark, "test-handler", unique=True)
    spark.createDataFrame([(1,), (2,)], "x long").write.parquet(f"{base}/in")
    s = spark.readStream.schema("x long").parquet(f"{base}/in")
    seen = []

    def handle(df, batch_id):
        raise ValueError("downstream down")

    def on_error(df, batch_id, exc):
        write_batch(df.withColumn("error", F.lit(str(exc))), f"{base}/dlq", batch_id)
        seen.append(batch_id)

    run_handler(s, handle, on_error, f"{base}/ckpt", {"availableNow": True}).awaitTermination()
    assert seen == [0]
    assert spark.read.parquet(f"{base}/dlq").count() == 2


def test_file_state_two_batches_equal_one(spark):
    rows = [("r", "a", 1, False, "a1"), ("r", "a", 5, True, ""), ("r", "b", 2, False, "b1"), ("r", "b", 6, False, "b2"),
            ("r", "c", 3, False, "c1")]
    ev = spark.createDataFrame(rows, "repo_id string, file_path string, off long, is_deleted boolean, content string")
    one = events.apply_file_events(None, ev)
    two = events.apply_file_events(events.apply_file_events(None, ev.filter("off < 4")), ev.filter("off >= 4"))
    assert sorted(one.collect()) == sorted(two.collect())
    assert sorted((r.file_path, r.content) for r in one.collect()) == [("b", "b2"), ("c", "c1")]


STATE = "repo_id string, file_path string, off long, is_deleted boolean, content string"


def test_events_of_one_offset_and_missing_flag(spark):
    rows = [("r", "a", 5, True, ""), ("r", "a", 5, False, ""), ("r", "b", 1, None, "kept")]
    got = events.apply_file_events(None, spark.createDataFrame(rows, STATE)).collect()
    assert sorted((r.file_path, r.content) for r in got) == [("a", ""), ("b", "kept")]


def test_polling_folds_batches_in_any_order(spark):
    from quarry.streaming import pipelines
    base = checkpoint_path(spark, "test-poll", unique=True)
    schema = "repo_id string, commit_seq long, commit_ts timestamp, files array<struct<filename:string,status:string,previous_filename:string,sha:string>>"
    t = dt.datetime(2024, 1, 1)
    for seq, status in ((2, "removed"), (1, "added")):  # the newer commit arrives first
        spark.createDataFrame([("r", seq, t + dt.timedelta(seq), [("p", status, None, "s")])], schema).write.mode("append").parquet(f"{base}/in")
        s = spark.readStream.schema(schema).parquet(f"{base}/in")
        pipelines.start_polling(s, f"{base}/out", f"{base}/ckpt", trigger={"availableNow": True}).awaitTermination()
    assert [(r.path, r.event_type, r.events) for r in pipelines.current_changes(spark, f"{base}/out").collect()] == [("p", "deleted", 2)]


def test_webhooks_without_a_key_are_dealt_over_the_tasks(spark):
    """Deliveries that match nothing have null join keys: no task may get them all."""
    from quarry.operators import webhooks

    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")
    before = {n: spark.conf.get(n) for n in names}
    url = F.concat(F.lit("https://github.com/org/r"), F.col("id") % 100)
    body = F.concat(F.lit('{"ref":"refs/heads/main","before":"'), F.repeat(F.lit("a"), 40), F.lit('","after":"'), F.repeat(F.lit("b"), 40),
                    F.lit('","repository":{"clone_url":"'), url, F.lit('"}}'))
    # Every tenth delivery has a secret, and no URL is in the table but for the empty ones.
    rows = spark.range(4000).select(
        F.col("id").alias("delivery_id"), F.lit("gitlab").alias("provider"), F.concat(F.lit("s"), F.col("id") % 10).alias("source_id"),
        F.create_map(F.lit("x-gitlab-token"), F.lit("k")).alias("headers"), F.encode(body, "UTF-8").alias("body"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("received_at"))
    secrets = spark.range(10).select(F.concat(F.lit("s"), "id").alias("source_id"), F.when(F.col("id") == 0, F.lit("k")).alias("secret"))
    repos = spark.createDataFrame([(7, "", 1), (8, None, 2), (9, "https://github.com/org/other", 3)], "id long, url string, created_at long")
    creds = spark.createDataFrame([(9, "github", None), (None, "github", None)], "repo_id long, provider string, expires_at timestamp")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        out = webhooks.webhook_outcomes(rows, secrets, repos, creds, "2024-01-15 00:00:00")
        assert not [c for c in out.columns if c.startswith("_")]
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == 4000 and max(sizes) < 1000, sizes
        # As before, those without a URL meet a repository with an empty one; the reason comes first.
        assert {(r.reason, r.repository_id) for r in out.select("reason", "repository_id").distinct().collect()} == {("no_secret", 7), ("ignored", 7)}
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
