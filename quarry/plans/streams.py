"""Registered streaming jobs: each runs its stream to completion (availableNow) over the
driver tables, checkpointed under ``spark.checkpoint.dir``, and returns the written result.
The oracle is the batch job's SQL: stream and batch must agree."""

from __future__ import annotations

import gc

from pyarrow import fs as pafs
from pyspark.sql import functions as F

from ..operators import changes as chg
from ..session import checkpoint_path
from ..sources import events as src
from ..sources.connector import _file_system
from ..sources.fixtures import Fixtures
from ..streaming import pipelines as pipe
from ..streaming import stateful as st
from . import audit as audit_plans
from . import events as event_plans
from . import webhooks as hook_plans
from .catalog import _ORACLES, register


#: Buckets of the state in the L2, L4 and L5 jobs; results don't depend on it.
STATE_BUCKETS = 8
#: L4 has more when there are more events than this a bucket.
EVENTS_A_BUCKET = 200_000


def _scratch(spark, name):
    return checkpoint_path(spark, name, unique=True)


def _same_oracle(name: str, batch_name: str) -> None:
    """A stream must equal its batch job: reuse the batch job's oracle SQL."""
    _ORACLES[name] = _ORACLES[batch_name]


#: The limiter job's lateness bound; rows come up to half of it late.
LATENESS = 86400


@register("l3_rate_limit_stream", views=["fx_access_log"], oracle=f"""
WITH x AS (SELECT *, epoch_us(ts) AS t FROM fx_access_log),
b AS (SELECT min(t) AS lo, max(t) - min(t) + 1 AS span FROM x),
d AS (SELECT x.*, (t - lo) * 3 // span AS third, lo + ((t - lo) * 3 // span + 1) * span // 3 - t AS ahead FROM x, b),
r AS (SELECT *, third + CASE WHEN third < 2 AND seq % 2 = 0 AND ahead <= {LATENESS // 2 * 1000000} THEN 1 ELSE 0 END AS part,
             replace(path, '/', '_') AS k FROM d WHERE path NOT IN ('/health', '/metrics', '/status')),
c AS (SELECT a.seq, a.client, a.path, a.t, count(*) AS request_count
      FROM r a JOIN r o ON o.client = a.client AND o.k = a.k AND o.t <= a.t AND o.t > a.t - {audit_plans.WINDOW * 1000000}
           AND o.part <= a.part AND (o.t < a.t OR (o.part, o.seq) <= (a.part, a.seq))
      GROUP BY ALL),
l AS (SELECT *, CASE WHEN contains(path, '/search') THEN 4 WHEN contains(path, '/sources') THEN 6
                     WHEN contains(path, '/sync') THEN 3 ELSE 5 END AS rate_limit FROM c)
SELECT seq, client, path, request_count, rate_limit, request_count > rate_limit AS rejected,
       CASE WHEN request_count > rate_limit THEN 0 ELSE greatest(0, rate_limit - request_count) END AS remaining,
       CAST(floor(t / 1000000) AS BIGINT) + {audit_plans.WINDOW} AS reset, FALSE AS late FROM l""")
def l3_rate_limit_stream(spark, sf_dir):
    """The limiter over three deliveries of the log, every other row of a delivery's end coming with
    the next one: a row counts what has arrived by its delivery, whatever its time."""
    log = Fixtures(spark, sf_dir).fx_access_log
    base = _scratch(spark, "l3")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    lo, hi = log.agg(F.min(t), F.max(t)).first()
    span = (hi or 0) - (lo or 0) + 1
    third = F.floor((t - lo) * 3 / span)
    ahead = F.lit(lo) + F.floor((third + 1) * span / 3) - t
    part = third + F.when((third < 2) & (F.col("seq") % 2 == 0) & (ahead <= LATENESS // 2 * 1_000_000), 1).otherwise(0)
    _landed(spark, log, part, base + "/log", lambda rows: st.start_rate_limit_stream(
        rows, base + "/out", base + "/ckpt", base + "/state", audit_plans.LIMITS, audit_plans.WINDOW, trigger={"availableNow": True},
        bucket_secs=86400, lateness_secs=LATENESS))
    return spark.read.parquet(base + "/out").select("seq", "client", "path", "request_count", "rate_limit",
                                                    "rejected", "remaining", "reset", "late")


@register("l4_latest_status_stream")
def l4_latest_status_stream(spark, sf_dir):
    """Latest status per job over the job events, landed in three deliveries out of order."""
    status = Fixtures(spark, sf_dir).fx_job_status_events.select("job_id", "ts", "seq", "status")
    base = _scratch(spark, "l4")
    buckets = max(STATE_BUCKETS, -(-status.count() // EVENTS_A_BUCKET))
    _landed(spark, status, F.col("seq"), base + "/events", lambda rows: st.start_status_stream(
        rows, base + "/out", base + "/ckpt", buckets=buckets))
    return st.current_status(spark, base + "/out")


def _landed(spark, rows, part, path, start, deliveries: int = 3, derived: bool = False) -> None:
    """Land ``rows`` in some deliveries (by ``part`` modulo their number, so each mixes old and new
    rows) and let the stream catch up after each: as many micro-batches, rows out of order.
    ``derived`` rows, which take joins to make, are made once, in a folder for each delivery beside
    ``path``; landing a delivery moves its files. What a delivery shuffled goes before the next."""
    which = F.pmod(part, F.lit(deliveries))
    dealt = path + "-dealt"
    if derived:
        rows.withColumn("_delivery", which).write.option("compression", "zstd").partitionBy("_delivery").parquet(dealt)
    else:
        made = rows.withColumn("_delivery", which)
    for k in range(deliveries):
        if not derived:
            made.filter(F.col("_delivery") == k).drop("_delivery").write.mode("append").parquet(path)
        elif not _moved(f"{dealt}/_delivery={k}", path, f"{k}-"):
            rows.limit(0).write.mode("append").parquet(path)  # an empty delivery
        gc.collect()  # Spark drops shuffle files once their plans are collected, those that Python names too
        spark.sparkContext._jvm.System.gc()
        start(spark.readStream.schema(rows.schema).parquet(path)).awaitTermination()


def _moved(folder: str, to: str, prefix: str) -> int:
    """Move a folder's data files to another one, each under a name with ``prefix``; how many they are."""
    filesystem, at = _file_system(folder)
    found = [f for f in filesystem.get_file_info(pafs.FileSelector(at, allow_not_found=True)) if f.base_name.endswith(".parquet")]
    into = _file_system(to)[1]
    filesystem.create_dir(into, recursive=True)
    for f in found:
        filesystem.move(f.path, f"{into}/{prefix}{f.base_name}")
    return len(found)


@register("l6_dedupe_stream")
def l6_dedupe_stream(spark, sf_dir):
    """Redelivered file events (every tenth twice, in another delivery) de-duplicated as a stream of
    four deliveries."""
    fe = Fixtures(spark, sf_dir).fx_file_events
    off = F.col("off")
    rows = fe.withColumn("_part", F.explode(F.when(off % 10 == 0, F.array(off, off + 1)).otherwise(F.array(off))))
    base = _scratch(spark, "l6")
    _landed(spark, rows, F.col("_part"), base + "/topic", lambda ev: st.start_dedupe_stream(
        ev.drop("_part"), base + "/out", base + "/ckpt", id_col=None), deliveries=4, derived=True)
    out = spark.read.parquet(base + "/out")
    return out.select("repo_id", "file_path", "off", "is_deleted", F.sha2("content", 256).alias("content_sha"))


@register("l5_reassemble_stream")
def l5_reassemble_stream(spark, sf_dir):
    """File chunks (some lost, some twice) landed out of order in three deliveries, and a heartbeat
    long after: files are written as they complete, the others when they are given up."""
    chunks = audit_plans._chunks(Fixtures(spark, sf_dir))
    base = _scratch(spark, "l5")
    day = lambda k: F.timestamp_seconds(F.lit(86_400 * k))
    part = F.pmod(F.xxhash64("file_id", "chunk_index"), F.lit(3))
    rows = chunks.withColumn("_part", part).withColumn("arrived", F.timestamp_seconds(86_400 * (part + 1)))

    def start(landed):
        return st.start_reassembly_stream(landed.drop("_part"), base + "/out", base + "/ckpt", "arrived", give_up_secs=10 * 86_400,
                                          buckets=STATE_BUCKETS)

    _landed(spark, rows, F.col("_part"), base + "/chunks", start, derived=True)
    beat = rows.limit(0).unionByName(spark.range(1).select(F.lit(3).alias("_part"), day(100).alias("arrived")), allowMissingColumns=True)
    beat.write.mode("append").parquet(base + "/chunks")
    start(spark.readStream.schema(rows.schema).parquet(base + "/chunks")).awaitTermination()
    return st.reassembled(spark, base + "/out")[0]


@register("l1_webhook_stream")
def l1_webhook_stream(spark, sf_dir):
    """Webhook deliveries (derived from the events table) landed three times -> REPO_UPDATED."""
    fx = Fixtures(spark, sf_dir)
    base = _scratch(spark, "l1")
    # One row a source, looked for in all events once, not in each micro-batch.
    hook_plans._secrets(fx).write.parquet(base + "/secrets")
    secrets = spark.read.parquet(base + "/secrets")

    def start(events):
        deliveries, _ = hook_plans._deliveries(fx, fx.derive("fx_webhooks", events=events), secrets)
        return pipe.start_webhook_stream(deliveries, secrets, fx.fx_hook_repos, fx.fx_credentials, base + "/out",
                                         base + "/ckpt", hook_plans.NOW, {"availableNow": True})

    _landed(spark, fx.events, F.xxhash64("event_id"), base + "/events", start)
    ev = spark.read.parquet(base + "/out/events")
    return ev.select("event_type", "event_id", "payload.repo_id", "payload.provider", "payload.branch",
                     "payload.old_commit", "payload.new_commit", "payload.update_type")


@register("l2_update_stream", views=["fx_snap_new"], oracle="""
SELECT n.repo_id, n.path AS file_path, sha256(d.text) AS content_sha
FROM fx_snap_new n JOIN documents d ON d.doc_id = n.doc_id WHERE NOT {binary}""".format(
    binary=__import__("quarry.plans.sqlbits", fromlist=["is_binary"]).is_binary("n.path")))
def l2_update_stream(spark, sf_dir):
    """Two REPO_UPDATED per repository (old -> mid -> new snapshot), landed in three deliveries so
    that the later update often comes first; the stored state ends at the new snapshot."""
    from ..functions.paths import is_binary
    from ..operators import events as ev_ops
    fx = Fixtures(spark, sf_dir)
    base = _scratch(spark, "l2")
    old, new = fx.fx_snap_old, fx.fx_snap_new
    d = F.col("doc_id")
    # Between the two snapshots: every fifth file has another content, even ones are still as they
    # were, and every ninth has a copy that goes again.
    mid = (new.filter(d % 5 == 0).withColumn("sha", F.concat(F.lit("m"), F.coalesce("sha", F.lit(""))))
           .unionByName(old.filter((d % 5 != 0) & (d % 2 == 0))).unionByName(new.filter((d % 5 != 0) & (d % 2 != 0)))
           .unionByName(new.filter(d % 9 == 0).withColumns({"path": F.concat(F.lit("tmp/"), "path"), "sha": F.concat(F.lit("t"), F.coalesce("sha", F.lit("")))})))
    # Compare results are landed once; micro-batches read them instead of comparing again.
    for a, b, commit in ((old, mid, "mid"), (mid, new, "new")):
        chg.diff_snapshots(a, b).withColumn("new_commit", F.lit(commit)).write.mode("append").parquet(base + "/diffs")
    diffs = spark.read.parquet(base + "/diffs")
    texts = fx.documents.select("doc_id", "text")
    blob = lambda snap, commit, text: (snap.select("doc_id", "repo_id", "path").join(texts, "doc_id")
                                       .select("repo_id", F.lit(commit).alias("commit"), "path", F.encode(text, "UTF-8").alias("content")))
    changed = F.when((d % 5 == 0) & ~F.col("path").startswith("tmp/"), F.concat("text", F.lit(" mid"))).otherwise(F.col("text"))
    blobs = blob(mid, "mid", changed).unionByName(blob(new, "new", F.col("text")))
    n = F.regexp_extract("repo_id", r"(\d+)$", 1).cast("bigint")
    steps = F.explode(F.array(F.struct(F.lit("old").alias("a"), F.lit("mid").alias("b"), F.lit(0).alias("k")),
                              F.struct(F.lit("mid").alias("a"), F.lit("new").alias("b"), F.lit(1).alias("k")))).alias("s")
    env = new.select("repo_id").distinct().select("repo_id", n.alias("n"), steps).select(
        F.lit("REPO_UPDATED").alias("event_type"), F.sha2(F.concat(F.lit("upd:"), "repo_id", "s.b"), 256).alias("event_id"),
        F.lit("2024-01-01T00:00:00+00:00").alias("timestamp"), F.lit(None).cast("string").alias("correlation_id"),
        F.struct(F.col("repo_id"), F.concat(F.lit("https://github.com/org/"), "repo_id").alias("url"),
                 F.lit("main").alias("branch"), F.lit("github").alias("provider"),
                 F.col("s.a").alias("old_commit"), F.col("s.b").alias("new_commit"),
                 F.lit("ref").alias("credential_ref"), F.lit("push").alias("update_type")).alias("payload"),
        (2 * F.col("n") + F.col("s.k")).alias("offset"))
    value = F.to_json(F.struct("event_type", "event_id", "timestamp", "correlation_id", "payload"))
    rec = env.select(F.col("payload.repo_id").alias("key"), F.encode(value, "UTF-8").alias("value"), F.lit(src.DEFAULT_TOPIC).alias("topic"),
                     F.lit(0).alias("partition"), "offset", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("timestamp"))
    state = (old.filter(~is_binary("path")).select("doc_id", "repo_id", F.col("path").alias("file_path"))
             .join(texts, "doc_id").select("repo_id", "file_path", F.col("text").alias("content"), F.lit(-1).cast("bigint").alias("off")))
    ev_ops.write_file_state(state, base + "/state", STATE_BUCKETS)
    _landed(spark, rec, F.xxhash64("offset"), base + "/topic", lambda records: pipe.start_update_stream(
        records, diffs, blobs, event_plans._repos_for(new), base + "/out", base + "/ckpt", trigger={"availableNow": True},
        state_path=base + "/state", buckets=STATE_BUCKETS))
    state = ev_ops.read_file_state(spark, base + "/state")
    return state.select("repo_id", "file_path", F.sha2("content", 256).alias("content_sha"))


@register("l7_polling_stream", views=["fx_commit_files"], oracle="""
WITH e AS (SELECT repo_id, path, commit_ts, commit_seq,
                  row_number() OVER (PARTITION BY repo_id, commit_seq ORDER BY path, status, previous_path NULLS FIRST) - 1 AS file_seq,
                  CASE status WHEN 'added' THEN 'created' WHEN 'modified' THEN 'modified' WHEN 'removed' THEN 'deleted'
                              WHEN 'renamed' THEN 'moved' ELSE 'modified' END AS event_type FROM fx_commit_files),
r AS (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY commit_ts DESC, commit_seq DESC, file_seq DESC, event_type DESC) AS rn,
             count(*) OVER (PARTITION BY repo_id, path) AS events FROM e)
SELECT repo_id, path, event_type, events FROM r WHERE rn = 1""")
def l7_polling_stream(spark, sf_dir):
    """Landed commit logs polled as a stream; net status per path."""
    from . import changes as change_plans
    fx = Fixtures(spark, sf_dir)
    base = _scratch(spark, "l7")
    _landed(spark, change_plans._commits(fx), F.col("commit_seq"), base + "/commits", lambda commits: pipe.start_polling(
        commits, base + "/out", base + "/ckpt", trigger={"availableNow": True}), derived=True)
    return pipe.current_changes(spark, base + "/out").select("repo_id", "path", "event_type", "events")


_same_oracle("l6_dedupe_stream", "l6_dedupe_events")
_same_oracle("l1_webhook_stream", "l1_webhook_updates")
_same_oracle("l5_reassemble_stream", "l5_reassemble_files")
_ORACLES["l4_latest_status_stream"] = _ORACLES["g5_job_summary"].replace(
    """SELECT job_id, arg_max(status, (ts, seq, status)) AS status,
       max(ts) FILTER (WHERE status IN ('running', 'processing')) AS started_at,
       max(ts) FILTER (WHERE status IN ('completed', 'failed', 'cancelled')) AS completed_at,
       count(*) AS transitions""", "SELECT job_id, arg_max(status, (ts, seq, status)) AS status, max(ts) AS status_ts, count(*) AS transitions")
