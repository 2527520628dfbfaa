"""Streaming jobs built from the batch jobs (L1 webhooks, L2 updates, L7 polling)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import changes as chg
from ..operators import events as ev
from ..operators import webhooks as wh
from ..sources import events as src
from .common import run_handler, write_batch


def start_webhook_stream(deliveries: DataFrame, secrets: DataFrame, repos: DataFrame, creds: DataFrame,
                         out_path: str, checkpoint: str, now: Column | str, trigger: dict | None = None) -> StreamingQuery:
    """L1: webhook deliveries -> REPO_UPDATED events (``out_path/events``) and rejects
    (``out_path/rejects``). Dimensions are static DataFrames joined per micro-batch."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        # Two outputs from one micro-batch: the per-delivery outcome (authentication,
        # parsing, matching) is computed once and kept for the second write.
        # What neither output needs, bodies above all, is not kept nor sent through the joins.
        outcome = wh.webhook_outcomes(batch, secrets, repos, creds, now).select(
            "delivery_id", "received_at", "provider", "repository_id", "repo_url", "branch", "old_commit", "new_commit", "reason").persist()
        try:
            write_batch(wh.repo_updated_events(outcome.filter(F.col("reason").isNull())), out_path + "/events", batch_id)
            write_batch(outcome.filter(F.col("reason").isNotNull()).select("delivery_id", "reason"),
                        out_path + "/rejects", batch_id)
        finally:
            outcome.unpersist()
    return run_handler(deliveries, handle, None, checkpoint, trigger, name=None)


def start_update_stream(records: DataFrame, diffs: DataFrame, blobs: DataFrame, repos: DataFrame,
                        out_path: str, checkpoint: str, dlq_topic: str | None = None,
                        trigger: dict | None = None, state_path: str | None = None,
                        buckets: int = 1) -> StreamingQuery:
    """L2: REPO_UPDATED records -> landed diff entries for (repo, new commit) -> STREAMED_FILE
    events with increasing offsets -> ``out_path/file_events``; undecodable records ->
    ``out_path/dlq`` in the same micro-batch. With ``state_path`` every batch is also merged
    into a stored current-state table of ``buckets`` (only touched ones are rewritten, as a new
    version that records the batch);
    without it ``current_file_state`` folds the written events on read.

    ``diffs``: repo_id, new_commit, path, change, old_path (landed compare results).
    ``blobs``: repo_id, commit, path, content.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            _apply(batch, batch_id)
        finally:
            batch.unpersist()

    def _apply(batch: DataFrame, batch_id: int) -> None:
        typed, rejects = src.decode_events(batch, types=["REPO_UPDATED"])
        upd = typed["REPO_UPDATED"].select("offset", F.col("payload.repo_id").alias("repo_id"),
                                           F.col("payload.new_commit").alias("new_commit"))
        ch = upd.join(diffs, ["repo_id", "new_commit"], "inner").withColumnRenamed("new_commit", "commit")
        fe = ev.to_file_events(ch, blobs, repos, match_cols=["commit"], carry=["offset"])
        fe = fe.withColumnRenamed("offset", "off")
        write_batch(fe, out_path + "/file_events", batch_id)
        if state_path:
            spark = batch.sparkSession
            written = spark.read.parquet(f"{out_path}/file_events/batch_id={batch_id}")
            ev.merge_file_state(spark, state_path, written, buckets, applied={"updates": batch_id})
        write_batch(src.to_dlq(rejects, dlq_topic=dlq_topic).select("key", "value", "topic"), out_path + "/dlq", batch_id)
    return run_handler(records, handle, None, checkpoint, trigger)


def current_file_state(spark, out_path: str, base_state: DataFrame | None = None) -> DataFrame:
    """Current files = last event per (repo, path) over every written batch, tombstones removed."""
    events = spark.read.parquet(out_path + "/file_events")
    return ev.apply_file_events(base_state, events)


def start_polling(commit_logs: DataFrame, out_path: str, checkpoint: str, interval: str = "300 seconds",
                  trigger: dict | None = None, policy: str = "newest") -> StreamingQuery:
    """Every ``interval``, new landed commits -> change events -> net status per path of the
    micro-batch, with the order columns of the winning event -> ``out_path/changes``.
    :func:`current_changes` folds the batches: commits may arrive in any order."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        events = chg.poll_changes(batch)
        write_batch(chg.net_changes(events, policy=policy, keep_order=True), out_path + "/changes", batch_id)
    return run_handler(commit_logs, handle, None, checkpoint, trigger or {"processingTime": interval})


def current_changes(spark, out_path: str, policy: str = "newest") -> DataFrame:
    """Net status per path over all batches that L7 has written."""
    return chg.net_changes(spark.read.parquet(out_path + "/changes"), policy=policy)
