"""Stateful streaming jobs: limiter (L3), latest job status (L4), file reassembly (L5),
de-duplication (L6). What L4-L6 remember lives in the state store and ends: jobs some time after
they have, files when they are complete or given up, identities some time after they arrived."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.constants import DEFAULT_RATE_LIMITS, RATE_LIMIT_EXEMPT_PATHS
from ..operators.audit import limit_for_path
from ..operators.events import event_identity
from ..operators.scalable import sliding_count
from .common import run_handler, write_batch


def _limiter_rows(df: DataFrame, limits: dict, client_col: str, ts_col: str, seq_col: str) -> DataFrame:
    return (df.filter(~F.col("path").isin(*RATE_LIMIT_EXEMPT_PATHS))
            .select(F.col(client_col).alias("client"), "path", F.col(seq_col).alias("seq"),
                    F.col(ts_col).cast("timestamp").alias("ts")))


def start_rate_limit_stream(log: DataFrame, out_path: str, checkpoint: str, state_path: str,
                            limits: dict | None = None, window_secs: int = 60, client_col: str = "client",
                            ts_col: str = "ts", seq_col: str = "seq", trigger: dict | None = None,
                            bucket_secs: int | None = None, lateness_secs: int = 600) -> StreamingQuery:
    """L3: the sliding-window limiter over a request stream.

    Every micro-batch is replayed with the distributed (time-bucketed) sliding count of
    :func:`rate_limit_audit`, seeded with the arrivals of the last ``window`` seconds kept
    by the previous batch. That carried state is a table under ``state_path``, versioned
    by batch id and overwritten on retry, so a re-run batch is idempotent and no key's
    history is ever gathered into one task. Rows of a batch are ordered by (ts, seq);
    a later batch's rows arrive after all earlier batches' rows. The state reaches ``lateness_secs``
    further back than the window: rows up to that late are counted exactly, rows beyond it are
    flagged ``late``, as their count may be too small.
    """
    limits = limits or DEFAULT_RATE_LIMITS
    w_us, late_us = window_secs * 1_000_000, lateness_secs * 1_000_000
    cols = ["client", "path", "seq", "ts"]

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        cur = _limiter_rows(batch, limits, client_col, ts_col, seq_col).withColumn("_cur", F.lit(True)) \
            .withColumn("_arr", F.struct(F.lit(batch_id).cast("long").alias("b"), F.col("seq")))
        state_schema = cur.select(*cols, "_arr").schema
        # Only the first batch starts from nothing; a lost state fails the batch.
        prev = (spark.read.schema(state_schema).parquet(f"{state_path}/batch_id={batch_id - 1}") if batch_id
                else spark.createDataFrame([], state_schema))
        seen = prev.agg(F.max(F.unix_micros("ts"))).first()[0]
        late = F.col("_t") <= F.lit(seen - late_us) if seen is not None else F.lit(False)
        both = prev.withColumn("_cur", F.lit(False)).unionByName(cur.select(*cols, "_arr", "_cur")) \
            .withColumn("_t", F.unix_micros("ts")).persist()
        try:
            both_k = both.withColumn("_rl_path", F.replace("path", F.lit("/"), F.lit("_")))
            counted = sliding_count(both_k, ["client", "_rl_path"], "_t", w_us, "request_count", arrival="_arr",
                                    bucket_micros=bucket_secs * 1_000_000 if bucket_secs else None).drop("_rl_path")
            lim = limit_for_path("path", limits)
            out = (counted.filter("_cur").withColumn("rate_limit", lim)
                   .withColumn("rejected", F.col("request_count") > F.col("rate_limit"))
                   .withColumn("remaining", F.when(F.col("rejected"), 0)
                               .otherwise(F.greatest(F.lit(0), F.col("rate_limit") - F.col("request_count"))))
                   .withColumn("reset", F.floor(F.col("_t") / 1_000_000) + window_secs).withColumn("late", late)
                   .drop("_t", "_cur", "_arr"))
            write_batch(out, out_path, batch_id)
            newest = both.agg(F.max("_t")).first()[0]  # one scalar
            keep = both if newest is None else both.filter(F.col("_t") > F.lit(newest - w_us - late_us))
            keep.select(*cols, "_arr").write.mode("overwrite").parquet(f"{state_path}/batch_id={batch_id}")
        finally:
            both.unpersist()

    return run_handler(log, handle, None, checkpoint, trigger)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _settings(spark: SparkSession, **conf: str):
    """Session settings (below ``spark.sql``) for the queries started within."""
    names = {k: "spark.sql." + k.replace("__", ".") for k in conf}
    before = {n: spark.conf.get(n, None) for n in names.values()}
    for k, n in names.items():
        spark.conf.set(n, conf[k])
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def _on_disk(spark: SparkSession, empty_batches: bool = True, groups: int | None = None, many: bool = False):
    """State in RocksDB, not in executor heap; a batch's commit uploads its changes, not the state. A
    query that knows how many ``groups`` it keeps needs no more partitions than these.

    ``many`` small rows: a commit writes the changes to RocksDB's own files, which are smaller the better
    they are compressed, and uploads these. Otherwise it logs them, and they stay in the executor's
    memory, up to RocksDB's 64 MB for each partition."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    conf = {"streaming__stateStore__rocksdb__compression": "zstd", "parquet__compression__codec": "zstd"} if many else {}
    return _settings(spark, streaming__stateStore__providerClass=ROCKSDB,
                     streaming__stateStore__rocksdb__changelogCheckpointing__enabled=str(not many).lower(),
                     streaming__noDataMicroBatches__enabled=str(empty_batches).lower(),
                     shuffle__partitions=str(min(partitions, groups or partitions)), **conf)


def _packed(table: pd.DataFrame) -> bytes:
    """A table as bytes, for a state row."""
    sink = pa.BufferOutputStream()
    t = pa.Table.from_pandas(table, preserve_index=False)
    with pa.ipc.new_stream(sink, t.schema) as out:
        out.write_table(t)
    return sink.getvalue().to_pybytes()


def _unpacked(raw: bytes | None, columns: dict[str, str]) -> pd.DataFrame:
    if raw is None:
        return pd.DataFrame({c: pd.Series(dtype=t) for c, t in columns.items()})
    return pa.ipc.open_stream(raw).read_all().to_pandas()


def _as_text(key: Column) -> Column:
    """A key of any type as text that keeps nulls apart; :func:`_as_key` is the way back."""
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit(""))


def _as_key(text: Column, kind) -> Column:
    return F.when(text != "", F.substr(text, F.lit(2))).cast(kind)


# --------------------------------------------------------------------------- L4

#: A job in one of these has ended.
ENDED = ("completed", "failed", "cancelled")
_JOBS = {"job": "object", "ts": "int64", "seq": "int64", "status": "object", "ended_ms": "int64"}


def _newest(rows: pd.DataFrame) -> pd.DataFrame:
    """Each job's last row by (ts, seq, status)."""
    return rows.sort_values(["ts", "seq", "status"]).drop_duplicates("job", keep="last")


def _status_partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per job and batch of a task, the newest status and the number of events: a job with a third of
    all events sends a row per batch to its state, not one per event."""
    for rows in batches:
        if len(rows):
            n = rows.groupby("job", sort=False).size()
            last = _newest(rows)
            yield last.assign(n=n.reindex(last["job"]).to_numpy())


def start_status_stream(status: DataFrame, out_path: str, checkpoint: str, key: str = "job_id", retention_secs: int = 86_400,
                        buckets: int = 64, trigger: dict | None = None) -> StreamingQuery:
    """L4: the latest status of every job touched by a micro-batch -> ``out_path``.

    What is kept per job is its newest event by (ts, seq, status). ``retention_secs`` (of processing
    time) after the last event of a job that has ended, a timer removes it, so the state is the open
    jobs and the lately ended ones. Jobs are kept in ``buckets`` tables (choose some megabytes each),
    merged column by column. Rows: key, status, status_ts, seq and ``transitions``, the events of the
    micro-batch; nothing is dropped for being late, and :func:`current_status` folds the batches,
    whether a late event met its job's state or not.
    """
    at, name = status.schema["ts"].dataType, next(f for f in status.schema.fields if f.name == key)
    rows = status.select(_as_text(F.col(key)).alias("job"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"),
                         F.col("seq").cast("long").alias("seq"), "status")
    rows = rows.mapInPandas(_status_partials, "job string, ts long, seq long, status string, n long")
    out = T.StructType.fromDDL("job string, status string, ts long, seq long, transitions long")

    def fold(bucket: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        jobs = _unpacked(state.get[0] if state.exists else None, _JOBS)
        if not state.hasTimedOut:
            new = pd.concat(list(parts), ignore_index=True)
            n = new.groupby("job", sort=False)["n"].sum()
            jobs = _newest(pd.concat([jobs, new[["job", "ts", "seq", "status"]].assign(ended_ms=0)], ignore_index=True))
            touched = jobs["job"].isin(n.index)
            jobs.loc[touched, "ended_ms"] = np.where(jobs.loc[touched, "status"].isin(ENDED), now, 0)
            seen = jobs[touched]
            yield pd.DataFrame({"job": seen["job"], "status": seen["status"], "ts": seen["ts"], "seq": seen["seq"],
                                "transitions": n.reindex(seen["job"]).to_numpy()})
        ended = jobs["ended_ms"] > 0
        jobs = jobs[~ended | (jobs["ended_ms"] > now - retention_secs * 1000)]
        ended = jobs.loc[jobs["ended_ms"] > 0, "ended_ms"]
        if not len(jobs):
            state.remove()
            return
        state.update((_packed(jobs), len(jobs)))
        if len(ended):
            state.setTimeoutDuration(max(1, int(ended.min()) + retention_secs * 1000 - now))

    latest = (rows.withColumn("bucket", F.pmod(F.xxhash64("job"), F.lit(buckets))).groupBy("bucket")
              .applyInPandasWithState(fold, out, T.StructType.fromDDL("jobs binary, n long"), "update",
                                      GroupStateTimeout.ProcessingTimeTimeout))
    latest = latest.select(_as_key(F.col("job"), name.dataType).alias(key), "status",
                           F.timestamp_micros("ts").cast(at).alias("status_ts"), "seq", "transitions")
    # Timers of processing time ask for another batch without end, so a run that catches up and stops
    # has batches with data only; timers then fire in the next one.
    stops = bool((trigger or {"availableNow": True}).keys() & {"availableNow", "once"})
    with _on_disk(status.sparkSession, empty_batches=not stops, groups=buckets):
        return run_handler(latest, lambda df, batch_id: write_batch(df, out_path, batch_id), None, checkpoint, trigger,
                           output_mode="update")


def current_status(spark: SparkSession, out_path: str, key: str = "job_id") -> DataFrame:
    """Status, its time and the number of events per job, over all batches that L4 has written."""
    rows = spark.read.parquet(out_path)
    return (rows.groupBy(key).agg(F.max(F.struct("status_ts", "seq", "status")).alias("_l"), F.sum("transitions").alias("transitions"))
            .select(key, "_l.status", "_l.status_ts", "transitions"))


# --------------------------------------------------------------------------- L5

_OPEN = {"file": "object", "chunk_index": "int64", "length": "int64"}
_FILES = {"file": "object", "total": "int64", "copies": "int64", "last_ms": "int64", "done": "bool"}
_FILE_ROWS = ("kind string, file string, chunk_index int, offset long, length long, chunks_received long, total_chunks int, "
              "duplicates long, bytes long, complete boolean")


def _merge_chunks(files: pd.DataFrame, chunks: pd.DataFrame, new: pd.DataFrame):
    """Files and chunks of a bucket after new deliveries: (files, chunks, re-deliveries of done files)."""
    met = new.groupby("file", sort=False).agg(total=("total", "max"), met=("file", "size"), last_ms=("at", "max")).reset_index()
    old = files.rename(columns={"total": "old_total", "last_ms": "old_last"})
    f = old.merge(met, on="file", how="outer")
    f["total"] = f[["old_total", "total"]].max(axis=1).astype("int64")
    f["last_ms"] = f[["old_last", "last_ms"]].max(axis=1).astype("int64")
    f["done"] = f["done"].astype("boolean").fillna(False).astype(bool)
    f["met"], f["copies"] = f["met"].fillna(0).astype("int64"), f["copies"].fillna(0).astype("int64")
    again = f.loc[f["done"] & (f["met"] > 0), ["file", "total", "met"]]
    open_ = set(f.loc[~f["done"], "file"])
    before = chunks.groupby("file").size()
    chunks = pd.concat([chunks, new.loc[new["file"].isin(open_), ["file", "chunk_index", "length"]]], ignore_index=True)
    chunks = chunks.drop_duplicates(["file", "chunk_index"], keep="first")
    fresh = chunks.groupby("file").size().sub(before, fill_value=0).reindex(f["file"]).fillna(0).to_numpy()
    f["copies"] = np.where(f["done"], 0, f["copies"] + f["met"] - fresh).astype("int64")
    return f[[*_FILES]], chunks, again


def _file_rows(files: pd.DataFrame, chunks: pd.DataFrame, complete: bool) -> list[pd.DataFrame]:
    """The rows that are written for complete, or given up, files."""
    mine = chunks[chunks["file"].isin(files["file"])].sort_values(["file", "chunk_index"])
    per = mine.groupby("file").agg(chunks_received=("chunk_index", "size"), bytes=("length", "sum"))
    out = [pd.DataFrame({"kind": "file", "file": files["file"], "total_chunks": files["total"], "duplicates": files["copies"],
                         "complete": complete}).join(per, on="file")]
    if complete:
        start = mine.groupby("file")["length"].cumsum() - mine["length"]
        out.append(pd.DataFrame({"kind": "chunk", "file": mine["file"], "chunk_index": mine["chunk_index"], "offset": start,
                                 "length": mine["length"]}))
    return out


def start_reassembly_stream(chunks: DataFrame, out_path: str, checkpoint: str, arrived: str, key: str = "file_id",
                            give_up_secs: int = 3600, slack_secs: int = 60, buckets: int = 64,
                            trigger: dict | None = None) -> StreamingQuery:
    """File chunks in any order -> ``out_path``, a file's rows when it is complete.

    ``chunks``: key, chunk_index, total_chunks, chunk_data and ``arrived``, when the chunk came in (a
    time that doesn't fall from batch to batch by more than ``slack_secs``; ``current_timestamp()``
    will do). Kept per open file are the indexes and lengths that are there, not the data. When index
    0 to total - 1 are there, the file row and a row per chunk with its byte offset are written, for
    a writer to place the landed chunks by. A file that got no chunk for ``give_up_secs`` is written
    as incomplete, with what is there. Both leave a mark that counts re-deliveries as duplicates until
    its own time, as long again, is over. Files are kept in ``buckets`` tables, merged column by column.

    Copies of an index are duplicates; the first one's length counts. A null key is a heartbeat: it
    moves the clock and is no file. :func:`reassembled` folds the batches.
    """
    kind = chunks.schema[key].dataType
    length = F.coalesce(F.octet_length(F.col("chunk_data").cast("binary")), F.lit(0)).cast("long")
    # The condition names the time, so that it isn't moved below the watermark: heartbeats count there.
    a_chunk = F.when(F.col(arrived).isNotNull(), F.col(key).isNotNull()).otherwise(F.lit(False))
    rows = (chunks.withWatermark(arrived, f"{slack_secs} seconds").filter(a_chunk)
            .select(_as_text(F.col(key)).alias("file"), F.coalesce("chunk_index", F.lit(-1)).cast("long").alias("chunk_index"),
                    F.coalesce("total_chunks", F.lit(0)).cast("long").alias("total"), length.alias("length"),
                    F.unix_millis(F.col(arrived)).alias("at"), F.col(arrived).alias("_arrived")))
    schema = T.StructType.fromDDL(_FILE_ROWS)
    wait = give_up_secs * 1000

    def fold(bucket: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        clock = state.getCurrentWatermarkMs()
        held = state.get if state.exists else (None, None)
        files, open_ = _unpacked(held[0], _FILES), _unpacked(held[1], _OPEN)
        out = []
        if not state.hasTimedOut:
            new = pd.concat([p.drop(columns=["_arrived", "bucket"]) for p in parts], ignore_index=True)
            files, open_, again = _merge_chunks(files, open_, new)
            out.append(pd.DataFrame({"kind": "duplicate", "file": again["file"], "total_chunks": again["total"], "duplicates": again["met"]}))
            span = open_.groupby("file")["chunk_index"].agg(["size", "min", "max"]).reindex(files["file"])
            whole = ((span["size"] == files["total"].to_numpy()) & (span["min"] == 0)
                     & (span["max"] == files["total"].to_numpy() - 1)).to_numpy() & ~files["done"].to_numpy()
            out += _file_rows(files[whole], open_, True)
            open_ = open_[~open_["file"].isin(files.loc[whole, "file"])]
            files = files.assign(done=files["done"].to_numpy() | whole, copies=np.where(whole, 0, files["copies"]))
        over = (files["last_ms"] + wait <= clock).to_numpy()
        lost = over & ~files["done"].to_numpy()
        out += _file_rows(files[lost], open_, False)
        open_ = open_[~open_["file"].isin(files.loc[lost, "file"])]
        files = files.assign(done=files["done"].to_numpy() | lost, copies=np.where(lost, 0, files["copies"]),
                             last_ms=np.where(lost, clock, files["last_ms"]))[~(over & ~lost)]
        yield from (o.reindex(columns=schema.fieldNames()) for o in out if len(o))
        if not len(files):
            state.remove()
            return
        state.update((_packed(files), _packed(open_)))
        state.setTimeoutTimestamp(max(clock + 1, int(files["last_ms"].min()) + wait))

    done = (rows.withColumn("bucket", F.pmod(F.xxhash64("file"), F.lit(buckets))).groupBy("bucket")
            .applyInPandasWithState(fold, schema, T.StructType.fromDDL("files binary, open binary"), "append",
                                    GroupStateTimeout.EventTimeTimeout))
    done = done.select("kind", _as_key(F.col("file"), kind).alias("file_id"), *schema.fieldNames()[2:])
    with _on_disk(chunks.sparkSession, groups=buckets):
        return run_handler(done, lambda df, batch_id: write_batch(df, out_path, batch_id), None, checkpoint, trigger)


def reassembled(spark: SparkSession, out_path: str) -> tuple[DataFrame, DataFrame]:
    """(files, placements) over all batches that L5 has written, as :func:`reassemble_files` gives them."""
    rows = spark.read.parquet(out_path)
    files = rows.filter(F.col("kind") != "chunk").groupBy("file_id").agg(
        F.max("chunks_received").alias("chunks_received"), F.max("total_chunks").alias("total_chunks"),
        F.sum("duplicates").alias("duplicates"), F.max("bytes").alias("bytes"), F.bool_or("complete").alias("complete"))
    return files, rows.filter(F.col("kind") == "chunk").select("file_id", "chunk_index", "offset", "length")


# --------------------------------------------------------------------------- L6

def start_dedupe_stream(events: DataFrame, out_path: str, checkpoint: str, retention_secs: int = 86_400,
                        id_col: str | None = "event_id", trigger: dict | None = None) -> StreamingQuery:
    """At-least-once redeliveries dropped; no event is dropped for being late.

    The state store keeps an identity from its first arrival for at least ``retention_secs`` (of
    arrival, not event time), and forgets it once the newest arrival is twice as far on; a redelivery
    later than that passes. Arrival is the micro-batch's own time, which the checkpoint records, so a
    retried batch decides the same. A batch costs its own rows' look-ups, whatever came before.

    Identities are shuffled and kept as 16 bytes of their SHA-256: an event's state is small, however
    long its id, and two events of 10^9 share one with a chance below 10^-20.
    """
    named = event_identity(events, id_col).withColumn("_arrived", F.current_timestamp())
    named = named.withColumn("_identity", F.unhex(F.substring(F.sha2("_identity", 256), 1, 32)))
    fresh = (named.withWatermark("_arrived", f"{retention_secs} seconds").dropDuplicatesWithinWatermark(["_identity"])
             .drop("_identity", "_arrived"))
    with _on_disk(events.sparkSession, empty_batches=False, many=True):  # old identities go with the next batch
        return run_handler(fresh, lambda df, batch_id: write_batch(df, out_path, batch_id), None, checkpoint, trigger)
