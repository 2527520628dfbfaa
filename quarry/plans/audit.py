"""Registered jobs: audits and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit as ops
from ..sources.fixtures import Fixtures
from .catalog import register

LIMITS = {"default": 5, "/search": 4, "/sources": 6, "/sync": 3}
WINDOW = 6 * 3600


@register("g1_rate_limit_audit", views=["fx_access_log"], oracle=f"""
WITH x AS (SELECT *, epoch_us(ts) AS t FROM fx_access_log WHERE path NOT IN ('/health', '/metrics', '/status')),
c AS (SELECT *, count(*) OVER (PARTITION BY client, replace(path, '/', '_') ORDER BY t RANGE BETWEEN {WINDOW * 1000000 - 1} PRECEDING AND CURRENT ROW)
                - (count(*) OVER (PARTITION BY client, replace(path, '/', '_'), t)
                   - row_number() OVER (PARTITION BY client, replace(path, '/', '_'), t ORDER BY seq)) AS request_count,
             CASE WHEN contains(path, '/search') THEN 4 WHEN contains(path, '/sources') THEN 6
                  WHEN contains(path, '/sync') THEN 3 ELSE 5 END AS rate_limit FROM x)
SELECT seq, client, path, request_count, rate_limit, request_count > rate_limit AS rejected,
       CASE WHEN request_count > rate_limit THEN 0 ELSE greatest(0, rate_limit - request_count) END AS remaining,
       CAST(floor(t / 1000000) AS BIGINT) + {WINDOW} AS reset FROM c""")
def g1_rate_limit_audit(spark, sf_dir):
    """G1: sliding-window rate-limit replay over the access log."""
    log = Fixtures(spark, sf_dir).fx_access_log
    out = ops.rate_limit_audit(log, LIMITS, WINDOW, bucket_secs=86400)
    return out.select("seq", "client", "path", "request_count", "rate_limit", "rejected", "remaining", "reset")


@register("g3_circuit_breaker", views=["fx_send_log"], oracle="""
WITH x AS (SELECT *, sum(CASE WHEN outcome = 'ok' THEN 1 ELSE 0 END) OVER (PARTITION BY sync_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS oks
           FROM fx_send_log),
f AS (SELECT *, row_number() OVER (PARTITION BY sync_id, oks ORDER BY seq) AS run FROM x WHERE outcome = 'fail'),
t AS (SELECT sync_id, min(seq) AS trip_seq FROM f WHERE run >= 3 GROUP BY sync_id),
a AS (SELECT x.sync_id,
        count(*) FILTER (WHERE (t.trip_seq IS NULL OR x.seq <= t.trip_seq) AND outcome = 'ok') AS sent,
        count(*) FILTER (WHERE (t.trip_seq IS NULL OR x.seq <= t.trip_seq) AND outcome = 'fail') AS failed,
        count(*) FILTER (WHERE (t.trip_seq IS NULL OR x.seq <= t.trip_seq) AND outcome = 'skip') AS skipped,
        count(*) AS total, max(t.trip_seq) AS trip_seq
      FROM x LEFT JOIN t ON t.sync_id = x.sync_id GROUP BY x.sync_id)
SELECT *, trip_seq IS NOT NULL AS tripped, CASE WHEN trip_seq IS NOT NULL THEN total - sent - failed ELSE 0 END AS remaining FROM a""")
def g3_circuit_breaker(spark, sf_dir):
    """Circuit-breaker replay per sync."""
    return ops.circuit_breaker_replay(Fixtures(spark, sf_dir).fx_send_log, threshold=3, block=64)


@register("g4_retry_ledger", views=["fx_attempts"], oracle="""
WITH x AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY ts, seq) AS attempt, error_kind IS NOT NULL AS tr FROM fx_attempts),
y AS (SELECT *, tr OR status IN (502, 503, 504) AS retryable FROM x),
z AS (SELECT *, (NOT tr AND status < 400) OR NOT retryable OR attempt >= 8 AS terminal FROM y),
s AS (SELECT request_id, min(attempt) AS stop FROM z WHERE terminal GROUP BY request_id),
k AS (SELECT z.* FROM z LEFT JOIN s ON s.request_id = z.request_id WHERE s.stop IS NULL OR z.attempt <= s.stop),
g AS (SELECT request_id, count(*) AS attempts,
             CAST(sum(CASE WHEN retryable AND NOT terminal THEN least(pow(2, attempt - 1), CASE WHEN tr THEN 8 ELSE 10 END) ELSE 0 END) AS DOUBLE) AS total_backoff_s,
             arg_max(status, attempt) AS final_status, arg_max(tr, attempt) AS ltr, arg_max(terminal, attempt) AS lterm
      FROM k GROUP BY request_id)
SELECT request_id, attempts, total_backoff_s, final_status,
       CASE WHEN NOT lterm THEN 'incomplete' WHEN NOT ltr AND final_status < 400 THEN 'success' WHEN ltr THEN 'unreachable'
            WHEN final_status IN (502, 503, 504) THEN 'exhausted' ELSE 'client_error' END AS outcome,
       (SELECT count(*) FROM x WHERE x.request_id = g.request_id AND x.attempt > 8) AS attempts_beyond_budget FROM g""")
def g4_retry_ledger(spark, sf_dir):
    """Retry attempts, backoff and outcome per request."""
    return ops.retry_ledger(Fixtures(spark, sf_dir).fx_attempts)


@register("g5_status_timeline", views=["fx_job_status_events"], oracle="""
SELECT job_id, seq, ts, status,
       lag(status) OVER w AS prev_status, lead(ts) OVER w AS next_ts,
       (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6 AS seconds_in_state
FROM fx_job_status_events WINDOW w AS (PARTITION BY job_id ORDER BY ts, seq, status)""")
def g5_status_timeline(spark, sf_dir):
    """Ordered status transitions per job."""
    steps = ops.status_timeline(Fixtures(spark, sf_dir).fx_job_status_events)
    return steps.select("job_id", "seq", "ts", "status", "prev_status", "next_ts", "seconds_in_state")


@register("g5_job_summary", views=["fx_job_status_events"], oracle="""
SELECT job_id, arg_max(status, (ts, seq, status)) AS status,
       max(ts) FILTER (WHERE status IN ('running', 'processing')) AS started_at,
       max(ts) FILTER (WHERE status IN ('completed', 'failed', 'cancelled')) AS completed_at,
       count(*) AS transitions FROM fx_job_status_events GROUP BY job_id""")
def g5_job_summary(spark, sf_dir):
    """Last status, start and completion time per job."""
    return ops.status_summary(Fixtures(spark, sf_dir).fx_job_status_events)


DELTAS_SQL = """
d AS (SELECT 'user_' || CAST(o_custkey % 8 AS VARCHAR) AS user_id, o_orderkey AS seq,
             CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END AS delta FROM orders)"""


def _deltas(fx: Fixtures):
    o = fx.orders
    return o.select(F.concat(F.lit("user_"), (F.col("o_custkey") % 8).cast("string")).alias("user_id"),
                    F.col("o_orderkey").alias("seq"),
                    F.when(F.col("o_orderstatus") == "F", -1).otherwise(1).alias("delta"))


@register("f7_repo_count_ledger", oracle=f"""
WITH {DELTAS_SQL.strip()}
SELECT user_id, CAST(sum(delta) AS BIGINT) AS balance, count(*) AS changes FROM d GROUP BY user_id""")
def f7_repo_count_ledger(spark, sf_dir):
    """repository count balance per user."""
    return ops.repo_count_ledger(_deltas(Fixtures(spark, sf_dir)))


@register("g6_repo_count_running", oracle=f"""
WITH {DELTAS_SQL.strip()}
SELECT user_id, seq, delta, CAST(sum(delta) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_balance FROM d""")
def g6_repo_count_running(spark, sf_dir):
    """Running repository balance per user."""
    return ops.repo_count_running(_deltas(Fixtures(spark, sf_dir)))


@register("f3_ingest_stats", views=["fx_file_results"], oracle="""
SELECT repo_id, commit_id, count(*) FILTER (WHERE ok) AS files_processed,
       CAST(sum(CASE WHEN ok THEN chunks ELSE 0 END) AS BIGINT) AS chunks_created,
       CAST(sum(duration_ms) AS BIGINT) AS processing_duration_ms,
       CAST(sum(CASE WHEN ok THEN size_bytes ELSE 0 END) AS BIGINT) AS repository_size_bytes
FROM fx_file_results GROUP BY repo_id, commit_id""")
def f3_ingest_stats(spark, sf_dir):
    """ingest statistics per repository and commit."""
    per, _ = ops.ingest_stats(Fixtures(spark, sf_dir).fx_file_results)
    return per


@register("f3_ingest_totals", views=["fx_file_results"], oracle="""
SELECT count(*) FILTER (WHERE ok) AS total_processed, count(*) FILTER (WHERE NOT ok) AS total_failed,
       CAST(sum(duration_ms) AS BIGINT) AS total_time_ms FROM fx_file_results""")
def f3_ingest_totals(spark, sf_dir):
    """batch totals of an ingest."""
    _, totals = ops.ingest_stats(Fixtures(spark, sf_dir).fx_file_results)
    return totals


@register("f4_job_metrics", views=["fx_jobs"], oracle="""
SELECT status, source_type, count(*) AS jobs, CAST(grouping(status, source_type) AS INTEGER) AS level
FROM fx_jobs GROUP BY ROLLUP (status, source_type)""")
def f4_job_metrics(spark, sf_dir):
    """jobs by status and source type with subtotals (ROLLUP)."""
    return ops.job_metrics(Fixtures(spark, sf_dir).fx_jobs)


@register("f4_duration_histogram", views=["fx_jobs"], oracle="""
SELECT source_type, count(*) FILTER (WHERE duration_s <= 50000.0) AS le_50000_0,
       count(*) FILTER (WHERE duration_s <= 150000.0) AS le_150000_0, count(*) FILTER (WHERE duration_s <= 300000.0) AS le_300000_0,
       count(*) AS count, round(sum(duration_s), 2) AS sum FROM fx_jobs GROUP BY source_type""")
def f4_duration_histogram(spark, sf_dir):
    """job duration histogram per source type."""
    return ops.duration_histogram(Fixtures(spark, sf_dir).fx_jobs, "source_type", "duration_s", [50000.0, 150000.0, 300000.0])


RANKS = [0.1, 0.5, 0.9, 0.99]


@register("f4_duration_quantiles", views=["fx_jobs"], oracle=f"""
SELECT source_type, unnest({RANKS}) AS rank, count(*) AS n, TRUE AS direct_within, TRUE AS merged_within FROM fx_jobs GROUP BY source_type""")
def f4_duration_quantiles(spark, sf_dir):
    """duration quantiles per source type from sketches stored per day and source type, and from
    sketches made at once; true if the exact rank of what each gives is within the stated error."""
    from ..session import checkpoint_path
    jobs = Fixtures(spark, sf_dir).fx_jobs
    base = checkpoint_path(spark, "f4", unique=True)
    daily = ops.value_sketches(jobs.withColumn("day", F.to_date("created_at")), ["day", "source_type"], "duration_s")
    daily.write.parquet(base)
    merged = ops.merge_sketches(spark.read.parquet(base), ["source_type"])
    both = (ops.sketch_quantiles(merged, RANKS).withColumnRenamed("quantile", "merged")
            .join(ops.sketch_quantiles(ops.value_sketches(jobs, ["source_type"], "duration_s"), RANKS)
                  .withColumnRenamed("quantile", "direct"), ["source_type", "rank", "n"]))
    # Exact ranks: a row per job and asked rank, counted.
    met = jobs.select("source_type", F.col("duration_s").cast("double").alias("v")).join(both, "source_type")
    ranked = met.groupBy("source_type", "rank", "n").agg(*[
        F.struct((F.count_if(F.col("v") < F.col(c)) / F.count(F.lit(1))).alias("lo"),
                 (F.count_if(F.col("v") <= F.col(c)) / F.count(F.lit(1))).alias("hi")).alias(c) for c in ("direct", "merged")])
    near = lambda c: ((F.col(f"{c}.lo") <= F.col("rank") + ops.SKETCH_RANK_ERROR)
                      & (F.col(f"{c}.hi") >= F.col("rank") - ops.SKETCH_RANK_ERROR))
    return ranked.select("source_type", "rank", "n", near("direct").alias("direct_within"), near("merged").alias("merged_within"))


@register("f5_request_metrics", views=["fx_access_log"], oracle="""
SELECT method, path, status, count(*) AS requests, CAST(grouping(method, path, status) AS INTEGER) AS level
FROM fx_access_log GROUP BY CUBE (method, path, status)""")
def f5_request_metrics(spark, sf_dir):
    """requests by method, path and status with subtotals (CUBE)."""
    return ops.request_metrics(Fixtures(spark, sf_dir).fx_access_log)


@register("f5_latency_histogram", views=["fx_access_log"], oracle="""
SELECT path, count(*) FILTER (WHERE latency_ms <= 10.0) AS le_10_0, count(*) FILTER (WHERE latency_ms <= 50.0) AS le_50_0,
       count(*) FILTER (WHERE latency_ms <= 100.0) AS le_100_0, count(*) AS count, round(sum(latency_ms), 2) AS sum
FROM fx_access_log GROUP BY path""")
def f5_latency_histogram(spark, sf_dir):
    """request latency histogram per path."""
    return ops.duration_histogram(Fixtures(spark, sf_dir).fx_access_log, "path", "latency_ms", [10.0, 50.0, 100.0])


@register("f6_failure_breakdown", views=["fx_file_results"], oracle="""
SELECT error_code, fatal, count(*) AS failures, CAST(sum(retry_count) AS BIGINT) AS retries, max(retry_count) AS max_retries,
       count(DISTINCT repo_id) AS repos FROM fx_file_results WHERE NOT ok GROUP BY error_code, fatal""")
def f6_failure_breakdown(spark, sf_dir):
    """failures by error code and fatality with retry statistics."""
    r = Fixtures(spark, sf_dir).fx_file_results
    return ops.failure_breakdown(r.filter(~F.col("ok")))


def _embeddings(fx: Fixtures):
    e = fx.embeddings
    return e.select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("m"), (F.col("label") % 3).cast("string")).alias("model"),
                    "embedding")


@register("f8_embedding_coverage", views=["fx_chunks"], oracle="""
WITH e AS (SELECT DISTINCT vec_id AS chunk_id FROM embeddings)
SELECT c.file_id, count(DISTINCT c.chunk_id) AS chunks,
       count(DISTINCT c.chunk_id) FILTER (WHERE e.chunk_id IS NOT NULL) AS embedded,
       count(*) FILTER (WHERE e.chunk_id IS NULL) AS missing
FROM fx_chunks c LEFT JOIN e ON e.chunk_id = c.chunk_id GROUP BY c.file_id""")
def f8_embedding_coverage(spark, sf_dir):
    """F8: chunks, embedded chunks and missing embeddings per file."""
    fx = Fixtures(spark, sf_dir)
    per_file, _ = ops.embedding_coverage(fx.fx_chunks.select("chunk_id", "file_id"), _embeddings(fx),
                                         {"m0": 64, "m1": 64, "m2": 128})
    return per_file


def embedding_events(chunks: DataFrame, ids: int = 1000) -> DataFrame:
    """Embedding events of files in bounded pieces: a file and language has one for each range of
    ``ids`` chunk ids, so no event names more than that many chunks."""
    total = chunks.groupBy("file_id").agg(F.count_distinct("chunk_id").cast("int").alias("total_chunks"))
    named = F.collect_set(F.when(F.col("embedded") | (F.col("chunk_type") != "en"), F.col("chunk_id").cast("string")))
    pieces = chunks.groupBy("file_id", "chunk_type", F.expr(f"chunk_id div {ids}").alias("piece"))
    return pieces.agg(named.alias("chunk_ids")).drop("piece").join(total, "file_id")


@register("f8_embedding_completeness", views=["fx_chunks"], oracle="""
WITH t AS (SELECT file_id, count(DISTINCT chunk_id) AS total FROM fx_chunks GROUP BY file_id),
n AS (SELECT file_id, count(DISTINCT chunk_id) AS named FROM fx_chunks WHERE embedded OR chunk_type <> 'en' GROUP BY file_id)
SELECT t.file_id, CAST(t.total AS INTEGER) AS total_chunks, coalesce(n.named, 0) AS named,
       coalesce(n.named, 0) = t.total AS complete FROM t LEFT JOIN n ON n.file_id = t.file_id""")
def f8_embedding_completeness(spark, sf_dir):
    """F8: chunks named by embedding events against the files' declared totals; events of one file
    come per language and range of ids, and name chunks of other languages or with a vector."""
    return ops.embedding_completeness(embedding_events(Fixtures(spark, sf_dir).fx_chunks))


@register("f8_embedding_dimensions", oracle="""
SELECT 'm' || CAST(label % 3 AS VARCHAR) AS model, count(*) AS vectors,
       count(*) FILTER (WHERE len(embedding) <> CASE label % 3 WHEN 2 THEN 128 ELSE 64 END) AS dimension_mismatches
FROM embeddings GROUP BY 1""")
def f8_embedding_dimensions(spark, sf_dir):
    """F8: vectors and dimension mismatches per embedding model."""
    fx = Fixtures(spark, sf_dir)
    _, per_model = ops.embedding_coverage(fx.fx_chunks.select("chunk_id", "file_id"), _embeddings(fx),
                                          {"m0": 64, "m1": 64, "m2": 128})
    return per_model


@register("f9_chunk_stats", views=["fx_chunks"], oracle="""
SELECT c.file_id, c.chunk_type, count(*) AS chunks, avg(l.quality) AS avg_quality, max(CAST(floor(c.size / 80) AS BIGINT)) AS max_end_line,
       CAST(sum(c.size) AS BIGINT) AS total_size, max(c.size) AS max_size
FROM fx_chunks c LEFT JOIN labels l ON l.doc_id = c.chunk_id GROUP BY c.file_id, c.chunk_type""")
def f9_chunk_stats(spark, sf_dir):
    """chunk count, quality and sizes per file and chunk type."""
    fx = Fixtures(spark, sf_dir)
    ch = (fx.fx_chunks.join(fx.labels.select(F.col("doc_id").alias("chunk_id"), "quality"), "chunk_id", "left")
          .select("file_id", "chunk_type", "size", F.col("quality").alias("quality_score"),
                  F.floor(F.col("size") / 80).cast("bigint").alias("end_line")))
    return ops.chunk_stats(ch)


@register("f10_job_progress", views=["fx_jobs"], oracle="""
SELECT id, processed_files, total_files,
       round(coalesce(CASE WHEN total_files = 0 THEN NULL ELSE processed_files * 100.0 / total_files END, 0.0), 4) AS progress
FROM fx_jobs""")
def f10_job_progress(spark, sf_dir):
    """processed percentage per job."""
    return ops.job_progress(Fixtures(spark, sf_dir).fx_jobs).select("id", "processed_files", "total_files", "progress")


CHUNKS_SQL = """
ck AS (SELECT * FROM fx_file_chunks WHERE NOT (file_id % 10 = 0 AND chunk_index = total_chunks - 1)
       UNION ALL SELECT * FROM fx_file_chunks WHERE file_id % 7 = 0 AND chunk_index = 0),
dd AS (SELECT file_id, chunk_index, count(*) AS copies, min(chunk_data) AS chunk_data, max(total_chunks) AS total_chunks
       FROM ck GROUP BY file_id, chunk_index)"""


def _chunks(fx: Fixtures):
    """Chunk deliveries: the last chunk of every tenth file lost, the first chunk of every
    seventh file delivered twice."""
    c = fx.fx_file_chunks
    kept = c.filter(~((F.col("file_id") % 10 == 0) & (F.col("chunk_index") == F.col("total_chunks") - 1)))
    return kept.unionByName(c.filter((F.col("file_id") % 7 == 0) & (F.col("chunk_index") == 0)))


@register("l5_reassemble_files", views=["fx_file_chunks"], oracle=f"""
WITH {CHUNKS_SQL.strip()}
SELECT file_id, count(*) AS chunks_received, max(total_chunks) AS total_chunks, sum(copies - 1) AS duplicates,
       CAST(sum(octet_length(encode(chunk_data))) AS BIGINT) AS bytes,
       count(*) = max(total_chunks) AND min(chunk_index) = 0 AND max(chunk_index) = max(total_chunks) - 1 AS complete
FROM dd GROUP BY file_id""")
def l5_reassemble_files(spark, sf_dir):
    """Completeness, duplicates and size per reassembled file."""
    files, _ = ops.reassemble_files(_chunks(Fixtures(spark, sf_dir)), block=8)
    return files


@register("l5_chunk_placement", views=["fx_file_chunks"], oracle=f"""
WITH {CHUNKS_SQL.strip()}
SELECT file_id, chunk_index, CAST(coalesce(sum(octet_length(encode(chunk_data))) OVER (PARTITION BY file_id ORDER BY chunk_index
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", octet_length(encode(chunk_data)) AS length
FROM dd""")
def l5_chunk_placement(spark, sf_dir):
    """Byte offset of every chunk in its file."""
    _, placed = ops.reassemble_files(_chunks(Fixtures(spark, sf_dir)), block=8)
    return placed.select("file_id", "chunk_index", "offset", "length")


@register("g1_client_identity", views=["fx_access_log"], oracle="""
SELECT seq, CASE WHEN coalesce(auth_user, '') <> '' THEN 'user:' || auth_user
                 WHEN coalesce(forwarded_for, '') <> '' THEN regexp_replace(split_part(forwarded_for, ',', 1), '^\\s+|\\s+$', '', 'g')
                 WHEN coalesce(real_ip, '') <> '' THEN real_ip
                 WHEN host IS NOT NULL THEN host ELSE 'unknown' END AS client_id
FROM fx_access_log""")
def g1_client_identity(spark, sf_dir):
    """Client id of every logged request, as the limiter derives it from auth and headers."""
    log = Fixtures(spark, sf_dir).fx_access_log
    return log.select("seq", ops.client_identity().alias("client_id"))
