"""Registered jobs: event records, typed decode, dead letters, file events and state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import changes as chg
from ..operators import events as ops
from ..sources import events as src
from ..sources.fixtures import Fixtures
from .catalog import register
from .changes import DIFF_SQL
from .sqlbits import is_binary

FE_COLS = ["event_type", "repo_id", "file_path", "content", "is_deleted"]


def _file_events(fx: Fixtures):
    return fx.fx_file_events.select(F.lit("STREAMED_FILE").alias("event_type"), "*")


@register("a4_write_events", views=["fx_file_events"], oracle="""
SELECT repo_id AS key, 'repo.events' AS topic, 'STREAMED_FILE' AS event_type, repo_id, file_path, content, is_deleted
FROM fx_file_events""")
def a4_write_events(spark, sf_dir):
    """A4: file events serialised as keyed JSON records and read back."""
    rec = src.to_event_records(_file_events(Fixtures(spark, sf_dir)), value_cols=FE_COLS)
    back = F.from_json("value", "event_type STRING, repo_id STRING, file_path STRING, content STRING, is_deleted BOOLEAN")
    return rec.select("key", "topic", back.alias("e")).select("key", "topic", "e.*")


def _raw(fx: Fixtures):
    """Kafka-layout records of the file events with some damaged deliveries."""
    fe = _file_events(fx)
    o = F.col("off")
    # Some events leave out is_deleted (no deletion) or content (rejected), some have empty content.
    there = [F.when(o % 73 != 0, F.col("is_deleted")).alias("is_deleted"), F.when(o % 71 != 0, F.col("content")).alias("content"),
             F.lit("org/name").alias("repo_name"), F.lit("").alias("url")]
    good = F.to_json(F.struct("event_type", "repo_id", "file_path", *there))
    bad_path = F.to_json(F.struct("event_type", "repo_id", F.lit("").alias("file_path"), "content", "is_deleted"))
    unknown = F.to_json(F.struct(F.lit("FILE_SEEN").alias("event_type"), "repo_id", "file_path"))
    value = (F.when(o % 97 == 0, F.substring(good, 1, 10)).when(o % 89 == 0, bad_path)
              .when(o % 83 == 0, unknown).when(o % 79 == 0, F.lit("")).otherwise(good))
    return fe.select(F.col("repo_id").alias("key"), F.encode(value, "UTF-8").alias("value"),
                     F.lit("repo.events").alias("topic"), F.lit(0).alias("partition"),
                     o.alias("offset"), F.col("commit_ts").cast("timestamp").alias("timestamp"))


@register("a5_decode_events", views=["fx_file_events"], oracle="""
SELECT "off" AS "offset", repo_id, file_path, is_deleted AND "off" % 73 <> 0 AS is_deleted, content FROM fx_file_events
WHERE NOT ("off" % 97 = 0 OR "off" % 89 = 0 OR "off" % 83 = 0 OR "off" % 79 = 0 OR "off" % 71 = 0)""")
def a5_decode_events(spark, sf_dir):
    """A5: typed STREAMED_FILE events decoded from raw records (damaged ones rejected)."""
    typed, _ = src.decode_events(_raw(Fixtures(spark, sf_dir)), types=["STREAMED_FILE"])
    return typed["STREAMED_FILE"].select("offset", "repo_id", "file_path", "is_deleted", "content")


REJECT_SQL = """
SELECT repo_id AS key, "off" AS "offset",
       CASE WHEN "off" % 97 = 0 THEN 'invalid_json' WHEN "off" % 89 = 0 THEN 'missing_required:file_path'
            WHEN "off" % 83 = 0 THEN 'unknown_event_type' ELSE 'missing_required:content' END AS error
FROM fx_file_events WHERE "off" % 97 = 0 OR "off" % 89 = 0 OR "off" % 83 = 0 OR ("off" % 79 <> 0 AND "off" % 71 = 0)"""


@register("a5_decode_rejects", views=["fx_file_events"], oracle=REJECT_SQL)
def a5_decode_rejects(spark, sf_dir):
    """A5: rejected raw records with their reason."""
    _, rejects = src.decode_events(_raw(Fixtures(spark, sf_dir)), types=["STREAMED_FILE"])
    return rejects.select("key", "offset", "error")


@register("a6_to_dlq", views=["fx_file_events"], oracle=f"""
SELECT key, 'repo.events.dlq' AS topic, 'repo.events' AS failed_topic, 1700000000000 AS failed_at, error
FROM ({REJECT_SQL})""")
def a6_to_dlq(spark, sf_dir):
    """Dead-letter envelopes for rejected records."""
    _, rejects = src.decode_events(_raw(Fixtures(spark, sf_dir)), types=["STREAMED_FILE"])
    d = src.to_dlq(rejects, now_ms=1700000000000)
    return d.select("key", "topic", F.col("envelope.failedTopic").alias("failed_topic"),
                    F.col("envelope.failedAt").alias("failed_at"), F.col("envelope.error").alias("error"))


def _repos_for(df):
    n = F.regexp_extract("repo_id", r"(\d+)$", 1).cast("int")
    return df.select("repo_id").distinct().select(
        "repo_id",
        F.when(n % 2 == 0, F.concat(F.lit("https://github.com/org/"), F.col("repo_id"), F.lit(".git")))
         .otherwise(F.concat(F.lit("https://gitlab.com/org/"), F.col("repo_id"))).alias("url"),
        F.when(n % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("user_"), (n % 8).cast("string"))).alias("user_id"))


@register("e6_to_file_events", views=["fx_snap_old", "fx_snap_new"], oracle=f"""
WITH {DIFF_SQL.strip()},
blobs AS (SELECT n.repo_id, n.path, CASE WHEN n.doc_id % 19 = 0 THEN NULL ELSE d.text END AS content
          FROM fx_snap_new n JOIN documents d ON d.doc_id = n.doc_id),
ch AS (SELECT * FROM d WHERE NOT {is_binary('path')}),
ups AS (SELECT ch.repo_id, ch.path, b.content, FALSE AS is_deleted FROM ch JOIN blobs b ON b.repo_id = ch.repo_id AND b.path = ch.path
        WHERE ch.change IN ('added', 'modified', 'renamed') AND b.content IS NOT NULL),
dels AS (SELECT repo_id, path FROM ch WHERE change = 'removed'
         UNION ALL SELECT repo_id, old_path FROM ch WHERE change = 'renamed' AND old_path IS NOT NULL),
ev AS (SELECT * FROM ups UNION ALL SELECT repo_id, path, '', TRUE FROM dels WHERE NOT {is_binary('path')}),
r AS (SELECT DISTINCT repo_id, CAST(regexp_extract(repo_id, '(\\d+)$', 1) AS INT) AS n FROM fx_snap_new),
r2 AS (SELECT repo_id, CASE WHEN n % 2 = 0 THEN 'https://github.com/org/' || repo_id || '.git' ELSE 'https://gitlab.com/org/' || repo_id END AS url,
              CASE WHEN n % 3 = 0 THEN NULL ELSE 'user_' || CAST(n % 8 AS VARCHAR) END AS user_id FROM r)
SELECT 'STREAMED_FILE' AS event_type, ev.repo_id,
       CASE WHEN contains(r2.url, 'github.com/') THEN regexp_replace(regexp_extract(r2.url, 'github\\.com/(.*)$', 1), '\\.git$', '') ELSE 'unknown/repo' END AS repo_name,
       ev.path AS file_path, ev.content, r2.url, coalesce(r2.user_id, 'system') AS user_id, ev.is_deleted
FROM ev LEFT JOIN r2 ON r2.repo_id = ev.repo_id""")
def e6_to_file_events(spark, sf_dir):
    """STREAMED_FILE events and tombstones from a snapshot diff."""
    fx = Fixtures(spark, sf_dir)
    changes = chg.diff_snapshots(fx.fx_snap_old, fx.fx_snap_new)
    blobs = (fx.fx_snap_new.select("doc_id", "repo_id", "path")
             .join(fx.documents.select("doc_id", "text"), "doc_id")
             .select("repo_id", "path", F.when(F.col("doc_id") % 19 == 0, F.lit(None))
                     .otherwise(F.encode("text", "UTF-8")).alias("content")))
    return ops.to_file_events(changes, blobs, _repos_for(fx.fx_snap_new))


@register("e7_apply_file_events", views=["fx_file_events"], oracle="""
SELECT repo_id, file_path, content, "off" FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_id, file_path ORDER BY "off" DESC, is_deleted) AS rn
  FROM fx_file_events) WHERE rn = 1 AND NOT is_deleted""")
def e7_apply_file_events(spark, sf_dir):
    """Two consecutive offset ranges applied in turn equal one pass over all events."""
    fe = Fixtures(spark, sf_dir).fx_file_events
    state1 = ops.apply_file_events(None, fe.filter(F.col("off") < 3000000))
    return ops.apply_file_events(state1, fe.filter(F.col("off") >= 3000000))


@register("l6_dedupe_events", views=["fx_file_events"], oracle="""
SELECT DISTINCT repo_id, file_path, "off", is_deleted, sha256(content) AS content_sha FROM fx_file_events""")
def l6_dedupe_events(spark, sf_dir):
    """At-least-once redelivery (every tenth event twice) collapsed on the event identity."""
    fe = Fixtures(spark, sf_dir).fx_file_events
    delivered = fe.unionByName(fe.filter(F.col("off") % 10 == 0))
    out = ops.dedupe_events(delivered, id_col=None)
    return out.select("repo_id", "file_path", "off", "is_deleted", F.sha2("content", 256).alias("content_sha"))


@register("a4_event_sink", views=["fx_file_events"], oracle="""
SELECT repo_id AS key, 'STREAMED_FILE' AS event_type, count(*) AS events, sum(CAST("off" AS HUGEINT))::DOUBLE AS offsets,
       TRUE AS in_order FROM fx_file_events GROUP BY repo_id""")
def a4_event_sink(spark, sf_dir):
    """A4: records written by the file sink and read back: complete, and in key order within files."""
    from ..session import checkpoint_path
    base = checkpoint_path(spark, "a4", unique=True)
    fe = _file_events(Fixtures(spark, sf_dir))
    rec = src.to_event_records(fe, value_cols=[*FE_COLS, "off"])
    src.write_events(rec.withColumn("_off", F.get_json_object("value", "$.off").cast("long")), {"path": base}, order_col="_off")
    back = spark.read.parquet(base)
    w = Window.partitionBy("_file").orderBy("_row")
    placed = back.select("key", "event_type", "_off", F.col("_metadata.file_path").alias("_file"),
                         F.col("_metadata.row_index").alias("_row")).repartition(max(1, len(back.inputFiles())), "_file")
    before = F.lag(F.struct("key", "_off")).over(w)
    ordered = placed.withColumn("_ok", before.isNull() | (before <= F.struct("key", "_off")))
    return ordered.groupBy("key", "event_type").agg(
        F.count(F.lit(1)).alias("events"), F.sum("_off").cast("double").alias("offsets"), F.every("_ok").alias("in_order"))


@register("a4_committed_sink", views=["fx_file_events"], oracle=f"""
SELECT 'repo.events' AS topic, repo_id AS key, count(*) AS records FROM fx_file_events GROUP BY repo_id
UNION ALL SELECT 'repo.events.dlq', key, count(*) FROM ({REJECT_SQL}) GROUP BY key""")
def a4_committed_sink(spark, sf_dir):
    """Records and dead letters written as committed batches: one is written twice under the
    same name, one fails in the middle; each is there once or not at all."""
    from pyspark.errors import PySparkException

    from ..session import checkpoint_path
    from ..sources.committed import CommittedSink, read_committed
    base = checkpoint_path(spark, "a4-committed", unique=True)
    spark.dataSource.register(CommittedSink)
    raw = _raw(Fixtures(spark, sf_dir))
    _, rejects = src.decode_events(raw, types=["STREAMED_FILE"])
    good = raw.select("topic", "key", "offset")
    dead = src.to_dlq(rejects, now_ms=0).select("topic", "key", F.lit(None).cast("long").alias("offset"))
    put = lambda df, batch: df.write.format("committed").option("path", base).option("batch", batch).mode("append").save()
    put(good.filter("offset % 2 = 0"), "even")
    put(dead, "dead")
    put(dead, "dead")
    try:
        broken = F.when(F.col("offset") % 1000 == 1, F.raise_error(F.lit("record refused"))).otherwise(F.col("topic"))
        put(good.withColumn("topic", broken), "broken")
    except PySparkException as error:
        if "record refused" not in str(error):
            raise
    put(good.filter("offset % 2 <> 0"), "odd")
    return read_committed(spark, base, good.schema).groupBy("topic", "key").agg(F.count(F.lit(1)).alias("records"))


@register("a3_read_events", views=["fx_file_events"], oracle="""
SELECT repo_id AS key, count(*) AS records, min("off") AS first_offset, max("off") AS last_offset FROM fx_file_events GROUP BY repo_id""")
def a3_read_events(spark, sf_dir):
    """A3: the landed event log read through the event source, batch mode."""
    from ..session import checkpoint_path
    base = checkpoint_path(spark, "a3", unique=True)
    _raw(Fixtures(spark, sf_dir)).write.parquet(base)
    log = src.read_events(spark, {"format": "parquet", "path": base})
    return log.groupBy("key").agg(F.count(F.lit(1)).alias("records"), F.min("offset").alias("first_offset"),
                                  F.max("offset").alias("last_offset"))


def _typed_log(fx: Fixtures):
    """Orders as events of the five other types; every 31st lacks a required field."""
    o, k = fx.orders, F.col("o_orderkey") % 5
    key = F.col("o_orderkey").cast("string")
    some = F.when(F.col("o_orderkey") % 31 != 0, key)
    head = [F.concat(F.lit("e"), key).alias("event_id"), F.lit("2024-01-01T00:00:00Z").alias("timestamp")]
    name = F.element_at(F.array(*[F.lit(t) for t in OTHER_TYPES]), (k + 1).cast("int"))
    body = (F.when(k == 0, F.to_json(F.struct(name.alias("event_type"), *head, F.struct(
                some.alias("repo_id"), F.lit("github").alias("provider"), F.lit("a").alias("old_commit"),
                F.lit("b").alias("new_commit"), F.lit("c").alias("credential_ref")).alias("payload"))))
            .when(k == 1, F.to_json(F.struct(name.alias("event_type"), *head, F.struct(
                key.alias("repo_id"), some.alias("url")).alias("payload"))))
            .when(k == 2, F.to_json(F.struct(name.alias("event_type"), *head, F.struct(some.alias("repo_id"), F.struct(
                F.col("o_custkey").alias("files_processed")).alias("stats")).alias("payload"))))
            .when(k == 3, F.to_json(F.struct(name.alias("event_type"), *head, F.struct(
                key.alias("repo_id"), some.alias("error_code"), F.lit(True).alias("fatal")).alias("payload"))))
            .otherwise(F.to_json(F.struct(F.struct(name.alias("event_type"), head[0]).alias("headers"), some.alias("file_id"),
                                          key.alias("source_id"), F.array(key, key).alias("chunk_ids"), F.lit(2).alias("total_chunks")))))
    return o.select(key.alias("key"), F.encode(body, "UTF-8").alias("value"), F.lit("t").alias("topic"), F.lit(0).alias("partition"),
                    F.col("o_orderkey").alias("offset"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("timestamp"))


OTHER_TYPES = ("REPO_UPDATED", "REPO_INGEST_REQUESTED", "REPO_INGEST_COMPLETED", "REPO_INGEST_FAILED", "EMBEDDING_GENERATED")


@register("a5_decode_other_types", oracle="""
SELECT o_orderkey AS "offset", ['REPO_UPDATED', 'REPO_INGEST_REQUESTED', 'REPO_INGEST_COMPLETED', 'REPO_INGEST_FAILED',
        'EMBEDDING_GENERATED'][o_orderkey % 5 + 1] AS type, CAST(o_orderkey AS VARCHAR) AS ref,
       CASE o_orderkey % 5 WHEN 2 THEN o_custkey WHEN 4 THEN 2 END AS number,
       CASE WHEN o_orderkey % 31 = 0 THEN 'missing_required:' || ['payload.repo_id', 'payload.url', 'payload.repo_id', 'payload.error_code',
        'file_id'][o_orderkey % 5 + 1] END AS error
FROM orders""")
def a5_decode_other_types(spark, sf_dir):
    """A5: the other five event types, typed rows and rejects side by side."""
    log = src.decode_events(_typed_log(Fixtures(spark, sf_dir)), types=list(OTHER_TYPES), split=False)
    kind, bad, turn = F.col("event_type"), F.col("error").isNotNull(), F.col("offset") % 5
    named = F.element_at(F.array(*[F.lit(t) for t in OTHER_TYPES]), (turn + 1).cast("int"))
    processed = F.get_json_object(F.col("value").cast("string"), "$.payload.stats.files_processed").cast("long")
    number = (F.when(bad & (turn == 2), processed).when(bad & (turn == 4), F.lit(2).cast("long")).when(bad, F.lit(None))
              .when(kind == "REPO_INGEST_COMPLETED", F.col("event.payload.stats.files_processed").cast("long"))
              .when(kind == "EMBEDDING_GENERATED", F.size("event.chunk_ids").cast("long")))
    ref = F.when(bad, F.col("key")).when(kind == "EMBEDDING_GENERATED", F.col("event.file_id")).otherwise(F.col("event.payload.repo_id"))
    return log.select("offset", F.when(bad, named).otherwise(kind).alias("type"), ref.alias("ref"), number.alias("number"), "error")


@register("u1_handler", views=["fx_file_events"], oracle="""
SELECT repo_id AS key, "off" AS "offset", 'handler refused the batch' AS error FROM fx_file_events""")
def u1_handler(spark, sf_dir):
    """A failing handler's micro-batches are written to the dead-letter output, none is skipped."""
    from ..session import checkpoint_path
    from ..streaming.common import run_handler, write_batch
    base = checkpoint_path(spark, "u1", unique=True)
    _raw(Fixtures(spark, sf_dir)).select("key", "offset").write.parquet(base + "/in")

    def handle(batch, batch_id):
        raise ValueError("handler refused the batch")

    def on_error(batch, batch_id, error):
        write_batch(batch.withColumn("error", F.lit(str(error))), base + "/dlq", batch_id)

    stream = spark.readStream.schema("key string, offset long").parquet(base + "/in")
    run_handler(stream, handle, on_error, base + "/ckpt", {"availableNow": True}).awaitTermination()
    return spark.read.parquet(base + "/dlq").select("key", "offset", "error")
