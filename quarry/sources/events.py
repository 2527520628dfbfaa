"""Event log source and sinks (A3 read, A4 write, A5 typed decode, A6 dead-letter)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import EVENT_SCHEMAS, EVENTS_RAW, FIELD_DEFAULTS, PRESENT_FIELDS, REQUIRED_FIELDS

DEFAULT_TOPIC = "repo.events"


def read_events(spark: SparkSession, cfg: dict, streaming: bool = False) -> DataFrame:
    """A3: the event log as ``key, value, topic, partition, offset, timestamp``.

    ``cfg['format'] == 'kafka'``: Kafka source from the earliest offset; progress lives in
    the streaming checkpoint and is committed only after a micro-batch is processed.
    Any other format reads landed records of the same layout (parquet / json).
    """
    fmt = cfg.get("format", "parquet")
    reader = spark.readStream if streaming else spark.read
    if fmt == "kafka":
        r = (reader.format("kafka")
             .option("kafka.bootstrap.servers", cfg["bootstrap_servers"])
             .option("subscribe", cfg.get("topic", DEFAULT_TOPIC))
             .option("startingOffsets", cfg.get("starting_offsets", "earliest")))
        if not streaming:
            r = r.option("endingOffsets", cfg.get("ending_offsets", "latest"))
        for k, v in cfg.get("options", {}).items():
            r = r.option(k, v)
        return r.load().select(F.col("key").cast("string").alias("key"), "value", "topic", "partition",
                               "offset", "timestamp")
    r = reader.schema(EVENTS_RAW).format(fmt)
    if streaming and cfg.get("max_files_per_trigger"):
        r = r.option("maxFilesPerTrigger", cfg["max_files_per_trigger"])
    return r.load(cfg["path"])


def to_event_records(df: DataFrame, key_col: str = "repo_id", topic: str = DEFAULT_TOPIC,
                     value_cols: list[str] | None = None) -> DataFrame:
    """A4 (transform): typed rows -> ``key, value, topic`` records, key = repo id, JSON value.

    Every record is keyed — per-repository order is what the consumer relies on.
    """
    cols = value_cols or df.columns
    return df.select(F.col(key_col).cast("string").alias("key"),
                     F.to_json(F.struct(*[F.col(c) for c in cols])).alias("value"),
                     F.lit(topic).alias("topic"))


def write_events(records: DataFrame, sink: dict, order_col: str | None = None) -> None:
    """A4 (sink): Kafka when ``sink['format'] == 'kafka'``; otherwise files partitioned by
    event type.

    Kafka keeps per-key order through the record key (the producer partitions by it).
    For files, records are range-partitioned on (key, ``order_col``) and sorted, so one
    repository's events stay ordered and contiguous while a hot repository is still
    spread over several writer tasks: about one for each ``sink['task_mb']`` MB of values (64), so
    that a task's sort doesn't grow with the log.
    """
    fmt = sink.get("format", "parquet")
    if fmt == "kafka":
        (records.select("key", "value", "topic").write.format("kafka")
         .option("kafka.bootstrap.servers", sink["bootstrap_servers"]).save())
        return
    out = records
    volume = records.agg(F.sum(F.octet_length("value").cast("long"))).first()[0] or 0
    tasks = max(1, math.ceil(volume / (sink.get("task_mb", 64) * 1_000_000)))
    if "event_type" not in out.columns:
        out = out.withColumn("event_type", F.get_json_object(F.col("value").cast("string"), "$.event_type"))
    order = [c for c in ("key", order_col) if c]
    # The writer sorts by the folder column unless rows come that way; its sort would undo ours.
    (out.repartitionByRange(tasks, *order).sortWithinPartitions("event_type", *order)
     .write.mode(sink.get("mode", "append")).partitionBy("event_type").format(fmt).save(sink["path"]))


def _nonempty(c: Column) -> Column:
    return c.isNotNull() & (c.cast("string") != "")


def _defaulted(types: list[str], field: str) -> Column:
    """A field of the parsed event, or the default that its type has for it."""
    found = F.col("e." + field)
    for t in types:
        value = FIELD_DEFAULTS.get(t, {}).get(field)
        if value is not None:
            found = F.when(F.col("_type") == t, F.coalesce("e." + field, F.lit(value))).otherwise(found)
    return found.alias(field)


def _merge(a: T.DataType, b: T.DataType) -> T.DataType:
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        fields = {f.name: f.dataType for f in a.fields}
        for f in b.fields:
            fields[f.name] = _merge(fields[f.name], f.dataType) if f.name in fields else f.dataType
        return T.StructType([T.StructField(n, t) for n, t in fields.items()])
    return a


def union_schema(types: list[str]) -> T.StructType:
    """One struct covering every field of the given event types (shared names agree)."""
    out = T.StructType([T.StructField("event_type", T.StringType())])
    for t in types:
        out = _merge(out, T.StructType.fromDDL(EVENT_SCHEMAS[t]))
    return out


def decode_events(raw: DataFrame, types: list[str] | None = None, split: bool = True):
    """A5: bytes -> JSON -> one typed DataFrame per ``event_type``, plus rejects: (typed, rejects).

    Each record is parsed once, against the union of the event schemas, with a
    corrupt-record column for malformed JSON. Empty values are skipped (not rejected).
    Rejects carry ``error`` in {invalid_json, unknown_event_type, missing_required:<field>}
    and the raw record, so they can go to the dead-letter sink in the same micro-batch.

    Each of these frames reads and parses the log for itself. Who needs several takes one frame of
    all records (``split=False``): the raw columns, ``event_type`` and ``error`` (null: accepted) and
    ``event``, a struct of the fields of all types.
    """
    types = types or list(EVENT_SCHEMAS)
    schema = union_schema(types).add("_corrupt", T.StringType())
    text = F.col("value").cast("string")
    meta = [c for c in raw.columns if c != "value"]
    parsed = (raw.filter(F.col("value").isNotNull() & (F.length(text) > 0))
              # Behind a generator the parser's result is a column like any other: filters and
              # projections below are not pushed into it as further parses.
              .select(*meta, "value", F.inline(F.array(F.struct(
                  F.from_json(text, schema, {"columnNameOfCorruptRecord": "_corrupt"}).alias("e"))))))
    etype = F.coalesce(F.col("e.event_type"), F.col("e.headers.event_type")) if "headers" in schema.fieldNames() \
        else F.col("e.event_type")
    bad_json = F.col("e").isNull() | F.col("e._corrupt").isNotNull()
    error = F.when(bad_json, F.lit("invalid_json")).when(etype.isNull() | ~etype.isin(*types), F.lit("unknown_event_type"))
    for t in types:
        missing = F.lit(None).cast("string")
        for field in reversed(PRESENT_FIELDS.get(t, [])):
            missing = F.when(F.col("e." + field).isNull(), F.lit("missing_required:" + field)).otherwise(missing)
        for field in reversed(REQUIRED_FIELDS.get(t, [])):
            missing = F.when(~_nonempty(F.col("e." + field)), F.lit("missing_required:" + field)).otherwise(missing)
        error = error.when(etype == t, missing)
    tagged = parsed.withColumn("_type", etype).withColumn("error", error)
    if not split:
        event = F.struct(*[_defaulted(types, f) for f in union_schema(types).fieldNames()])
        return tagged.select(*meta, "value", F.col("_type").alias("event_type"), "error", event.alias("event"))
    typed: dict[str, DataFrame] = {}
    for t in types:
        fields = T.StructType.fromDDL(EVENT_SCHEMAS[t]).fieldNames()
        typed[t] = (tagged.filter((F.col("_type") == t) & F.col("error").isNull())
                    .select(*meta, *[_defaulted([t], f) for f in fields]))
    rejects = tagged.filter(F.col("error").isNotNull()).select(*meta, "value", "error")
    return typed, rejects


def to_dlq(rejects: DataFrame, topic: str = DEFAULT_TOPIC, dlq_topic: str | None = None,
           now_ms: Column | int | None = None) -> DataFrame:
    """Failed records -> dead-letter records ``{failedTopic, failedAt, error, event}``
    on ``dlq_topic`` or ``<topic>.dlq``, same key. ``now_ms`` pins the clock (tests)."""
    at = (F.lit(now_ms) if isinstance(now_ms, int) else now_ms) if now_ms is not None \
        else F.unix_millis(F.current_timestamp())
    src_topic = F.coalesce(F.col("topic"), F.lit(topic)) if "topic" in rejects.columns else F.lit(topic)
    env = F.struct(src_topic.alias("failedTopic"), at.cast("bigint").alias("failedAt"),
                   F.col("error").alias("error"), F.col("value").cast("string").alias("event"))
    return rejects.select(
        F.col("key"), F.to_json(env).alias("value"),
        (F.lit(dlq_topic) if dlq_topic else F.concat(src_topic, F.lit(".dlq"))).alias("topic"),
        env.alias("envelope"))
