"""Registered jobs: metadata sanitising (K3) and credential redaction (K4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import privacy as ops
from ..sources.fixtures import Fixtures
from .catalog import register


@register("k3_sanitize_metadata", oracle="""
SELECT event_id, MAP {'k': CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR)} AS props, [event_type] AS tags,
       [CAST(value AS VARCHAR), CAST(CAST(user_id AS DOUBLE) AS VARCHAR)] AS nums,
       CASE WHEN event_type = 'click' THEN 'True' ELSE 'False' END AS is_click,
       CAST(value AS VARCHAR) AS score, CAST(user_id AS VARCHAR) AS "user", FALSE AS has_long_key,
       ['at'] AS meta_keys
FROM events""")
def k3_sanitize_metadata(spark, sf_dir):
    """Nested metadata documents built from the events table (props object, tags list with a
    null, numbers, a boolean, an over-long key, a nested object with a null) cleaned
    recursively; the cleaned JSON is read back field by field."""
    e = Fixtures(spark, sf_dir).events
    long_key = "k" * 101
    doc = F.to_json(F.struct(
        F.from_json("props", "map<string,int>").alias("props"),
        F.array(F.col("event_type"), F.lit(None).cast("string")).alias("tags"),
        F.array(F.col("value"), F.col("user_id").cast("double")).alias("nums"),
        (F.col("event_type") == "click").alias("is_click"), F.col("value").alias("score"),
        F.col("user_id").alias("user"), F.repeat(F.lit("k"), 101).alias(long_key),
        F.struct(F.col("ts").cast("string").alias("at"), F.lit(None).cast("string").alias("gone")).alias("meta")),
        {"ignoreNullFields": "false"})
    src = e.select("event_id", doc.alias("metadata"))
    clean = ops.sanitize_metadata(src, "metadata", nested=True)
    back = F.from_json("metadata", "props map<string,string>, tags array<string>, nums array<string>, is_click string, "
                                   "score string, user string, meta map<string,string>")
    return clean.select("event_id", back.alias("m"),
                        F.get_json_object("metadata", f"$.{long_key}").isNotNull().alias("has_long_key")) \
        .select("event_id", "m.props", "m.tags", "m.nums", "m.is_click", "m.score", "m.user", "has_long_key",
                F.array_sort(F.map_keys("m.meta")).alias("meta_keys"))


@register("k3_sanitize_metadata_flat", oracle="""
WITH m AS (SELECT event_id, MAP {'event_type': event_type, 'props': props, 'user': CAST(user_id AS VARCHAR),
                                 'note': repeat('n', 1200), 'none': NULL} AS md FROM events)
SELECT event_id, map_from_entries(list_transform(list_filter(map_entries(md), lambda e: length(e.key) <= 100 AND e.value IS NOT NULL),
                                                 lambda e: {'key': e.key, 'value': substr(e.value, 1, 1000)})) AS metadata
FROM m""")
def k3_sanitize_metadata_flat(spark, sf_dir):
    """K3: flat metadata maps cleaned with built-in functions."""
    e = Fixtures(spark, sf_dir).events
    m = F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("props"), F.col("props"),
                     F.lit("user"), F.col("user_id").cast("string"), F.lit("note"), F.repeat(F.lit("n"), 1200),
                     F.lit("none"), F.lit(None).cast("string"))
    return ops.sanitize_metadata(e.select("event_id", m.alias("metadata")), "metadata", nested=False)


@register("k4_redact_credentials", oracle="""
WITH c AS (SELECT c_custkey AS id,
  CASE c_custkey % 3 WHEN 0 THEN MAP {'access_token': c_name, 'client_id': 'cid-' || CAST(c_custkey AS VARCHAR)}
                     WHEN 1 THEN MAP {'refresh_token': substr(c_name, 1, 8), 'client_secret': c_name || '-secret'}
                     ELSE MAP {'access_token': NULL, 'scope': 'repo'} END AS m FROM customer)
SELECT id, map_from_entries(list_transform(map_entries(m), lambda e: {'key': e.key, 'value':
         CASE WHEN e.key IN ('access_token', 'refresh_token', 'client_secret')
              THEN CASE WHEN e.value IS NOT NULL AND length(e.value) > 8 THEN left(e.value, 4) || '...' || right(e.value, 4) ELSE '***' END
              ELSE e.value END})) AS credentials
FROM c""")
def k4_redact_credentials(spark, sf_dir):
    """K4: credentials redacted for logging."""
    c = Fixtures(spark, sf_dir).customer
    k = F.col("c_custkey") % 3
    m = (F.when(k == 0, F.create_map(F.lit("access_token"), F.col("c_name"), F.lit("client_id"),
                                      F.concat(F.lit("cid-"), F.col("c_custkey").cast("string"))))
          .when(k == 1, F.create_map(F.lit("refresh_token"), F.substring("c_name", 1, 8), F.lit("client_secret"),
                                     F.concat("c_name", F.lit("-secret"))))
          .otherwise(F.create_map(F.lit("access_token"), F.lit(None).cast("string"), F.lit("scope"), F.lit("repo"))))
    return ops.redact_credentials(c.select(F.col("c_custkey").alias("id"), m.alias("credentials")), "credentials")
