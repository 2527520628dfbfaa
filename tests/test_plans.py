"""Plan-shape guards for every registered batch job: no pair-emitting joins, top-n jobs
cut map-side, aggregates partial."""

import re

import pytest

import __spark_entry__ as E
from quarry.plans import catalog

SF = "/root/testdata/sf0.001"
STREAMING = re.compile(r"^(l1_webhook_stream|l2_update_stream|l3_rate_limit_stream|l4_latest_status_stream|"
                       r"l5_reassemble_stream|l6_dedupe_stream|l7_polling_stream|a8_connector_scan|a8_connector_stream)$")
BATCH = sorted(n for n in catalog.queries() if not STREAMING.match(n))


def plan_of(spark, name):
    df = E.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_or_nested_loop_joins(spark, name):
    plan = plan_of(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


@pytest.mark.parametrize("name", ["h3_top_repositories", "g2_dedupe_kept", "e7_apply_file_events"])
def test_top_n_is_limited_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan_of(spark, name)


def test_flagship_aggregates_partially(spark):
    plan = plan_of(spark, "flagship_file_mix")
    assert plan.count("HashAggregate") >= 2 and "Window" not in plan


def test_every_job_has_an_oracle_and_a_survey_id():
    names = set(catalog.queries())
    assert names == set(catalog.oracle_sql()) and names <= set(E.queries())
    ids = re.compile(r"^(flagship|[a-l]\d+|u1)_")
    assert all(ids.match(n) for n in names), sorted(n for n in names if not ids.match(n))


def test_snapshot_diff_shuffles_little(spark):
    plan = plan_of(spark, "e5_diff_snapshots")
    assert plan.count("Exchange hashpartitioning") <= 6, plan


def test_events_are_parsed_once(spark):
    for name in ("a5_decode_events", "a5_decode_rejects"):
        plan = E.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") == 1, name


def test_file_state_moves_no_losing_content(spark):
    plan = plan_of(spark, "e7_apply_file_events")
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_embedding_events_are_bounded(spark):
    """No event of the completeness audit gathers a whole file, however many chunks it has."""
    from pyspark.sql import functions as F

    from quarry.operators import audit as ops
    from quarry.plans import audit

    ids = spark.range(7000).unionByName(spark.range(3000))
    chunks = ids.select(F.col("id").alias("chunk_id"), F.lit("src0").alias("file_id"), F.lit("en").alias("chunk_type"),
                        (F.col("id") != 5).alias("embedded"))
    events = audit.embedding_events(chunks)
    assert events.agg(F.max(F.size("chunk_ids"))).first()[0] <= 1000
    assert [tuple(r) for r in ops.embedding_completeness(events).collect()] == [("src0", 7000, 6999, False)]
