"""What Spark makes of the operators: scans, shuffles, joins, skew."""

import pytest
from pyspark.sql import functions as F

from stagepath.operators import conversion, depth, profile, segments, stages
from stagepath.plans.mart import build_enriched_mart
from stagepath.sources.event_table import canonical_events
from stagepath.staging import Staging
from tests.conftest import TESTDATA, at, make_events, settings


@pytest.fixture(scope="module")
def log(spark):
    """The events as a stored table, as after an ingest."""
    return Staging(spark).save(canonical_events(spark, f"{TESTDATA}/sf0.01"), "events")


@pytest.fixture(scope="module")
def mart(spark, log):
    return build_enriched_mart(log, Staging(spark))


def planned(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def executed(frame):
    rows = frame.collect()
    plan = planned(frame)
    return rows, plan[: plan.index("Initial Plan")]


def shuffles(plan):
    return plan.count("Exchange hashpartitioning")


def test_bounds_need_one_scan_and_one_combined_shuffle(log):
    plan = planned(stages.pair_bounds(log))
    assert shuffles(plan) == 1
    assert plan.count("FileScan") == 1
    assert "Window" not in plan and "Join" not in plan and "SortAggregate" not in plan
    # The partial aggregation sits below the shuffle.
    assert plan.index("Exchange") < plan.rindex("HashAggregate")
    assert "ReadSchema: struct<event_time:timestamp_ntz,event_type:string,product_id:bigint,user_session:string>" in plan


def test_attributes_ride_along_in_the_same_shuffle(log):
    plan = planned(stages.pair_bounds(log, attributes={"price": "view_price", "brand": "brand"}))
    assert shuffles(plan) == 1 and plan.count("FileScan") == 1
    assert plan.index("Exchange") < plan.rindex("SortAggregate")


def test_stage_filters_reach_the_scan(log):
    plan = stages.first_stage(log, "view")._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "EqualTo(event_type,view)" in text and "IsNotNull(user_session)" in text


def test_pending_events_are_spread_by_all_their_columns(log):
    pending = stages.pair_bounds(log).where("open")
    plan = planned(stages.later_events(pending, log))
    # The topmost shuffle follows a reduction in the joining tasks.
    top = plan[: plan.index("Join")]
    assert top.count("Exchange hashpartitioning(event#") == 1
    assert top.count("HashAggregate(keys=[event#") == 2


def test_quality_checks_scan_once(log):
    assert planned(profile.quality_long(log)).count("FileScan") == 1


def test_distinct_counts_are_reduced_before_the_shuffle(log):
    plan = planned(profile.log_profile(log.withColumn("p", F.lit(1)), "p"))
    assert plan.count("FileScan") == 1
    # From the top: the last exchange, the aggregation below it, then the expansion.
    assert plan.rindex("Exchange") < plan.rindex("HashAggregate") < plan.index("Expand")


@pytest.mark.parametrize(
    "operator",
    [
        depth.depth_band_conversion,
        depth.depth_cart_crosstab,
        depth.session_depth_any_cart,
        depth.depth_purchase_rate,
        depth.multi_view_baseline,
    ],
)
def test_depth_needs_neither_window_nor_join(mart, operator):
    plan = planned(operator(depth.sessions(mart)))
    assert "Window" not in plan and "Join" not in plan


def test_category_depth_needs_neither_window_nor_join(mart):
    plan = planned(depth.category_depth_conversion(mart, "cat.3"))
    assert "Window" not in plan and "Join" not in plan


@pytest.mark.parametrize(
    "operator",
    [
        lambda em: conversion.top_conversion(em, "brand"),
        segments.category_price_mix,
        segments.top_category_price_conversion,
    ],
)
def test_top_values_come_from_one_aggregation(mart, operator):
    plan = planned(operator(mart))
    assert "TakeOrderedAndProject" in plan
    assert shuffles(plan) == 1 and "Join" not in plan


def test_quantiles_count_values_once(mart):
    _, plan = executed(segments.price_distribution(mart))
    # Each of the mart's files is read once. The value counts are used four times and their
    # buckets three times: in ranges, in order, and sliced.
    assert plan.count("FileScan") == planned(mart).count("FileScan")
    assert plan.count("ReusedExchange") == 5


def test_quantiles_of_group_sizes_need_no_join(mart):
    plan = planned(depth.session_depth_distribution(depth.sessions(mart)))
    assert "Join" not in plan and shuffles(plan) == 2


def test_sample_meets_the_log_without_a_shuffle_of_the_log(mart, log):
    plan = planned(conversion.first_view_events(mart, log))
    assert "BroadcastHashJoin" in plan and shuffles(plan) == 0


def test_mart_reads_only_wanted_columns(mart):
    plan = planned(conversion.funnel_totals(mart))
    assert "view_price" not in plan and "brand" not in plan


def test_small_sides_are_broadcast_by_size_only(spark, log):
    prev = Staging(spark).save(stages.first_stage(log, "view"), "view")
    assert "BroadcastHashJoin" in planned(stages.next_stage(prev, log, "cart", "first_view"))
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        plan = planned(stages.next_stage(prev, log, "cart", "first_view"))
        assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_hot_pair_is_split(spark):
    """A pair that holds most of the log is joined by several tasks."""
    seconds = F.col("id") % 5000
    hot = spark.range(200_000, numPartitions=8).select(
        F.col("id").alias("event_id"),
        (F.lit(at(0)).cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)).alias("event_time"),
        F.when(F.col("id") % 4 == 0, "view").otherwise("cart").alias("event_type"),
        F.when(F.col("id") % 2 == 1, 1).otherwise(F.col("id") % 900).cast("long").alias("product_id"),
        F.when(F.col("id") % 2 == 1, "bot").otherwise(F.concat(F.lit("s"), F.col("id") % 700)).alias(
            "user_session"
        ),
    )
    views = make_events(spark, [("bot", 1, "view", 2500, 1.0)])
    ev = Staging(spark).save(
        hot.unionByName(views.select(hot.columns)), "events"
    )
    prev = Staging(spark).save(stages.first_stage(ev, "view"), "view")
    with settings(
        spark,
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="20k",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="10k",
    ):
        rows, plan = executed(stages.next_stage(prev, ev, "cart", "first_view"))
    assert "skew=true" in plan
    first_cart = {(r.user_session, r.product_id): r.first_valid_cart for r in rows}
    assert first_cart["bot", 1] == at(2501)
