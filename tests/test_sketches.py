"""Distinct counts that add up over logs, and reading no more of the log than is wanted."""

import pytest
from pyspark.sql import functions as F

from stagepath.operators import conversion, profile
from stagepath.plans.mart import build_enriched_mart


def test_sketches_of_logs_add_up(spark, staging):
    n = 60_000
    ev = spark.range(n).select(
        (F.col("id") % 3).cast("string").alias("log"),
        (F.col("id") % 20_000).alias("user_id"),
        F.when(F.col("id") % 7 > 0, F.concat(F.lit("s"), F.col("id") % 30_000)).alias("user_session"),
    )
    stored = staging.save(profile.distinct_sketches(ev, "log"), "sketches")
    exact = ev.agg(F.count_distinct("user_id").alias("u"), F.count_distinct("user_session").alias("s")).first()
    row = profile.approximate_profile(stored).first()
    assert row.total_events == n
    assert row.users == pytest.approx(exact.u, rel=0.05) and row.sessions == pytest.approx(exact.s, rel=0.05)
    for one in profile.approximate_profile(stored, "log").collect():
        mine = ev.where(F.col("log") == one.log).agg(F.count_distinct("user_id")).first()[0]
        assert one.users == pytest.approx(mine, rel=0.05)
    sizes = stored.select(F.octet_length("users")).collect()
    assert max(r[0] for r in sizes) < 5_000
    nothing = profile.approximate_profile(profile.distinct_sketches(ev.limit(0), "log")).first()
    assert (nothing.total_events, nothing.users or 0) == (0, 0)


def test_only_the_days_of_the_heads_are_read(spark, edge_events, staging, tmp_path):
    days = edge_events.withColumn(
        "event_time", F.expr("event_time + make_dt_interval(cast(event_id % 9 as int))")
    ).withColumn("event_date", F.to_date("event_time"))
    path = str(tmp_path / "log")
    days.write.partitionBy("event_date").parquet(path)
    log = spark.read.parquet(path)
    mart = build_enriched_mart(days.drop("event_date"), staging)
    found = conversion.first_view_events(mart, log, n=2)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "event_date" in scan.split("PartitionFilters: ")[1].split("]")[0]
    pushed = scan.split("PushedFilters: ")[1]
    assert "event_time" in pushed and "user_session" in pushed
    everything = conversion.first_view_events(mart, days.drop("event_date"), n=100).collect()
    assert found.collect() == everything[:2]
    assert conversion.first_view_events(mart.limit(0), log).collect() == []
