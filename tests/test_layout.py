"""The mart laid out by session."""

import pytest

from stagepath.operators import depth
from stagepath.plans.layout import PARTIAL_KEYS, SessionLayout
from stagepath.plans.mart import build_enriched_mart
from stagepath.staging import Staging
from tests.conftest import make_events, settings


def rows_of(frame):
    return sorted(map(repr, frame.collect()))


@pytest.fixture(scope="module")
def mart(spark):
    rows = [(f"s{i % 40}", i % 7, ("view", "view", "cart", "purchase")[i % 4], i, 1.0) for i in range(400)]
    rows += [("hot", i, "view", i, 2.0) for i in range(60)]
    staging = Staging(spark)
    return staging.save(build_enriched_mart(make_events(spark, rows), staging), "mart")


@pytest.mark.parametrize("hot_rows", [1, 20, 10**6])
def test_the_layout_holds_the_mart(spark, mart, tmp_path, hot_rows):
    layout = SessionLayout(spark, f"mart_{hot_rows}")
    layout.store(mart, str(tmp_path / "mart"), 4, hot_rows)
    assert rows_of(layout.mart()) == rows_of(mart)
    assert rows_of(layout.sessions()) == rows_of(depth.sessions(mart))
    hot = {r.user_session for r in spark.table(f"mart_{hot_rows}_hot").select("user_session").collect()}
    assert ("hot" in hot) == (hot_rows < 60) and (len(hot) <= 1 or hot_rows == 1)
    found = layout.with_pairs(layout)
    pairs = mart.where("product_id is not null")
    assert found.count() == pairs.count() and found.where("first_view <> other_first_view").isEmpty()


def test_sums_per_session_and_joins_on_the_pair_need_no_exchange(spark, mart, tmp_path):
    layout = SessionLayout(spark, "mart_plan")
    layout.store(mart, str(tmp_path / "mart"), 4)
    with settings(
        spark, spark__sql__adaptive__enabled="false", spark__sql__autoBroadcastJoinThreshold="-1", **{k.replace(".", "__"): v for k, v in PARTIAL_KEYS.items()}
    ):
        table = spark.table("mart_plan")
        plan = depth.sessions(table)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "HashAggregate" in plan
        joined = table.join(spark.table("mart_plan").select("user_session", "product_id"), ["user_session", "product_id"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
