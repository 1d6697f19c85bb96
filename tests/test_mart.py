"""The ordered funnel: hand-made edge rows, brute force, invariants."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stagepath.functions.bands import price_band
from stagepath.model import FUNNEL, Funnel
from stagepath.operators import conversion, depth, profile, segments, stages
from stagepath.plans import mart as mart_plan
from stagepath.plans.mart import build_enriched_mart, build_mart, ordered_stages, step_counts
from stagepath.staging import Staging
from tests.conftest import at, make_events

# session, product, first view, cart, purchase, price, band
EDGE_MART = {
    ("A", 1, 1, 2, 3, 10.0, "Q1_low"),
    ("A", 2, 1, 1, None, 58.95, "Q1_low"),
    ("A", 3, 2, 3, None, 153.47, "Q2"),
    ("A", 4, 1, None, None, 334.13, "Q3"),
    ("A", 5, 1, 3, None, 334.14, "Q4_high"),
    ("A", 6, 1, 2, 4, 60.0, "Q2"),
    ("C", None, 1, None, None, 1.0, "Q1_low"),
    ("C", 8, 1, None, None, None, "Q4_high"),
    ("C", 9, 1, None, None, 0.0, "0_price"),
    ("D", 10, 1, None, None, -1.0, "Q1_low"),
    ("E", 11, 1, None, None, 10.0, "Q1_low"),
    ("F", 12, 2, None, None, 1.0, "Q1_low"),
}


@pytest.fixture(scope="module")
def edge_mart(spark, edge_events):
    return build_enriched_mart(edge_events, Staging(spark))


def test_edge_rows(edge_mart):
    rows = edge_mart.withColumn("band", price_band(F.col("view_price"))).collect()
    expected = {(s, p, at(v), at(c), at(b), price, band) for s, p, v, c, b, price, band in EDGE_MART}
    assert {
        (
            r.user_session, r.product_id, r.first_view, r.first_valid_cart,
            r.first_valid_purchase, r.view_price, r.band,
        )
        for r in rows
    } == expected
    assert len(rows) == len(expected)
    for r in rows:
        assert r.cart_flag == (r.first_valid_cart is not None)
        assert r.purchase_flag == (r.first_valid_purchase is not None)


def test_null_band_is_opt_in(edge_mart):
    banded = edge_mart.select(price_band(F.col("view_price"), null_band="unknown").alias("b"))
    assert banded.where("b = 'unknown'").count() == 1


def test_edge_order_check(edge_events):
    row = profile.stage_order_check(edge_events).first()
    assert row.asDict() == {
        "view_to_cart_ordered": 5,
        "view_cart_reversed": 2,
        "cart_to_purchase_ordered": 2,
        "cart_purchase_reversed": 2,
    }


def test_only_straddled_pairs_stay_open(edge_events):
    pending = stages.pair_bounds(edge_events).where("open").collect()
    # A3 has carts on both sides of its view, A6 purchases on both sides of its cart.
    assert {(r.user_session, r.product_id) for r in pending} == {("A", 3), ("A", 6)}


def test_pending_events_hold_each_time_once(spark):
    rows = [("A", 1, "view", 2, 1.0), ("B", 1, "view", 1, 1.0), ("B", 1, "cart", 1, 1.0)]
    rows += [("A", 1, kind, t, 1.0) for kind in ("cart", "purchase") for t in (1, 3, 4)] * 50
    ev = make_events(spark, rows)
    pending = stages.pair_bounds(ev).where("open")
    events = stages.later_events(pending, ev).collect()
    assert {(r.user_session, r.event_type, r.event_time) for r in events} == {
        ("A", kind, at(t)) for kind in ("cart", "purchase") for t in (3, 4)
    }
    assert len(events) == 4


def test_stages_agree_with_each_other(spark, edge_events, edge_mart):
    """The step-by-step operators give the same times as the one-pass build."""
    staging = Staging(spark)
    view = staging.save(stages.first_stage(edge_events, "view"), "view")
    cart = staging.save(stages.next_stage(view, edge_events, "cart", "first_view"), "cart")
    bought = stages.next_stage(cart, edge_events, "purchase", "first_valid_cart")
    columns = ["user_session", "product_id", *(FUNNEL.reached(s) for s in FUNNEL.stages)]
    assert sorted(bought.select(columns).collect(), key=repr) == sorted(
        edge_mart.select(columns).collect(), key=repr
    )


def test_view_with_unknown_time_is_a_pair(spark):
    ev = make_events(
        spark,
        [("A", 1, "view", None, 5.0), ("A", 1, "cart", 1, 5.0),
         ("A", 2, "view", None, 5.0), ("A", 2, "view", 3, 7.0)],
    )
    rows = build_enriched_mart(ev, Staging(spark)).orderBy("product_id").collect()
    assert [(r.first_view, r.view_price, r.cart_flag) for r in rows] == [
        (None, 5.0, 0),
        (at(3), 7.0, 0),
    ]


def test_empty_log(spark):
    ev = make_events(spark, [])
    mart = build_enriched_mart(ev, Staging(spark))
    assert mart.count() == 0
    row = conversion.funnel_totals(mart).first()
    assert (row.view_count, row.view_to_cart_rate) == (0, None)
    assert segments.price_distribution(mart).first().median is None
    assert depth.session_depth_distribution(depth.sessions(mart)).first().sessions == 0
    assert conversion.first_view_events(mart, ev).count() == 0


def brute_force(rows, stage_names):
    """Follows every pair event by event."""
    pairs = {}
    for session, product, kind, seconds, _ in rows:
        if session is not None:
            pairs.setdefault((session, product), []).append((kind, seconds))
    result = set()
    for (session, product), events in pairs.items():
        reached = None
        times = []
        for i, stage in enumerate(stage_names):
            later = [
                t for kind, t in events
                if kind == stage
                and (i == 0 or (product is not None and reached is not None and t >= reached))
            ]
            reached = min(later, default=None)
            times.append(reached)
        if times[0] is not None:
            result.add((session, product, *times))
    return result


def built(spark, rows, funnel=FUNNEL):
    ev = make_events(spark, rows)
    names = [funnel.reached(s) for s in funnel.stages]
    frame = ordered_stages(ev, Staging(spark), funnel)
    seconds = lambda t: None if t is None else int((t - at(0)).total_seconds())
    collected = [
        (r.user_session, r.product_id, *(seconds(r[n]) for n in names)) for r in frame.collect()
    ]
    assert len(set(collected)) == len(collected)
    return set(collected)


EVENT = st.tuples(
    st.sampled_from(["A", "B", None]),
    st.sampled_from([1, 2, None]),
    st.sampled_from(["view", "cart", "purchase", "other"]),
    st.integers(0, 8),
    st.just(1.0),
)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(EVENT, min_size=1, max_size=40))
def test_short_logs_match_brute_force(spark, rows):
    assert built(spark, rows) == brute_force(rows, FUNNEL.stages)


def test_long_log_matches_brute_force(spark):
    rng = random.Random(7)
    rows = [
        (
            rng.choice(["hot"] * 3 + [f"s{i}" for i in range(40)]),
            rng.choice([1, 1, 2, 3, None]),
            rng.choice(["view", "cart", "purchase"]),
            rng.randrange(500),
            1.0,
        )
        for _ in range(4000)
    ]
    assert built(spark, rows) == brute_force(rows, FUNNEL.stages)


@pytest.mark.parametrize("names", [("view",), ("view", "purchase"), ("a", "b", "c", "d")])
def test_any_list_of_stages(spark, names):
    rng = random.Random(11)
    rows = [
        (f"s{rng.randrange(12)}", rng.randrange(4), rng.choice(names), rng.randrange(60), 1.0)
        for _ in range(1500)
    ]
    assert built(spark, rows, Funnel(names)) == brute_force(rows, names)


def test_counts_fit_together(spark, edge_mart):
    totals = conversion.funnel_totals(edge_mart).first()
    assert totals.view_count >= totals.cart_count >= totals.purchase_count
    known = edge_mart.where(conversion.has_product()).count()

    def total(frame, column="view_count"):
        return frame.agg(F.sum(column)).first()[0]

    assert total(segments.price_band_counts(edge_mart)) == totals.view_count
    assert (
        total(segments.price_band_conversion(edge_mart.where(conversion.has_product()))) == known
    )
    assert total(depth.depth_band_conversion(depth.sessions(edge_mart))) == totals.view_count
    crosstab = depth.depth_cart_crosstab(depth.sessions(edge_mart))
    assert total(crosstab, "cart_yes") == totals.cart_count
    assert total(crosstab, "cart_no") == totals.view_count - totals.cart_count


@pytest.mark.parametrize("lost", [None, "resolved", "mart"])
def test_stage_row_checks_show_a_lost_pair(edge_events, staging, monkeypatch, lost):
    if lost == "resolved":
        follow = stages.follow
        monkeypatch.setattr(stages, "follow", lambda *given: follow(*given).where("product_id <> 3"))
    mart = build_enriched_mart(edge_events, staging)
    if lost == "mart":
        mart = mart.where("NOT (user_session = 'A' AND product_id = 1)")
    rows = {r.stage: r for r in conversion.stage_row_checks(step_counts(staging), mart).collect()}
    short = {None: set(), "resolved": {"cart", "purchase", "mart"}, "mart": {"mart"}}[lost]
    assert list(rows) == ["view", "cart", "purchase", "mart"]
    assert {stage for stage, r in rows.items() if r.total == 11} == short
    assert {stage for stage, r in rows.items() if r.total == 12} == set(rows) - short
    assert rows["view"].cart_count is None and rows["cart"].purchase_count is None
    assert rows["purchase"].purchase_count == 2 and rows["mart"].purchase_count == 2 - (lost == "mart")


def test_row_checks_of_an_empty_mart_have_no_sums(spark, staging):
    mart = build_enriched_mart(make_events(spark, []), staging)
    rows = {r.stage: r for r in conversion.stage_row_checks(step_counts(staging), mart).collect()}
    assert rows["mart"].total == 0
    assert rows["mart"].cart_count is None and rows["mart"].purchase_count is None


def test_steps_are_measured_as_they_are_written(spark, staging):
    """No job but the writing of the steps goes over the log; an empty log counts 0."""
    build_enriched_mart(make_events(spark, []), staging)
    assert step_counts(staging) == {
        "view": {"total": 0}, "cart": {"total": 0, "cart": 0},
        "purchase": {"total": 0, "cart": 0, "purchase": 0},
    }


def test_a_failed_write_leaves_the_earlier_mart(spark, tmp_path, edge_mart):
    path = str(tmp_path / "mart")
    stored = mart_plan.write_mart(edge_mart, path)
    broken = edge_mart.withColumn("cart_flag", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        mart_plan.write_mart(broken, path)
    assert mart_plan.read_mart(spark, path).count() == stored.count() == 12
    mart_plan.write_mart(edge_mart.limit(3), path)
    assert mart_plan.read_mart(spark, path).count() == 3
    # Those who read the one before go on.
    assert stored.count() == 12


def test_mart_columns(spark, edge_events):
    mart = build_mart(edge_events, Staging(spark))
    assert [tuple(r) for r in conversion.mart_schema(mart).collect()] == [
        ("user_session", "string"),
        ("product_id", "bigint"),
        ("first_view", "timestamp_ntz"),
        ("first_valid_cart", "timestamp_ntz"),
        ("first_valid_purchase", "timestamp_ntz"),
        ("cart_flag", "int"),
        ("purchase_flag", "int"),
    ]


def test_first_view_events_keeps_ties(edge_events, edge_mart):
    rows = conversion.first_view_events(edge_mart, edge_events, n=100).collect()
    # Every joinable pair once, and E11 twice because its views tie in time.
    assert len(rows) == 12
    assert sorted(r.price for r in rows if r.product_id == 11) == [10.0, 200.0]
    assert conversion.first_view_events(edge_mart, edge_events, n=3).collect() == rows[:3]


def test_depth_bands_come_in_order(spark):
    sizes = {"a": 1, "b": 2, "c": 5, "d": 12, "e": 30}
    rows = [(s, p, "view", 1, 1.0) for s, n in sizes.items() for p in range(n)]
    rows += [("b", 0, "cart", 2, 1.0), ("e", 3, "cart", 2, 1.0), ("e", 3, "purchase", 2, 1.0)]
    sessions = depth.sessions(build_mart(make_events(spark, rows), Staging(spark)))
    bands = ["1", "2-3", "4-6", "7-20", "21+"]
    for operator in (
        depth.depth_band_conversion,
        depth.depth_cart_crosstab,
        depth.session_depth_any_cart,
        depth.depth_cart_rate,
        depth.depth_purchase_rate,
    ):
        assert [r.session_group for r in operator(sessions).collect()] == bands
    rates = {r.session_group: r for r in depth.depth_cart_rate(sessions).collect()}
    assert rates["2-3"].median_cart_rate == 50.0
    assert rates["21+"].avg_cart_rate == pytest.approx(100 / 30)
    assert rates["1"].avg_cart_rate == 0.0
    baseline = depth.multi_view_baseline(sessions).first()
    assert (baseline.view_count, baseline.cart_count, baseline.purchase_count) == (49, 2, 1)
