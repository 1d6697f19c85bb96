"""Rounding, ratios, quantiles and the chi-square tail."""

import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stagepath.functions.distribution import distribution
from stagepath.functions.numeric import chi_square_tail, percent, round_at, significant
from stagepath.operators import experiment


def test_rounding_is_binary(spark):
    row = spark.range(1).select(
        round_at(F.lit(1.005), 2).alias("a"),
        round_at(F.lit(2.675), 2).alias("b"),
        round_at(F.lit(-0.125), 2).alias("c"),
    ).first()
    assert tuple(row) == (1.0, 2.68, -0.13)


def test_percent_of_nothing_is_null(spark):
    assert spark.range(1).select(percent(F.lit(1), F.lit(0))).first()[0] is None


def tail(x, k):
    """Survival function from the standard library, any k."""
    half = x / 2
    if k % 2 == 0:
        return math.exp(-half) * sum(half**i / math.factorial(i) for i in range(k // 2))
    extra = sum(half ** (i + 0.5) / math.gamma(i + 1.5) for i in range((k - 1) // 2))
    return math.erfc(math.sqrt(half)) + math.exp(-half) * extra


def test_chi_square_tail(spark):
    cases = [(x, k) for x in (0.0, 0.1, 1.0, 5.0, 7.9, 8.1, 40.0, 392.5) for k in range(1, 9)]
    frame = spark.createDataFrame(cases, "x double, k bigint")
    for row in frame.withColumn("p", chi_square_tail(F.col("x"), F.col("k"))).collect():
        assert row.p == pytest.approx(tail(row.x, row.k), rel=1e-9, abs=1e-300)
    assert spark.range(1).select(chi_square_tail(F.lit(1.0), F.lit(0))).first()[0] is None


def test_chi_square_tail_with_many_degrees(spark):
    """At x = dof the tail is near a half; known values from the normal limit of the cube root."""
    frame = spark.createDataFrame([(float(k), k) for k in (500, 1499, 1500, 2001, 3000, 10_000)], "x double, k bigint")
    for row in frame.withColumn("p", chi_square_tail(F.col("x"), F.col("k"))).collect():
        z = (2 / (9 * row.k)) ** 0.5
        assert row.p == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=1e-3)


def test_significant_digits(spark):
    frame = spark.createDataFrame([(1.1412345678e-83,), (0.0,), (None,), (123456.7,)], "p double")
    assert [r[0] for r in frame.select(significant(F.col("p"), 4)).collect()] == [1.141e-83, 0.0, None, 123500.0]


def test_chi_square_known_table(spark):
    crosstab = spark.createDataFrame(
        [("1", 4, 535), ("2-3", 8, 1219), ("4-6", 14, 656), ("7-20", 71, 1267), ("21+", 212, 968)],
        "session_group string, cart_yes bigint, cart_no bigint",
    )
    row = experiment.chi_square(crosstab).first()
    assert row.dof == 4
    assert row.chi2 == pytest.approx(392.531669, abs=1e-6)
    assert row.cramers_v == pytest.approx(0.281488, abs=1e-6)
    assert row.p_value == pytest.approx(1.14e-83, rel=0.01)


def test_chi_square_degenerate_tables(spark):
    schema = "session_group string, cart_yes bigint, cart_no bigint"
    empty_row = spark.createDataFrame([("1", 3, 7), ("2-3", 5, 5), ("21+", 0, 0)], schema)
    assert experiment.chi_square(empty_row).first().dof == 1
    no_carts = spark.createDataFrame([("1", 0, 7), ("2-3", 0, 5)], schema)
    assert experiment.chi_square(no_carts).first().chi2 is None
    one_row = spark.createDataFrame([("1", 3, 7)], schema)
    assert tuple(experiment.chi_square(one_row).first()) == (None, 0, None, None)


def test_sample_sizes(spark):
    baseline = spark.createDataFrame(
        [(4.08, 1.73)], "view_to_cart_rate double, view_to_purchase_rate double"
    )
    sizes = {
        r.uplift_pct: (r.n_per_group, r.total_n)
        for r in experiment.sample_size_by_uplift(baseline).collect()
    }
    assert sizes == {5: (150978, 301956), 10: (38624, 77248), 15: (17556, 35112)}
    fixed = experiment.sample_size_fixed(baseline).first()
    assert (fixed.p1, fixed.p2, fixed.n_per_group) == (0.0408, 0.0449, 38256)
    targets = {r.uplift_pct: r for r in experiment.uplift_targets(baseline).collect()}
    assert targets[10].cart_target == pytest.approx(4.488)
    assert targets[15].purchase_target == pytest.approx(1.9895)


STATS = {
    "n": "count", "low": "min", "high": "max", "mean": "avg",
    "q01": 0.01, "q25": 0.25, "mid": 0.5, "q99": 0.99, "top": 1.0,
    "negative": lambda v: v < 0,
}


def samples():
    rng = random.Random(3)
    return {
        "mixed": [rng.uniform(-1000, 1000) for _ in range(3000)],
        "one value holds a third": [5.0] * 1000 + [rng.expovariate(0.01) for _ in range(2000)],
        "narrow": [100 + rng.random() / 1e6 for _ in range(1500)],
        "whole numbers": [float(rng.randrange(1, 50)) for _ in range(2001)],
        "single": [3.25],
        "zeros": [0.0, -0.0, 0.0, 1e-300, -1e300, 1e300],
    }


def check(row, values):
    assert (row.n, row.low, row.high) == (len(values), min(values), max(values))
    assert row["mean"] == pytest.approx(np.mean(values), rel=1e-9)
    assert row.negative == sum(v < 0 for v in values)
    for name in ("q01", "q25", "mid", "q99", "top"):
        expected = float(np.quantile(np.array(values), STATS[name]))
        assert row[name] == pytest.approx(expected, rel=1e-12)


def test_quantiles_by_group(spark):
    data = samples()
    rows = [(name, v) for name, values in data.items() for v in values] + [("mixed", None)]
    frame = spark.createDataFrame(rows, "name string, v double")
    result = {r.name: r for r in distribution(frame, "v", STATS, by=["name"]).collect()}
    assert set(result) == set(data)
    for name, values in data.items():
        check(result[name], values)


@pytest.mark.parametrize("name", sorted(samples()))
def test_quantiles_of_whole_frame(spark, name):
    values = samples()[name]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    check(distribution(frame, "v", STATS).first(), values)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    values=st.lists(
        st.one_of(st.floats(-1e9, 1e9), st.sampled_from([0.0, 1.0, 58.95])), min_size=1, max_size=60
    ),
    fractions=st.lists(st.floats(0, 1), min_size=3, max_size=3),
)
def test_any_quantiles_of_any_values(spark, values, fractions):
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    wanted = {f"q{i}": q for i, q in enumerate(fractions)}
    row = distribution(frame, "v", wanted).first()
    ordered = sorted(values)
    for name, q in wanted.items():
        position = q * (len(values) - 1)
        low, high = ordered[math.floor(position)], ordered[math.ceil(position)]
        expected = low + (high - low) * (position - math.floor(position))
        assert row[name] == pytest.approx(expected, rel=1e-12, abs=1e-300)


@pytest.mark.parametrize("name", ["whole numbers", "single", "one value holds a third"])
def test_quantiles_of_few_values(spark, name):
    values = samples()[name]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    check(distribution(frame, "v", STATS, few_values=True).first(), values)
    grouped = frame.withColumn("g", F.lit("x"))
    check(distribution(grouped, "v", STATS, by=["g"], few_values=True).first(), values)


def test_moments_only(spark):
    frame = spark.createDataFrame([(1.0,), (2.0,), (None,)], "v double")
    row = distribution(frame, "v", {"n": "count", "mean": "avg"}).first()
    assert tuple(row) == (2, 1.5)
