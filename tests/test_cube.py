"""Reports read from the cube are those read from the mart."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from stagepath.functions.numeric import normal_quantile
from stagepath.operators import conversion, cube, depth, experiment, segments
from stagepath.plans.mart import build_enriched_mart
from stagepath.staging import Staging
from tests.conftest import make_events


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    rows = [
        (
            rng.choice([*"abcdefgh", "hot", "hot", "hot", None]), rng.choice([None, *range(30)]),
            rng.choice(["view", "view", "view", "cart", "purchase"]), rng.randrange(50),
            rng.choice([None, -2.0, 0.0, 10.0, 58.95, 100.0, 200.0, 400.0]),
            rng.choice([None, "c1", "c2", "c3"]), rng.choice([None, "b1", "b2"]),
        )
        for _ in range(900)
    ]
    staging = Staging(spark)
    em = staging.save(build_enriched_mart(make_events(spark, rows), staging), "em")
    sessions = staging.save(depth.sessions(em), "sessions")
    return em, sessions, staging.save(cube.segment_cube(em, sessions), "cube")


REPORTS = {
    "coverage": (lambda em, s: segments.first_view_coverage(em), cube.first_view_coverage),
    "bands": (lambda em, s: segments.price_band_counts(em), cube.price_band_counts),
    "band conversion": (
        lambda em, s: segments.price_band_conversion(em.where(conversion.has_product())),
        lambda c: cube.price_band_conversion(c.where("known_product")),
    ),
    "categories": (
        lambda em, s: conversion.top_conversion(em, "category_code", 2),
        lambda c: cube.top_conversion(c, "category_code", 2),
    ),
    "brands": (lambda em, s: conversion.top_conversion(em, "brand"), lambda c: cube.top_conversion(c, "brand")),
    "mix": (lambda em, s: segments.category_price_mix(em, 2), lambda c: cube.category_price_mix(c, 2)),
    "category prices": (
        lambda em, s: segments.category_price_conversion(em, "c2"), lambda c: cube.category_price_conversion(c, "c2"),
    ),
    "category depth": (
        lambda em, s: depth.category_depth_conversion(em, "c1"), lambda c: cube.category_depth_conversion(c, "c1"),
    ),
    "crosstab": (lambda em, s: depth.depth_cart_crosstab(s), cube.depth_cart_crosstab),
    "top prices": (
        lambda em, s: segments.top_category_price_conversion(em, 2), lambda c: cube.top_category_price_conversion(c, 2),
    ),
    "totals": (lambda em, s: conversion.with_rates(em.agg(*conversion.pair_counts())), cube.totals),
}


@pytest.mark.parametrize("name", REPORTS)
def test_cube_gives_the_rows_of_the_mart(tables, name):
    em, sessions, counts = tables
    from_mart, from_cube = REPORTS[name]
    wanted, found = from_mart(em, sessions), from_cube(counts)
    assert found.columns == wanted.columns
    assert [tuple(r) for r in found.collect()] == [tuple(r) for r in wanted.collect()]


def test_cube_reads_the_mart_once_and_counts_all_pairs(tables):
    em, sessions, counts = tables
    assert counts.agg(F.sum("view_count")).first()[0] == em.count()
    assert counts.count() == counts.select(*cube.DIMENSIONS).distinct().count()
    plan = cube.segment_cube(em, sessions)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Scan") == 2  # the mart and its sessions, once each


def test_empty_mart(spark, staging):
    em = build_enriched_mart(make_events(spark, []), staging)
    counts = cube.segment_cube(em, depth.sessions(em))
    assert counts.collect() == [] and cube.price_band_conversion(counts).collect() == []
    assert cube.totals(counts).first().view_count == 0


def test_normal_quantile_matches_known_values(spark):
    normal = statistics.NormalDist()
    given = [1e-300, 1e-20, 1e-9, 0.001, 0.025, 0.075, 0.0750001, 0.2, 0.5, 0.8, 0.925, 0.975, 0.999, 1 - 1e-12]
    rows = spark.createDataFrame([(p,) for p in given], "p double").select("p", normal_quantile(F.col("p")).alias("z"))
    for r in rows.collect():
        assert r.z == pytest.approx(normal.inv_cdf(r.p), rel=1e-9, abs=1e-9)
    outside = spark.createDataFrame([(0.0,), (1.0,), (-1.0,), (None,)], "p double")
    assert {r.z for r in outside.select(normal_quantile(F.col("p")).alias("z")).collect()} == {None}


def test_sample_size_for_any_level_and_power(spark):
    scenarios = spark.createDataFrame(
        [(0.0408, 0.0449, 0.05, 0.8), (0.0408, 0.0449, 0.01, 0.9), (0.1, 0.1, 0.05, 0.8)],
        "p1 double, p2 double, level double, power double",
    )
    rows = experiment.sample_size(scenarios, level=F.col("level"), power=F.col("power")).collect()
    normal = statistics.NormalDist()
    for r in rows[:2]:
        mean = (r.p1 + r.p2) / 2
        noise = normal.inv_cdf(1 - r.level / 2) * (2 * mean * (1 - mean)) ** 0.5
        noise += normal.inv_cdf(r.power) * (r.p1 * (1 - r.p1) + r.p2 * (1 - r.p2)) ** 0.5
        assert r.n_per_group == -(-((noise / (r.p2 - r.p1)) ** 2) // 1)
    assert rows[0].n_per_group < rows[1].n_per_group and rows[2].n_per_group is None
    fixed = experiment.sample_size(scenarios).first()
    assert (fixed.n_per_group, fixed.total_n) == (38256, 76512)
