"""Profiles and quality checks of an event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagepath.functions.distribution import distribution
from stagepath.functions.numeric import percent, round_at
from stagepath.model import FUNNEL, Funnel
from stagepath.operators.stages import TIME, in_session

# Labels of the quality checks, in report order, and the rows
# each one counts.
QUALITY_CHECKS = {
    "category_code 결측": "category_code IS NULL",
    "brand 결측": "brand IS NULL",
    "price 결측": "price IS NULL",
    "price = 0": "price = 0",
    "price < 0": "price < 0",
}


def _nulls(column: str) -> Column:
    return F.count_if(F.col(column).isNull())


def row_count(ev: DataFrame) -> DataFrame:
    return ev.agg(F.count("*").alias("total_rows"))


def log_profile(ev: DataFrame, period: str) -> DataFrame:
    """Events, users, sessions and time range per period.

    Spark reduces both distinct counts in one scan: each task sends every user
    and every session of a period once.
    """
    return ev.groupBy(period).agg(
        F.count("*").alias("total_events"),
        F.count_distinct("user_id").alias("users"),
        F.count_distinct("user_session").alias("sessions"),
        F.min(TIME).alias("min_time"),
        F.max(TIME).alias("max_time"),
    )


#: Sketches of 2^12 registers: the estimate is within 3.3 % of the exact number in 95 of 100 cases.
SKETCH_BITS = 12
SKETCHED = {"users": "user_id", "sessions": "user_session"}


def distinct_sketches(ev: DataFrame, *by: str) -> DataFrame:
    """Events of each log or period, and sketches of its users and sessions of a few kilobytes each.

    Stored per log, they stand in for it when distinct counts over several logs are wanted.
    """
    return ev.groupBy(*by).agg(
        F.count("*").alias("total_events"),
        *(F.hll_sketch_agg(F.col(c).cast("string"), SKETCH_BITS).alias(name) for name, c in SKETCHED.items()),
    )


def approximate_profile(sketches: DataFrame, *by: str) -> DataFrame:
    """Events, users and sessions of the logs that `sketches` holds, added up per `by`.

    Users and sessions are estimates; `log_profile` counts them exactly. A user of several logs counts once.
    """
    return sketches.groupBy(*by).agg(
        F.coalesce(F.sum("total_events"), F.lit(0)).alias("total_events"),
        *(F.hll_sketch_estimate(F.hll_union_agg(name)).alias(name) for name in SKETCHED),
    )


def event_type_counts(ev: DataFrame, *by: str) -> DataFrame:
    counts = ev.groupBy(*by, "event_type").agg(F.count("*").alias("event_count"))
    return counts.orderBy(*by, F.desc("event_count"), "event_type")


def event_type_share(ev: DataFrame, period: str) -> DataFrame:
    """Events of each type per period and their share of the period."""
    counts = ev.groupBy(period, "event_type").agg(F.count("*").alias("event_count"))
    # One row per type and period is left, so the window is small.
    total = F.sum("event_count").over(Window.partitionBy(period))
    return counts.withColumn(
        "event_pct", round_at(percent(F.col("event_count"), total), 2)
    ).orderBy(period, F.desc("event_count"), "event_type")


def column_quality(ev: DataFrame) -> DataFrame:
    """Products, missing values and price range in one row."""
    return ev.agg(
        F.count_distinct("product_id").alias("products"),
        _nulls("user_id").alias("null_user_id"),
        _nulls("user_session").alias("null_session"),
        _nulls("category_code").alias("null_category_code"),
        _nulls("brand").alias("null_brand"),
        _nulls("price").alias("null_price"),
        F.count_if(F.col("price") <= 0).alias("non_positive_price"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        round_at(F.avg("price"), 2).alias("avg_price"),
    )


def null_price_profile(ev: DataFrame) -> DataFrame:
    """Missing category, brand and price, and zero or negative prices."""
    rows = F.count("*")
    return ev.agg(
        rows.alias("total_rows"),
        _nulls("category_code").alias("null_category"),
        round_at(percent(_nulls("category_code"), rows), 2).alias("null_category_pct"),
        _nulls("brand").alias("null_brand"),
        round_at(percent(_nulls("brand"), rows), 2).alias("null_brand_pct"),
        _nulls("price").alias("null_price"),
        F.count_if(F.col("price") == 0).alias("zero_price"),
        F.count_if(F.col("price") < 0).alias("negative_price"),
    )


def quality_long(ev: DataFrame) -> DataFrame:
    """The quality checks as (item, count) rows, from a single scan."""
    checks = [
        F.count_if(F.expr(condition)).alias(item) for item, condition in QUALITY_CHECKS.items()
    ]
    columns = [F.col(f"`{item}`") for item in QUALITY_CHECKS]
    return ev.agg(*checks).unpivot([], columns, "item", "count")


def null_session_by_type(ev: DataFrame) -> DataFrame:
    """Events without a session, by type."""
    return (
        ev.where(~in_session())
        .groupBy("event_type")
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "event_type")
    )


def session_products(ev: DataFrame) -> DataFrame:
    """Distinct products per session, over events of all types."""
    return (
        ev.where(in_session())
        .groupBy("user_session")
        .agg(F.count_distinct("product_id").alias("product_count"))
    )


def session_breadth(ev: DataFrame) -> DataFrame:
    """How many products sessions touch, and how many touch more than one."""
    spread = distribution(
        session_products(ev),
        "product_count",
        {
            "total_sessions": "count",
            "avg_products_per_session": "avg",
            "median_products_per_session": 0.5,
            "max_products_per_session": "max",
            "single_product_sessions": lambda n: n == 1,
            "multi_product_sessions": lambda n: n > 1,
        },
        few_values=True,
    )
    return spread.withColumns(
        {
            "avg_products_per_session": round_at(F.col("avg_products_per_session"), 2),
            "max_products_per_session": F.col("max_products_per_session").cast("long"),
            "multi_product_pct": round_at(
                percent(F.col("multi_product_sessions"), F.col("total_sessions")), 2
            ),
        }
    )


def session_breadth_summary(ev: DataFrame) -> DataFrame:
    spread = distribution(
        session_products(ev),
        "product_count",
        {"avg_products": "avg", "median_products": 0.5, "max_products": "max"},
        few_values=True,
    )
    return spread.withColumns(
        {
            "avg_products": round_at(F.col("avg_products"), 2),
            "max_products": F.col("max_products").cast("long"),
        }
    )


def stage_order_check(ev: DataFrame, funnel: Funnel = FUNNEL) -> DataFrame:
    """Pairs whose first events of neighbouring stages are in order or reversed.

    First events are taken as they come, whatever happened before them. Equal
    times count as ordered, and a NULL product counts as a product.
    """
    first = {s: F.min(F.when(F.col("event_type") == s, F.col(TIME))) for s in funnel.stages}
    firsts = (
        ev.where(in_session() & F.col("event_type").isin(*funnel.stages))
        .groupBy(*funnel.keys)
        .agg(*(time.alias(stage) for stage, time in first.items()))
    )
    checks = []
    for before, after in zip(funnel.stages, funnel.later):
        checks += [
            F.count_if(F.col(before) <= F.col(after)).alias(f"{before}_to_{after}_ordered"),
            F.count_if(F.col(before) > F.col(after)).alias(f"{before}_{after}_reversed"),
        ]
    return firsts.agg(*checks)


def price_change_products(ev: DataFrame) -> DataFrame:
    """Viewed products, and those seen at more than one price.

    A product has several prices exactly when its lowest and highest differ, so
    no distinct count is needed.
    """
    products = (
        ev.where(F.col("event_type") == "view")
        .groupBy("product_id")
        .agg(F.min("price").alias("low"), F.max("price").alias("high"))
    )
    return products.agg(
        F.count("*").alias("total_products"),
        F.sum(F.when(F.col("low") < F.col("high"), 1).otherwise(0)).alias(
            "changed_price_products"
        ),
    ).withColumn(
        "changed_price_pct", percent(F.col("changed_price_products"), F.col("total_products"))
    )
