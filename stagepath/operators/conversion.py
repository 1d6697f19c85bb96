"""Counts, conversion rates and checks over the mart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagepath.functions.numeric import percent
from stagepath.operators.stages import mart_columns

COUNTS = ("view_count", "cart_count", "purchase_count")


def has_product() -> Column:
    """Pairs that a join on the pair would keep."""
    return F.col("product_id").isNotNull()


def with_rates(counts: DataFrame) -> DataFrame:
    """Adds the three conversion rates in percent, NULL where nothing can convert."""
    view, cart, purchase = (F.col(c) for c in COUNTS)
    return counts.withColumns(
        {
            "view_to_cart_rate": percent(cart, view),
            "cart_to_purchase_rate": percent(purchase, cart),
            "view_to_purchase_rate": percent(purchase, view),
        }
    )


def pair_counts() -> list[Column]:
    return [
        F.count("*").alias("view_count"),
        F.sum("cart_flag").alias("cart_count"),
        F.sum("purchase_flag").alias("purchase_count"),
    ]


def conversion_by(mart: DataFrame, *keys: str | Column) -> DataFrame:
    """Counts and conversion rates per group."""
    return with_rates(mart.groupBy(*keys).agg(*pair_counts()))


def top_conversion(mart: DataFrame, key: str, top: int = 15) -> DataFrame:
    """The `top` most viewed known values of `key` with their conversion."""
    known = mart.where(F.col(key).isNotNull() & has_product())
    return conversion_by(known, key).orderBy(F.desc("view_count"), key).limit(top)


def funnel_counts(mart: DataFrame) -> DataFrame:
    """The funnel in one row, counted from the stage times."""
    return with_rates(
        mart.agg(
            F.count("*").alias("view_count"),
            F.count("first_valid_cart").alias("cart_count"),
            F.count("first_valid_purchase").alias("purchase_count"),
        )
    )


def funnel_totals(mart: DataFrame) -> DataFrame:
    """The funnel in one row with conversion, drop-off and lost counts."""
    view, cart, purchase = (F.col(c) for c in COUNTS)
    return with_rates(mart.agg(*pair_counts())).withColumns(
        {
            "view_to_cart_drop": 100.0 - F.col("view_to_cart_rate"),
            "cart_to_purchase_drop": 100.0 - F.col("cart_to_purchase_rate"),
            "view_no_cart": view - cart,
            "cart_no_purchase": cart - purchase,
        }
    )


def stage_row_checks(steps: dict[str, dict[str, int]], mart: DataFrame) -> DataFrame:
    """Rows and conversions after each step of the build, as measured when the step was written,
    and those of the mart as it is stored. The conversions of a mart without rows are NULL.

    A step that loses or doubles pairs has another total than the step before.
    """
    measured = mart.sparkSession.createDataFrame(
        [(stage, n["total"], n.get("cart"), n.get("purchase")) for stage, n in steps.items()],
        "stage string, total long, cart_count long, purchase_count long",
    )
    stored = mart.agg(
        F.count("*").alias("total"),
        F.sum("cart_flag").alias("cart_count"),
        F.sum("purchase_flag").alias("purchase_count"),
    )
    return measured.unionByName(stored.select(F.lit("mart").alias("stage"), "*"))


def mart_schema(mart: DataFrame) -> DataFrame:
    """Column names and types of the mart."""
    described = mart.sparkSession.sql("DESCRIBE QUERY SELECT * FROM {mart}", mart=mart)
    return described.select(
        F.col("col_name").alias("column_name"), F.col("data_type").alias("column_type")
    )


def mart_sample(mart: DataFrame, n: int = 5) -> DataFrame:
    """The first `n` pairs in key order."""
    return mart.orderBy(*mart_columns()).limit(n)


def first_view_events(mart: DataFrame, ev: DataFrame, n: int = 5) -> DataFrame:
    """Views at the very time of a pair's first view, the first `n` in order.

    Every pair with a product has at least one such view, so the first `n` rows
    come from the first `n` pairs. Their sessions and times, `n` of each, are known before the log is
    read, so files, row groups and days (of a log laid out by day) that hold none of them are passed over.
    """
    keys = ["user_session", "product_id", "first_view"]
    pairs = mart.where(has_product() & F.col("first_view").isNotNull())
    heads = pairs.select(*keys).orderBy(*keys).limit(n).collect()
    carried = ["price", "category_id", "category_code", "brand"]
    views = ev.where(F.col("event_type") == "view")
    if heads:
        times = [row.first_view for row in heads]
        views = views.where(F.col("event_time").between(min(times), max(times)))
        views = views.where(F.col("user_session").isin(sorted({row.user_session for row in heads})))
        if "event_date" in ev.columns:
            days = sorted({time.date() for time in times})
            views = views.where(F.col("event_date").isin(days))
    views = views.select(*keys[:2], F.col("event_time").alias("first_view"), *carried)
    wanted = mart.sparkSession.createDataFrame(heads, pairs.select(*keys).schema)
    found = views.join(wanted, keys).select(*keys, *carried)
    return found.orderBy(*keys, *carried).limit(n)
