"""Session depth: how many products a session viewed, and what followed.

Every analysis starts from one row per session, as `sessions` gives it. The
depth of a session is the number of its mart rows, so pairs, carts and purchases
can be added up in the same aggregation, and nothing is joined back to the
pairs. Stored once, the sessions serve all analyses without another shuffle of
the mart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagepath.functions.bands import depth_band, depth_band_labels
from stagepath.functions.distribution import distribution
from stagepath.functions.numeric import percent, share
from stagepath.operators.conversion import COUNTS, has_product, with_rates

GROUP = "session_group"


def sessions(mart: DataFrame, counted: Column | None = None) -> DataFrame:
    """Depth of every session, and the counts over its `counted` pairs.

    The depth always covers all pairs of the session.
    """
    counted = F.lit(True) if counted is None else counted
    flags = {"cart_count": "cart_flag", "purchase_count": "purchase_flag"}
    return mart.groupBy("user_session").agg(
        F.count("*").alias("viewed_products"),
        F.count_if(counted).alias("view_count"),
        *(
            F.sum(F.when(counted, F.col(flag)).otherwise(0)).alias(name)
            for name, flag in flags.items()
        ),
    )


def _by_depth(per_session: DataFrame, *aggregates: Column) -> DataFrame:
    """Sessions grouped into depth bands, from shallow to deep."""
    return (
        per_session.groupBy(depth_band(F.col("viewed_products")).alias(GROUP))
        .agg(*aggregates, F.min("viewed_products").alias("_depth"))
        .orderBy("_depth")
        .drop("_depth")
    )


def _summed(*columns: str) -> list[Column]:
    return [F.sum(c).alias(c) for c in columns]


def session_depth_distribution(per_session: DataFrame) -> DataFrame:
    spread = distribution(
        per_session,
        "viewed_products",
        {
            "sessions": "count",
            "avg_products": "avg",
            "median_products": 0.5,
            "p75": 0.75,
            "p90": 0.9,
            "p95": 0.95,
            "p99": 0.99,
            "max_products": "max",
        },
        few_values=True,
    )
    return spread.withColumn("max_products", F.col("max_products").cast("long"))


def depth_band_conversion(per_session: DataFrame) -> DataFrame:
    bands = _by_depth(per_session, F.count("*").alias("session_count"), *_summed(*COUNTS))
    return with_rates(bands).drop("cart_count", "purchase_count")


def category_depth_conversion(em: DataFrame, category: str) -> DataFrame:
    """Depth bands counting only the pairs of one category."""
    counted = F.coalesce(F.col("category_code") == category, F.lit(False)) & has_product()
    chosen = sessions(em, counted).where("view_count > 0")
    return with_rates(_by_depth(chosen, *_summed(*COUNTS))).drop("cart_count", "purchase_count")


def depth_cart_crosstab(per_session: DataFrame) -> DataFrame:
    """Pairs with and without a cart, by depth of their session."""
    return _by_depth(
        per_session,
        F.sum("cart_count").alias("cart_yes"),
        F.sum(F.col("view_count") - F.col("cart_count")).alias("cart_no"),
    )


def session_depth_any_cart(per_session: DataFrame) -> DataFrame:
    """Sessions with and without any cart, by depth."""
    any_cart = F.col("cart_count") > 0
    bands = _by_depth(
        per_session, F.count_if(any_cart).alias("cart_yes"), F.count_if(~any_cart).alias("cart_no")
    )
    return bands.withColumn(
        "cart_rate", percent(F.col("cart_yes"), F.col("cart_yes") + F.col("cart_no"))
    )


def depth_cart_rate(per_session: DataFrame) -> DataFrame:
    """Mean and median over sessions of the share of viewed products carted."""
    rates = per_session.select(
        depth_band(F.col("viewed_products")).alias(GROUP),
        share(F.col("cart_count"), F.col("view_count")).alias("rate"),
    )
    spread = distribution(
        rates,
        "rate",
        {"session_count": "count", "avg_cart_rate": "avg", "median_cart_rate": 0.5},
        by=[GROUP],
    )
    order = F.array_position(F.array(*map(F.lit, depth_band_labels())), F.col(GROUP))
    return spread.orderBy(order).withColumns(
        {c: F.col(c) * 100.0 for c in ("avg_cart_rate", "median_cart_rate")}
    )


def depth_purchase_rate(per_session: DataFrame) -> DataFrame:
    """Mean over sessions of the share of viewed products bought."""
    return _by_depth(
        per_session,
        F.count("*").alias("session_count"),
        (F.avg(share(F.col("purchase_count"), F.col("view_count"))) * 100.0).alias(
            "avg_purchase_rate"
        ),
    )


def multi_view_baseline(per_session: DataFrame, min_depth: int = 2) -> DataFrame:
    """The funnel over sessions that viewed at least `min_depth` products."""
    deep = per_session.where(F.col("viewed_products") >= min_depth)
    views, *others = COUNTS
    return with_rates(
        deep.agg(F.coalesce(F.sum(views), F.lit(0)).alias(views), *_summed(*others))
    )
