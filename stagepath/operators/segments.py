"""Price, category and brand segments at the first view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagepath.functions.bands import price_band, price_band_labels
from stagepath.functions.distribution import distribution
from stagepath.functions.numeric import percent
from stagepath.operators.conversion import has_product, pair_counts, with_rates


def first_view_coverage(em: DataFrame) -> DataFrame:
    """For each first-view attribute, how many pairs know it."""
    attributes = {"price": "view_price", "category": "category_code", "brand": "brand"}
    total = F.count("*").alias("total")
    counts = em.agg(total, *(F.count(c).alias(name) for name, c in attributes.items()))
    return counts.unpivot("total", list(attributes), "attribute", "available").withColumn(
        "missing", F.col("total") - F.col("available")
    )


def price_distribution(em: DataFrame) -> DataFrame:
    return distribution(
        em,
        "view_price",
        {
            "min_price": "min",
            "q1": 0.25,
            "median": 0.5,
            "q3": 0.75,
            "p90": 0.9,
            "p99": 0.99,
            "max_price": "max",
            "avg_price": "avg",
        },
    )


def price_band_conversion(em: DataFrame) -> DataFrame:
    """Counts and conversion rates per price band, in price order."""
    bands = em.groupBy(price_band(F.col("view_price")).alias("price_group")).agg(
        *pair_counts(), F.min("view_price").alias("_low")
    )
    return with_rates(bands.orderBy(F.asc_nulls_last("_low")).drop("_low"))


def price_band_counts(em: DataFrame) -> DataFrame:
    return price_band_conversion(em).select("price_group", "view_count")


def category_price_conversion(em: DataFrame, category: str) -> DataFrame:
    """Price bands within one category."""
    chosen = em.where((F.col("category_code") == category) & has_product())
    return price_band_conversion(chosen).drop("cart_count", "purchase_count")


def _top_category_bands(em: DataFrame, top: int, counted: Column) -> DataFrame:
    """One row per price band of the `top` most viewed known categories.

    Every category is one row that carries the counts of its few bands, so one
    aggregation both ranks the categories and fills the bands. The ranking sees
    all pairs; the bands see the pairs that `counted` keeps.
    """
    band = price_band(F.col("view_price"))
    labels = price_band_labels()
    counts = [F.count("*").alias("_views")]
    for i, label in enumerate(labels):
        here = counted & (band == label)
        counts += [
            F.count_if(here).alias(f"_views_{i}"),
            F.sum(F.when(here, F.col("cart_flag")).otherwise(0)).alias(f"_carts_{i}"),
        ]
    categories = (
        em.where(F.col("category_code").isNotNull())
        .groupBy("category_code")
        .agg(*counts)
        .orderBy(F.desc("_views"), "category_code")
        .limit(top)
    )
    bands = [
        F.struct(
            F.lit(i).alias("_rank"),
            F.lit(label).alias("price_group"),
            F.col(f"_views_{i}").alias("view_count"),
            F.col(f"_carts_{i}").alias("cart_count"),
        )
        for i, label in enumerate(labels)
    ]
    return categories.select("category_code", F.inline(F.array(*bands))).where("view_count > 0")


def category_price_mix(em: DataFrame, top: int = 10) -> DataFrame:
    """Price bands of the most viewed categories."""
    bands = _top_category_bands(em, top, has_product())
    return bands.select("category_code", "price_group", "view_count").orderBy(
        "category_code", F.desc("view_count"), "price_group"
    )


def top_category_price_conversion(em: DataFrame, top: int = 5) -> DataFrame:
    """View-to-cart rate by price band in the most viewed categories, for
    products with a price above zero."""
    bands = _top_category_bands(em, top, has_product() & (F.col("view_price") > 0))
    return (
        bands.withColumn("view_to_cart_rate", percent(F.col("cart_count"), F.col("view_count")))
        .orderBy("category_code", "_rank")
        .select("category_code", "price_group", "view_count", "view_to_cart_rate")
    )
