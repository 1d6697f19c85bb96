"""A small table of counts from which all segment reports are read.

The mart is gone through once. Each combination of price band, category, brand and depth band
becomes a row of counts, so a report adds up some rows of the cube instead of all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagepath.functions.bands import depth_band, depth_band_labels, price_band, price_band_labels
from stagepath.functions.numeric import percent
from stagepath.operators.conversion import COUNTS, has_product, pair_counts, with_rates

DIMENSIONS = ("price_group", "category_code", "brand", "session_group", "known_product", "above_zero")
RATES_ONLY = ("cart_count", "purchase_count")


def segment_cube(em: DataFrame, sessions: DataFrame) -> DataFrame:
    """Counts of the enriched mart by its segments. `sessions` gives the depth of every session.

    `known_product` tells pairs that a join on the pair keeps, `above_zero` those with a price
    above zero. `known_price` counts the pairs whose price is known, `lowest` is the least price.
    A task sends one row per combination, so a hot session, category or brand is reduced before it is shuffled.
    """
    depths = sessions.select("user_session", depth_band(F.col("viewed_products")).alias("session_group"))
    return (
        em.join(depths, "user_session")
        .groupBy(
            price_band(F.col("view_price")).alias("price_group"),
            "category_code",
            "brand",
            "session_group",
            has_product().alias("known_product"),
            F.coalesce(F.col("view_price") > 0, F.lit(False)).alias("above_zero"),
        )
        .agg(
            *pair_counts(),
            F.count("view_price").alias("known_price"),
            F.min("view_price").alias("lowest"),
        )
    )


def _sums() -> list[Column]:
    return [F.sum(name).alias(name) for name in COUNTS]


def _in_order(column: str, labels: list[str]) -> Column:
    return F.array_position(F.array(*map(F.lit, labels)), F.col(column))


def totals(cube: DataFrame) -> DataFrame:
    """The counts of all pairs with their conversion rates."""
    return with_rates(cube.agg(*(F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in COUNTS)))


def first_view_coverage(cube: DataFrame) -> DataFrame:
    """For each first-view attribute, how many pairs know it."""
    views = F.col("view_count")
    known = {
        "price": F.col("known_price"),
        "category": F.when(F.col("category_code").isNotNull(), views),
        "brand": F.when(F.col("brand").isNotNull(), views),
    }
    counts = cube.agg(
        F.coalesce(F.sum(views), F.lit(0)).alias("total"),
        *(F.coalesce(F.sum(n), F.lit(0)).alias(name) for name, n in known.items()),
    )
    return counts.unpivot("total", list(known), "attribute", "available").withColumn(
        "missing", F.col("total") - F.col("available")
    )


def price_band_conversion(cube: DataFrame) -> DataFrame:
    """Counts and conversion rates per price band, in price order."""
    bands = cube.groupBy("price_group").agg(*_sums(), F.min("lowest").alias("_low"))
    return with_rates(bands.orderBy(F.asc_nulls_last("_low")).drop("_low"))


def price_band_counts(cube: DataFrame) -> DataFrame:
    return price_band_conversion(cube).select("price_group", "view_count")


def top_conversion(cube: DataFrame, key: str, top: int = 15) -> DataFrame:
    """The `top` most viewed known values of `key` with their conversion."""
    known = cube.where(F.col(key).isNotNull() & F.col("known_product"))
    counts = with_rates(known.groupBy(key).agg(*_sums()))
    return counts.orderBy(F.desc("view_count"), key).limit(top)


def category_price_conversion(cube: DataFrame, category: str) -> DataFrame:
    """Price bands within one category."""
    chosen = cube.where((F.col("category_code") == category) & F.col("known_product"))
    return price_band_conversion(chosen).drop(*RATES_ONLY)


def category_depth_conversion(cube: DataFrame, category: str) -> DataFrame:
    """Depth bands counting only the pairs of one category."""
    chosen = cube.where((F.col("category_code") == category) & F.col("known_product"))
    counts = with_rates(chosen.groupBy("session_group").agg(*_sums()))
    return counts.orderBy(_in_order("session_group", depth_band_labels())).drop(*RATES_ONLY)


def depth_cart_crosstab(cube: DataFrame) -> DataFrame:
    """Pairs with and without a cart, by depth of their session."""
    bands = cube.groupBy("session_group").agg(
        F.sum("cart_count").alias("cart_yes"),
        F.sum(F.col("view_count") - F.col("cart_count")).alias("cart_no"),
    )
    return bands.orderBy(_in_order("session_group", depth_band_labels()))


def _top_category_bands(cube: DataFrame, top: int, counted: Column) -> DataFrame:
    """One row per price band of the `top` most viewed known categories. The ranking sees all
    pairs, the bands those that `counted` keeps."""
    by_band = (
        cube.where(F.col("category_code").isNotNull())
        .groupBy("category_code", "price_group")
        .agg(
            F.sum("view_count").alias("_views"),
            *(F.sum(F.when(counted, F.col(name)).otherwise(0)).alias(name) for name in COUNTS),
        )
    )
    ranked = by_band.groupBy("category_code").agg(F.sum("_views").alias("_views"))
    best = ranked.orderBy(F.desc("_views"), "category_code").limit(top).select("category_code")
    return by_band.drop("_views").join(best, "category_code").where("view_count > 0")


def category_price_mix(cube: DataFrame, top: int = 10) -> DataFrame:
    """Price bands of the most viewed categories."""
    bands = _top_category_bands(cube, top, F.col("known_product"))
    return bands.select("category_code", "price_group", "view_count").orderBy(
        "category_code", F.desc("view_count"), "price_group"
    )


def top_category_price_conversion(cube: DataFrame, top: int = 5) -> DataFrame:
    """View-to-cart rate by price band in the most viewed categories, for
    products with a price above zero."""
    bands = _top_category_bands(cube, top, F.col("known_product") & F.col("above_zero"))
    return (
        bands.withColumn("view_to_cart_rate", percent(F.col("cart_count"), F.col("view_count")))
        .orderBy("category_code", _in_order("price_group", price_band_labels()))
        .select("category_code", "price_group", "view_count", "view_to_cart_rate")
    )
