"""Price and depth bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds of the price bands and the labels of all bands.
PRICE_BANDS = {"Q1_low": 58.95, "Q2": 153.47, "Q3": 334.13}
ZERO_PRICE = "0_price"
TOP_PRICE = "Q4_high"

# Upper bounds of the session-depth bands and their labels.
DEPTH_BANDS = {"1": 1, "2-3": 3, "4-6": 6, "7-20": 20}
TOP_DEPTH = "21+"


def price_band(
    price: Column, bands: dict[str, float] = PRICE_BANDS, null_band: str | None = None
) -> Column:
    """Band label of a price. An unknown price falls in the top band unless
    `null_band` names another one; a negative price falls in the lowest."""
    band = F.when(price == 0, ZERO_PRICE)
    for label, upper in bands.items():
        band = band.when(price <= upper, label)
    if null_band is not None:
        band = band.when(price.isNull(), null_band)
    return band.otherwise(TOP_PRICE)


def price_band_labels(bands: dict[str, float] = PRICE_BANDS) -> list[str]:
    return [ZERO_PRICE, *bands, TOP_PRICE]


def depth_band(depth: Column, bands: dict[str, int] = DEPTH_BANDS) -> Column:
    """Band label of the number of products viewed in a session."""
    band = None
    for label, upper in bands.items():
        band = (F if band is None else band).when(depth <= upper, label)
    return band.otherwise(TOP_DEPTH)


def depth_band_labels(bands: dict[str, int] = DEPTH_BANDS) -> list[str]:
    return [*bands, TOP_DEPTH]
