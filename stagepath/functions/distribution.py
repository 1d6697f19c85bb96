"""Exact distribution statistics without bringing all values to one task."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Stat = float | str | Callable[[Column], Column]

# Between a number and its double lie 2^52 others. They are split into 2^10
# buckets, and a bucket into 2^18 slices, so a slice holds at most 2^24 different
# values. There are about 2,100 doublings on either side of zero, which bounds
# the number of buckets.
_BUCKETS_PER_DOUBLING = 2**10
_SLICE_BITS = 18
_SLICES_PER_BUCKET = 2**_SLICE_BITS
_RANGE_BITS = 10
_SLICES_PER_DOUBLING = _BUCKETS_PER_DOUBLING * _SLICES_PER_BUCKET
_SMALLEST = 1_100 * _SLICES_PER_DOUBLING
_BEYOND = 10 * _SMALLEST


def _slice(value: Column) -> Column:
    """A whole number that never falls as `value` rises."""
    infinite = float("inf")
    size = F.floor(F.log2(F.abs(value)) * _SLICES_PER_DOUBLING) + _SMALLEST
    position = (
        F.when(F.isnan(value) | (value == infinite), _BEYOND)
        .when(value == -infinite, -_BEYOND)
        .when(value > 0, size)
        .when(value < 0, -size)
        .otherwise(0)
    )
    # Never NULL, and declared so: a join on it then adds no filter below the
    # value counts, which keeps their shuffle shared by all uses.
    return F.coalesce(position, F.lit(0)).cast("long")


def distribution(
    frame: DataFrame,
    value: str,
    stats: dict[str, Stat],
    by: Sequence[str] = (),
    few_values: bool = False,
) -> DataFrame:
    """One row per `by` group with the requested statistics of `value`.

    A stat is "count", "min", "max" or "avg", a fraction (exact quantile,
    interpolated between neighbours), or a predicate on the value (how many
    rows meet it). NULL values are left out.

    Equal values are counted first, and the counts are added up in buckets. Only
    the buckets that hold a wanted rank are sliced, and only the slices that
    hold one are ordered value by value.

    `few_values` says that one task can order all different values, as it can
    with the sizes of groups: k different sizes take at least k^2 / 2 rows, so
    even 10^12 rows have fewer than 1.5 million.
    """
    by = list(by)
    v, n = F.col("_value"), F.col("_n")
    counts = (
        frame.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias("_value"))
        .agg(F.count("*").alias("_n"))
        .withColumn("_slice", _slice(v))
        # Never NULL either, as a division would be.
        .withColumn("_bucket", F.shiftright("_slice", _SLICE_BITS))
    )
    moments = {
        "count": (F.sum(n), F.sum),
        "min": (F.min(v), F.min),
        "max": (F.max(v), F.max),
        "avg": (F.sum(v * n), F.sum),
    }
    totals = {"_count": moments["count"]}
    for name, stat in stats.items():
        if callable(stat):
            totals[name] = (F.sum(F.when(stat(v), n).otherwise(0)), F.sum)
        elif isinstance(stat, str):
            totals[name] = moments[stat]

    whole = Window.partitionBy(*by)
    bucket = "_value" if few_values else "_bucket"
    merges = {name: merge for name, (_, merge) in totals.items()}
    buckets = counts.groupBy(*by, bucket).agg(
        F.sum(n).alias("_n"), *(part.alias(name) for name, (part, _) in totals.items())
    )
    if few_values or by:
        buckets = buckets.withColumn("_before", _before(by, bucket)).withColumns(
            {name: merge(name).over(whole) for name, merge in merges.items()}
        )
    else:
        buckets = _ordered_in_ranges(buckets, merges)
    quantiles = {name: stat for name, stat in stats.items() if isinstance(stat, float)}
    if quantiles and not few_values:
        rows = _rows_in(counts, buckets, [*by, "_bucket"], by, quantiles)
        slices = (
            rows.groupBy(*by, "_bucket", "_slice")
            .agg(F.sum(n).alias("_n"), *(F.max(c).alias(c) for c in ("_before", "_count")))
            .withColumn("_before", F.col("_before") + _before([*by, "_bucket"], "_slice"))
        )
        rows = _rows_in(rows.drop("_before"), slices, [*by, "_bucket", "_slice"], by, quantiles)
        rows = rows.withColumn("_before", F.col("_before") + _before([*by, "_slice"], "_value"))
    else:
        rows = buckets

    def result(name: str, stat: Stat) -> Column:
        if isinstance(stat, float):
            low, high = (F.max(F.when(_holds(rank), v)) for rank in _neighbours(stat))
            position = _position(stat)
            return low + (high - low) * F.max(position - F.floor(position))
        column = F.max(name)
        if stat == "avg":
            return F.try_divide(column, F.max("_count").cast("double"))
        return F.coalesce(column, F.lit(0)) if stat == "count" or callable(stat) else column

    return rows.groupBy(*by).agg(*(result(name, stat).alias(name) for name, stat in stats.items()))


def _ordered_in_ranges(buckets: DataFrame, merges: dict[str, Callable[[str], Column]]) -> DataFrame:
    """`_before` and the totals of the buckets of a single group, without one task for them all.

    Buckets are added up in ranges, of which there are a few thousand at most; those are put
    in order, and then the buckets within each range.
    """
    ranged = buckets.withColumn("_range", F.shiftright("_bucket", _RANGE_BITS))
    whole = Window.partitionBy()
    ranges = (
        ranged.groupBy("_range")
        .agg(F.sum("_n").alias("_n"), *(merge(name).alias(name) for name, merge in merges.items()))
        .withColumn("_range_before", _before([], "_range"))
        .withColumns({name: merge(name).over(whole) for name, merge in merges.items()})
        .drop("_n")
    )
    return (
        ranged.drop(*merges)
        .join(F.broadcast(ranges), "_range")
        .withColumn("_before", F.col("_range_before") + _before(["_range"], "_bucket"))
        .drop("_range", "_range_before")
    )


def _before(group: list[str], order: str) -> Column:
    """Observations in front of a row of its group."""
    upto = (
        Window.partitionBy(*group)
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return F.sum("_n").over(upto) - F.col("_n")


def _position(quantile: float) -> Column:
    return F.lit(quantile) * (F.col("_count") - 1)


def _neighbours(quantile: float) -> tuple[Column, Column]:
    """The ranks between which a quantile lies."""
    return F.floor(_position(quantile)), F.ceil(_position(quantile))


def _holds(rank: Column) -> Column:
    return (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n"))


def _rows_in(
    rows: DataFrame, parts: DataFrame, key: list[str], by: list[str], quantiles: dict[str, float]
) -> DataFrame:
    """The rows of those parts that hold a wanted rank, with what `parts` knows."""
    ranks = [rank for quantile in quantiles.values() for rank in _neighbours(quantile)]
    wanted = parts.where(functools.reduce(operator.or_, map(_holds, ranks)))
    known = wanted.drop("_n", *(c for c in rows.columns if c not in key))
    # At most two parts per quantile and group: a broadcast is bounded when there
    # is one group, and otherwise left to Spark to decide.
    return rows.join(known if by else F.broadcast(known), key)
