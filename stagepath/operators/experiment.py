"""Association tests and the planning of an A/B test."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagepath.functions.numeric import chi_square_tail, normal_quantile, round_at

# 5 % two-sided significance and 80 % power.
Z_ALPHA = 1.96
Z_BETA = 0.84

# Relative improvements to plan for, in percent.
UPLIFTS = (5, 10, 15)


def chi_square(crosstab: DataFrame, yes: str = "cart_yes", no: str = "cart_no") -> DataFrame:
    """Chi-square test of independence and Cramér's V of a two-column crosstab.

    The crosstab has one row per group, so it is small whatever it was counted
    from. Rows without observations are left out, and the statistics are NULL
    where a column has none or a single row is left.
    """
    cells = crosstab.where(F.col(yes) + F.col(no) > 0).select(
        F.col(yes).cast("double").alias("yes"), F.col(no).cast("double").alias("no")
    )
    # For two columns the sum over all cells comes down to the squares of one of them.
    all_yes, all_no = F.sum("yes"), F.sum("no")
    n = all_yes + all_no
    apart = F.sum(F.col("yes") * F.col("yes") / (F.col("yes") + F.col("no"))) - all_yes * all_yes / n
    chi2 = F.try_divide(F.greatest(apart, F.lit(0.0)) * n * n, all_yes * all_no)
    dof = F.count("*") - 1
    statistic = cells.agg(F.when(dof > 0, chi2).alias("chi2"), dof.alias("dof"), n.alias("n"))
    return statistic.select(
        "chi2",
        "dof",
        chi_square_tail(F.col("chi2"), F.col("dof")).alias("p_value"),
        # Two columns, so min(rows - 1, columns - 1) is 1.
        F.sqrt(F.try_divide(F.col("chi2"), F.col("n"))).alias("cramers_v"),
    )


def _scenarios(baseline: DataFrame, uplifts: Sequence[int]) -> DataFrame:
    """The one-row baseline once per uplift."""
    return baseline.select(
        "*", F.explode(F.array(*(F.lit(u) for u in uplifts))).alias("uplift_pct")
    )


def _raised(rate: Column) -> Column:
    return rate * (F.col("uplift_pct") / 100.0 + 1.0)


def uplift_targets(baseline: DataFrame, uplifts: Sequence[int] = UPLIFTS) -> DataFrame:
    """Target rates for every relative uplift over the baseline rates."""
    cart, purchase = F.col("view_to_cart_rate"), F.col("view_to_purchase_rate")
    return _scenarios(baseline, uplifts).select(
        "uplift_pct",
        cart.alias("baseline_cart"),
        _raised(cart).alias("cart_target"),
        purchase.alias("baseline_purchase"),
        _raised(purchase).alias("purchase_target"),
    )


def sample_size(
    scenarios: DataFrame,
    z_alpha: float | Column = Z_ALPHA,
    z_beta: float | Column = Z_BETA,
    level: float | Column | None = None,
    power: float | Column | None = None,
) -> DataFrame:
    """Adds the size needed per group to tell the proportions p1 and p2 apart.

    `level` (two-sided) and `power`, numbers or columns of the scenarios, replace the two fixed values.
    """
    if level is not None:
        z_alpha = normal_quantile(1.0 - F.lit(level) / 2.0)
    if power is not None:
        z_beta = normal_quantile(F.lit(power))
    p1, p2 = F.col("p1"), F.col("p2")
    mean = (p1 + p2) / 2.0
    noise = z_alpha * F.sqrt(2.0 * mean * (1.0 - mean)) + z_beta * F.sqrt(
        p1 * (1.0 - p1) + p2 * (1.0 - p2)
    )
    size = F.try_divide(noise * noise, (p2 - p1) * (p2 - p1))
    return scenarios.withColumn("n_per_group", F.ceil(size)).withColumn(
        "total_n", F.col("n_per_group") * 2
    )


def sample_size_by_uplift(baseline: DataFrame, uplifts: Sequence[int] = UPLIFTS) -> DataFrame:
    """Sample size for every relative uplift of the baseline cart rate."""
    p1 = F.col("view_to_cart_rate") / 100.0
    return sample_size(
        _scenarios(baseline, uplifts).select(
            "uplift_pct", p1.alias("p1"), _raised(p1).alias("p2")
        )
    )


def sample_size_fixed(baseline: DataFrame, uplift: int = 10) -> DataFrame:
    """Sample size for a baseline and a target stated in hundredths of a percent."""
    p1 = round_at(F.col("view_to_cart_rate") / 100.0, 4)
    scenario = _scenarios(baseline, [uplift]).select(
        p1.alias("p1"), round_at(_raised(p1), 4).alias("p2")
    )
    return sample_size(scenario)
