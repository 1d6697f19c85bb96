"""The whole analysis of a CSV log: ingest, mart, and every report on it.

    spark-submit --py-files ... stagepath/plans/report.py \
        --logs oct.csv.gz nov.csv.gz dec.csv.gz --month dec.csv.gz --tables /shared/tables
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagepath.operators import conversion, cube, depth, experiment, profile, segments, stages
from stagepath.plans import mart as mart_plan
from stagepath.sources.event_log import Logs, ingest_events, labelled
from stagepath.staging import Staging

# The categories that are analysed on their own.
CATEGORIES = ("construction.tools.light", "sport.bicycle")


def log_reports(log: DataFrame) -> dict[str, DataFrame]:
    """Profiles of ingested logs, one row per log."""
    return {
        "Events per file": profile.log_profile(log, "source_file"),
        "Event types per file": profile.event_type_share(log, "source_file"),
    }


def event_reports(ev: DataFrame) -> dict[str, DataFrame]:
    """Quality of the events of one month."""
    return {
        "Rows": profile.row_count(ev),
        "Column quality": profile.column_quality(ev),
        "Event types": profile.event_type_counts(ev),
        "Missing values and prices": profile.null_price_profile(ev),
        "Quality checks": profile.quality_long(ev),
        "Events without a session": profile.null_session_by_type(ev),
        "Products per session": profile.session_breadth(ev),
        "Products per session, short": profile.session_breadth_summary(ev),
        "Order of the stages": profile.stage_order_check(ev),
        "Products that change price": profile.price_change_products(ev),
    }


def mart_reports(
    em: DataFrame,
    sessions: DataFrame,
    counts: DataFrame,
    ev: DataFrame,
    steps: dict[str, dict[str, int]],
    categories: Sequence[str] = CATEGORIES,
    baseline: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Everything that is read off the enriched mart, its sessions and its cube of `counts`. `steps`
    are the counts after each stage; planning starts from `baseline`, or from the measured one."""
    mart = em.select(stages.mart_columns())
    measured = depth.multi_view_baseline(sessions)
    baseline = measured if baseline is None else baseline
    crosstab = cube.depth_cart_crosstab(counts)
    known = counts.where("known_product")
    reports = {
        "Mart columns": conversion.mart_schema(mart),
        "Mart sample": conversion.mart_sample(mart),
        "Rows after each step": conversion.stage_row_checks(steps, em),
        "Events at the first view": conversion.first_view_events(em, ev),
        "Funnel": conversion.funnel_totals(em),
        "Known first-view attributes": cube.first_view_coverage(counts),
        "First-view prices": segments.price_distribution(em),
        "Price bands": cube.price_band_counts(counts),
        "Conversion by price band": cube.price_band_conversion(known),
        "Conversion of the top categories": cube.top_conversion(counts, "category_code"),
        "Conversion of the top brands": cube.top_conversion(counts, "brand"),
        "Price bands of the top categories": cube.category_price_mix(counts),
    }
    for category in categories:
        reports[f"{category} by price band"] = cube.category_price_conversion(counts, category)
    reports |= {
        "Products viewed per session": depth.session_depth_distribution(sessions),
        "Conversion by depth": depth.depth_band_conversion(sessions),
        f"{categories[0]} by depth": cube.category_depth_conversion(counts, categories[0]),
        "Pairs with a cart by depth": crosstab,
        "Independence of depth and cart": experiment.chi_square(crosstab),
        "Sessions with a cart by depth": depth.session_depth_any_cart(sessions),
        "Cart rate per session by depth": depth.depth_cart_rate(sessions),
        "Purchase rate per session by depth": depth.depth_purchase_rate(sessions),
        "Top categories by price band": cube.top_category_price_conversion(counts),
        "Baseline of comparing sessions": measured,
        "Targets": experiment.uplift_targets(baseline),
        "Sample size of the fixed target": experiment.sample_size_fixed(baseline),
        "Sample size by uplift": experiment.sample_size_by_uplift(baseline),
    }
    return reports


def given_baseline(spark: SparkSession, cart: float, purchase: float) -> DataFrame:
    """A baseline in percent that was not measured here."""
    return spark.createDataFrame(
        [(cart, purchase)], "view_to_cart_rate double, view_to_purchase_rate double"
    )


def run(
    spark: SparkSession,
    logs: Logs,
    month: str,
    tables: str,
    baseline: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Ingests the logs once, stores the mart of the one called `month`, and returns all
    reports by title.

    `month` is the label or the path of one of the logs. All reports read stored
    tables under `tables`; what the build of the mart leaves is removed.
    """
    known = labelled(logs)
    label = next((name for name, paths in known.items() if month in (name, *paths)), None)
    if label is None:
        raise ValueError(f"{month} is none of the logs {sorted(known)}")
    log = ingest_events(spark, logs, f"{tables}/events", by_source=True)
    ev = log.where(F.col("source_file") == label).drop("source_file")
    with Staging(spark) as staging:
        em = mart_plan.write_mart(
            mart_plan.build_enriched_mart(ev, staging), f"{tables}/funnel_session_product"
        )
        steps = mart_plan.step_counts(staging)
    sessions = mart_plan.write_mart(depth.sessions(em), f"{tables}/sessions")
    counts = mart_plan.write_mart(cube.segment_cube(em, sessions), f"{tables}/segments")
    return (
        log_reports(log)
        | event_reports(ev)
        | mart_reports(em, sessions, counts, ev, steps, baseline=baseline)
    )


def print_rows(frame: DataFrame) -> None:
    """Prints every row, one partition at a time."""
    print(" | ".join(frame.columns))
    for row in frame.toLocalIterator():
        print(" | ".join("NULL" if value is None else str(value) for value in row))


def main() -> None:
    options = argparse.ArgumentParser(description=__doc__)
    options.add_argument("--logs", nargs="+", required=True, help="CSV logs to profile")
    options.add_argument("--month", required=True, help="the one of the logs to analyse")
    options.add_argument("--tables", required=True, help="folder for the events and the mart")
    options.add_argument(
        "--baseline", nargs=2, type=float, metavar=("CART", "PURCHASE"),
        help="rates in percent to plan from, instead of the measured ones",
    )
    given = options.parse_args()
    spark = SparkSession.builder.appName("stagepath").getOrCreate()
    baseline = given_baseline(spark, *given.baseline) if given.baseline else None
    for title, frame in run(spark, given.logs, given.month, given.tables, baseline).items():
        print(f"\n{title}")
        print_rows(frame)


if __name__ == "__main__":
    main()
