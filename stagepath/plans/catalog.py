"""The registered queries: every operator, run over the whole `events` table."""

from __future__ import annotations

import functools
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagepath.functions.numeric import round_at, significant
from stagepath.model import FUNNEL
from stagepath.operators import conversion, cube, depth, experiment, profile, segments, stages
from stagepath.plans import mart as mart_plan
from stagepath.plans.mart_store import MartStore
from stagepath.sources import event_log, event_table
from stagepath.sources.event_table import canonical_events, week
from stagepath.staging import Staging

Query = Callable[[SparkSession, str], DataFrame]

# Stand-ins for the two categories that are analysed on their own.
CATEGORY_A = "cat.3"
CATEGORY_B = "cat.7"

_stored: dict[tuple[str, str], _Stored] = {}
_stagings: list[Staging] = []
_building = threading.Lock()


def _staging(spark: SparkSession) -> Staging:
    """A staging folder that lasts until `clean`, as a query's result is read from it lazily."""
    _stagings.append(Staging(spark))
    return _stagings[-1]


def clean() -> None:
    """Removes everything that queries have written; their results cannot be read any more."""
    with _building:
        _stored.clear()
        while _stagings:
            _stagings.pop().remove()


class _Stored:
    """The tables that analyses of one `events` table share, written on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str, version: int):
        self.spark, self.sf_dir, self.version = spark, sf_dir, version
        self.staging = _staging(spark)

    @functools.cached_property
    def mart(self) -> DataFrame:
        ev = canonical_events(self.spark, self.sf_dir)
        return mart_plan.build_enriched_mart(ev, self.staging)

    @property
    def step_counts(self) -> dict[str, dict[str, int]]:
        return mart_plan.step_counts(self.staging)

    @functools.cached_property
    def sessions(self) -> DataFrame:
        return self.staging.save(depth.sessions(self.mart), "sessions")


def _tables(spark: SparkSession, sf_dir: str) -> _Stored:
    key = (spark.sparkContext.applicationId, sf_dir)
    version = event_table.version(spark, sf_dir)
    known = _stored.get(key)
    if known is None or known.version != version or known.spark is not spark:
        if known is not None and known.spark is spark:
            known.staging.remove()
        known = _stored[key] = _Stored(spark, sf_dir, version)
    return known


def stored_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The enriched mart of `sf_dir`, so that analyses need not go back to the
    log. It is built once per session, and again when the log has changed."""
    with _building:
        return _tables(spark, sf_dir).mart


def stored_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per session of the stored mart."""
    with _building:
        return _tables(spark, sf_dir).sessions


def _comparable(frame: DataFrame) -> DataFrame:
    """Doubles at six digits: sums of doubles depend on the order of addition. A p-value
    keeps six significant digits, however small it is."""
    return frame.withColumns(
        {
            name: significant(F.col(name), 6) if name == "p_value" else round_at(F.col(name), 6)
            for name, kind in frame.dtypes
            if kind == "double"
        }
    )


def _on_log(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: _comparable(operator(canonical_events(spark, sf_dir)))


def _on_mart(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: _comparable(operator(stored_mart(spark, sf_dir)))


def _on_sessions(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: _comparable(operator(stored_sessions(spark, sf_dir)))


def _on_baseline(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return _on_sessions(lambda sessions: operator(depth.multi_view_baseline(sessions)))


def _stages_upto(stage: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ev = canonical_events(spark, sf_dir)
        return mart_plan.ordered_stages(ev, _staging(spark), FUNNEL.upto(stage))

    return query


def _ingest_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the events as gzip CSV and ingests that log."""
    staging = _staging(spark)
    log = staging.path("log")
    event_log.write_log(canonical_events(spark, sf_dir), log)
    return profile.row_count(event_log.ingest_events(spark, log, staging.path("events")))


def _funnel_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mart_plan.build_mart(canonical_events(spark, sf_dir), _staging(spark))


def _funnel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = mart_plan.ordered_stages(canonical_events(spark, sf_dir), _staging(spark))
    return _comparable(conversion.funnel_counts(pairs))


def _stage_row_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each step as it was measured when the stored mart was built, and the mart as it is."""
    mart = stored_mart(spark, sf_dir)
    with _building:
        counts = _tables(spark, sf_dir).step_counts
    return conversion.stage_row_checks(counts, mart)


def _mart_by_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The enriched mart of the weeks' logs, added one after another, the last one first."""
    ev, staging = canonical_events(spark, sf_dir), _staging(spark)
    store = MartStore(spark, staging.path("mart"))
    late = F.coalesce(week() >= 3, F.lit(False))
    store.add(ev.where(late), "weeks from the fourth on")
    store.add(ev.where(~late), "weeks before")
    return _comparable(store.mart())


def _first_view_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = canonical_events(spark, sf_dir)
    return _comparable(conversion.first_view_events(stored_mart(spark, sf_dir), ev))


def _segment_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _comparable(cube.segment_cube(stored_mart(spark, sf_dir), stored_sessions(spark, sf_dir)))


def _by_week(operator: Callable[[DataFrame, str], DataFrame]) -> Query:
    return _on_log(lambda ev: operator(ev.withColumn("period", week()), "period"))


def queries() -> dict[str, Query]:
    return {
        # Sources and profiles
        "ingest_row_count": _ingest_row_count,
        "log_profile": _by_week(profile.log_profile),
        "event_type_share": _by_week(profile.event_type_share),
        "event_type_counts": _on_log(profile.event_type_counts),
        "column_quality": _on_log(profile.column_quality),
        "null_price_profile": _on_log(profile.null_price_profile),
        "quality_long": _on_log(profile.quality_long),
        "null_session_by_type": _on_log(profile.null_session_by_type),
        "session_breadth": _on_log(profile.session_breadth),
        "session_breadth_summary": _on_log(profile.session_breadth_summary),
        "stage_order_check": _on_log(profile.stage_order_check),
        "price_change_products": _on_log(profile.price_change_products),
        # Funnel construction
        "funnel_counts": _funnel_counts,
        "funnel_view": _on_log(lambda ev: stages.first_stage(ev, "view")),
        "funnel_cart": _stages_upto("cart"),
        "funnel_purchase": _stages_upto("purchase"),
        "funnel_mart": _funnel_mart,
        "stage_row_checks": _stage_row_checks,
        "funnel_mart_by_weeks": _mart_by_weeks,
        "mart_sample": _on_mart(
            lambda mart: conversion.mart_sample(mart.select(stages.mart_columns()))
        ),
        "first_view_event_attrs": _first_view_events,
        # First-view attributes and segments
        "funnel_totals": _on_mart(conversion.funnel_totals),
        "first_view_price": _on_log(
            lambda ev: stages.first_view_attribute(ev, "price", "view_price")
        ),
        "first_view_category": _on_log(
            lambda ev: stages.first_view_attribute(ev, "category_code", "category_code").drop(
                "first_view"
            )
        ),
        "first_view_brand": _on_log(
            lambda ev: stages.first_view_attribute(ev, "brand", "brand").drop("first_view")
        ),
        "first_view_coverage": _on_mart(segments.first_view_coverage),
        "price_distribution": _on_mart(segments.price_distribution),
        "price_band_counts": _on_mart(segments.price_band_counts),
        "price_band_conversion": _on_mart(
            lambda em: segments.price_band_conversion(em.where(conversion.has_product()))
        ),
        "top_category_conversion": _on_mart(
            lambda em: conversion.top_conversion(em, "category_code")
        ),
        "top_brand_conversion": _on_mart(lambda em: conversion.top_conversion(em, "brand")),
        "category_price_mix": _on_mart(segments.category_price_mix),
        "category_price_conversion_a": _on_mart(
            lambda em: segments.category_price_conversion(em, CATEGORY_A)
        ),
        "category_price_conversion_b": _on_mart(
            lambda em: segments.category_price_conversion(em, CATEGORY_B)
        ),
        "top_category_price_conversion": _on_mart(segments.top_category_price_conversion),
        "segment_cube": _segment_cube,
        # Session depth
        "session_depth_distribution": _on_sessions(depth.session_depth_distribution),
        "depth_band_conversion": _on_sessions(depth.depth_band_conversion),
        "category_depth_conversion": _on_mart(
            lambda em: depth.category_depth_conversion(em, CATEGORY_A)
        ),
        "depth_cart_crosstab": _on_sessions(depth.depth_cart_crosstab),
        "session_depth_any_cart": _on_sessions(depth.session_depth_any_cart),
        "depth_cart_rate": _on_sessions(depth.depth_cart_rate),
        "depth_purchase_rate": _on_sessions(depth.depth_purchase_rate),
        "multi_view_baseline": _on_sessions(depth.multi_view_baseline),
        # Tests and experiment planning, from the measured baseline
        "chi_square_cramers_v": _on_sessions(
            lambda sessions: experiment.chi_square(depth.depth_cart_crosstab(sessions))
        ),
        "uplift_targets": _on_baseline(experiment.uplift_targets),
        "sample_size_fixed": _on_baseline(experiment.sample_size_fixed),
        "sample_size_by_uplift": _on_baseline(experiment.sample_size_by_uplift),
    }
