"""Builds the session-product mart that all funnel analyses read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stagepath.model import FIRST_VIEW_ATTRIBUTES, FUNNEL, Funnel
from stagepath.operators import stages
from stagepath.sources.versions import VersionedFolder
from stagepath.staging import Staging

BOUNDS, RESOLVED = "pair-bounds", "resolved"


def _counts(funnel: Funnel, chosen: Column) -> dict[str, Column]:
    """How many of the chosen rows there are, and how many have reached each stage."""
    counts = {"total": F.count_if(chosen)}
    for stage in funnel.later:
        counts[stage] = F.count_if(chosen & F.col(funnel.reached(stage)).isNotNull())
    return counts


def ordered_stages(
    ev: DataFrame,
    staging: Staging,
    funnel: Funnel = FUNNEL,
    attributes: dict[str, str] | None = None,
    stored: bool = False,
) -> DataFrame:
    """One row per viewed pair with the time at which it reached each stage.

    One pass over the log decides nearly every pair. Pairs whose events of a
    stage lie on both sides of the stage before go back to the log once, for
    their events of the later stages, and are followed stage by stage in those,
    in one plan, the result of which is written only if `stored`, for a mart that
    is read often.
    The first pass is written split by `open`: the small part then has a known
    size, so Spark broadcasts it when it fits and shuffles it when it does not.
    """
    bounds = staging.save(
        stages.pair_bounds(ev, funnel, attributes),
        BOUNDS,
        partition_by="open",
        measures=_counts(funnel, ~F.col("open")) | {"open": F.count_if("open")},
    )
    decided = bounds.where("NOT open").drop("open")
    pending = bounds.where("open")
    if not funnel.later or not staging.measured[BOUNDS]["open"]:
        return decided

    later = [funnel.reached(stage) for stage in funnel.later]
    events = staging.save(stages.later_events(pending, ev, funnel), "pending-events")
    resolved = stages.follow(pending.drop("open", *later), events, funnel)
    if stored:
        resolved = staging.save(resolved, RESOLVED, measures=_counts(funnel, F.lit(True)))
    return decided.unionByName(resolved)


def step_counts(staging: Staging, funnel: Funnel = FUNNEL) -> dict[str, dict[str, int]]:
    """Rows and reached stages after each step of the stored mart that was built in `staging`.

    They were measured as the steps were written. The first pass gives all pairs; those that it
    decides and those that went back to the log must be as many again.
    """
    bounds = staging.measured[BOUNDS]
    resolved = staging.measured.get(RESOLVED, dict.fromkeys(bounds, 0))
    steps = {funnel.first: {"total": bounds["total"] + bounds["open"]}}
    for at, stage in enumerate(funnel.later, 1):
        names = ("total", *funnel.later[:at])
        steps[stage] = {name: bounds[name] + resolved[name] for name in names}
    return steps


def build_mart(ev: DataFrame, staging: Staging, funnel: Funnel = FUNNEL) -> DataFrame:
    """The mart: stage times and 0/1 flags per pair."""
    pairs = ordered_stages(ev, staging, funnel)
    return stages.with_flags(pairs, funnel).select(*stages.mart_columns(funnel))


def build_enriched_mart(
    ev: DataFrame,
    staging: Staging,
    funnel: Funnel = FUNNEL,
    attributes: dict[str, str] = FIRST_VIEW_ATTRIBUTES,
) -> DataFrame:
    """The mart plus price, category and brand at each pair's first view, stored."""
    pairs = ordered_stages(ev, staging, funnel, attributes, stored=True)
    return stages.with_flags(pairs, funnel).select(
        *stages.mart_columns(funnel), *attributes.values()
    )


def write_mart(mart: DataFrame, path: str) -> DataFrame:
    """Stores the mart in place of any earlier one, and reads it back.

    The earlier one is replaced all at once when the new one is complete; a failed write leaves it.
    """
    spark = mart.sparkSession

    def write(folder: str) -> dict[str, str]:
        mart.write.parquet(folder)
        return {}

    folder = VersionedFolder(spark, path).publish(write)["folder"]
    return spark.read.schema(mart.schema).parquet(folder)


def read_mart(spark: SparkSession, path: str) -> DataFrame:
    """The mart that `write_mart` has stored last."""
    found = VersionedFolder(spark, path).current()
    if found is None:
        raise ValueError(f"no mart is stored at {path}")
    return spark.read.parquet(found["folder"])
