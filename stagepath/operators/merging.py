"""What must be kept of a log, so that a later log can be added without reading it again.

The first view of a pair only moves to earlier times when events are added, and with it the
first valid time of every later stage. So what a stage needs of earlier logs is its first valid
time and, before that, each time at which it had an event: one of these may become valid.
Later events never matter again. Nearly all pairs have none before, so the state is little
more than the mart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagepath.model import FUNNEL, Funnel
from stagepath.operators import stages
from stagepath.operators.stages import TIME


def _low(stage: str) -> str:
    return f"_{stage}_min"


def empty_state(ev: DataFrame, attributes: dict[str, str], funnel: Funnel = FUNNEL) -> tuple[DataFrame, DataFrame]:
    """The state of no events: pairs, and times that may still become valid."""
    nothing = ev.where(F.lit(False))
    time = F.col(TIME)
    pairs = nothing.select(
        *funnel.keys,
        stages.first_view_key(list(attributes)).alias("first"),
        *(time.alias(funnel.reached(stage)) for stage in funnel.later),
        F.lit(False).alias("waits"),
    )
    return pairs, nothing.select(*funnel.keys, "event_type", TIME)


def merged_pairs(
    pairs: DataFrame, ev: DataFrame, attributes: dict[str, str], funnel: Funnel = FUNNEL
) -> DataFrame:
    """The stored pairs and those of new events as one, in one pass over the new events.

    `open` marks pairs with new events whose times cannot be told from minima: those
    that had an event of a later stage before the stage in front of it. Both sides are
    reduced before they are shuffled, to one row per pair and task.
    """
    later = [(stage, funnel.reached(stage)) for stage in funnel.later]
    new = (
        ev.where(F.col("event_type").isin(*funnel.stages) & stages.in_session())
        .groupBy(*funnel.keys)
        .agg(stages.first_view(attributes, funnel).alias("first"), *stages.later_bounds(funnel))
        .select(
            *funnel.keys,
            "first",
            *(F.lit(None).cast("timestamp_ntz").alias(reached) for _, reached in later),
            *(_low(stage) for stage, _ in later),
            F.lit(False).alias("waits"),
            F.lit(True).alias("new"),
        )
    )
    old = pairs.select(
        *funnel.keys,
        "first",
        *(reached for _, reached in later),
        *(F.lit(None).cast("timestamp_ntz").alias(_low(stage)) for stage, _ in later),
        "waits",
        F.lit(False).alias("new"),
    )
    both = (
        old.unionByName(new)
        .groupBy(*funnel.keys)
        .agg(
            F.min("first").alias("first"),
            *(F.min(reached).alias(f"_old_{reached}") for _, reached in later),
            *(F.min(_low(stage)).alias(_low(stage)) for stage, _ in later),
            F.bool_or("waits").alias("waits"),
            F.bool_or("new").alias("new"),
        )
    )
    before, is_open, reached_now = F.col(f"first.{TIME}"), F.col("waits"), []
    for stage, reached in later:
        low = F.col(_low(stage))
        is_open = is_open | (low.isNotNull() & ~F.coalesce(low >= before, F.lit(False)))
        before = F.least(f"_old_{reached}", low)
        reached_now.append(before.alias(reached))
    return both.where(
        F.col("first").isNotNull()
        | F.col("waits")
        | F.coalesce(*(_low(stage) for stage, _ in later)).isNotNull()
    ).select(*funnel.keys, "first", *reached_now, "waits", (F.col("new") & is_open).alias("open"))


def times_of(open_pairs: DataFrame, pairs: DataFrame, waiting: DataFrame, ev: DataFrame, funnel: Funnel = FUNNEL) -> DataFrame:
    """All times of later stages that may be valid for the open pairs, each once.

    From earlier logs: those that wait, and the stored first valid ones. From the new log: all.
    """
    keys = list(funnel.keys)
    wanted = open_pairs.select(*keys)
    known = pairs.join(wanted, keys, "left_semi").select(
        *keys,
        F.explode(
            F.array(
                *(
                    F.struct(F.lit(stage).alias("event_type"), F.col(funnel.reached(stage)).alias(TIME))
                    for stage in funnel.later
                )
            )
        ).alias("event"),
    )
    new = ev.where(F.col("event_type").isin(*funnel.later)).select(*keys, "event_type", TIME)
    return (
        known.select(*keys, "event.*")
        .unionByName(waiting.join(wanted, keys, "left_semi"))
        .unionByName(new.join(wanted, keys, "left_semi"))
        .where(F.col(TIME).isNotNull())
        .select(F.struct(*keys, "event_type", TIME).alias("event"))
        .distinct()
        .select("event.*")
    )


def resolved_pairs(open_pairs: DataFrame, times: DataFrame, funnel: Funnel = FUNNEL) -> DataFrame:
    """The open pairs with the first valid time of every later stage."""
    keys = list(funnel.keys)
    start = F.col(f"first.{TIME}")
    views = open_pairs.select(*keys, start.alias("_start"))
    valid = times.join(views, keys).where(F.col(TIME) >= F.col("_start")).drop("_start")
    kept = open_pairs.drop(*(funnel.reached(stage) for stage in funnel.later))
    return stages.follow(kept, valid, funnel)


def still_waiting(resolved: DataFrame, times: DataFrame, funnel: Funnel = FUNNEL) -> DataFrame:
    """The times before a pair's first valid one of the stage."""
    keys, reached = list(funnel.keys), [funnel.reached(stage) for stage in funnel.later]
    valid: Column = F.lit(None).cast("timestamp_ntz")
    for stage in funnel.later:
        valid = F.when(F.col("event_type") == stage, F.col(funnel.reached(stage))).otherwise(valid)
    return (
        times.join(resolved.select(*keys, *reached), keys)
        .where(F.coalesce(F.col(TIME) < valid, F.lit(True)))
        .select(*times.columns)
    )


def mart_of(pairs: DataFrame, attributes: dict[str, str], funnel: Funnel = FUNNEL) -> DataFrame:
    """The enriched mart: the stored pairs that have a view."""
    viewed = pairs.where(F.col("first").isNotNull()).select(
        *funnel.keys,
        F.col(f"first.{TIME}").alias(funnel.reached(funnel.first)),
        *(funnel.reached(stage) for stage in funnel.later),
        *(F.col(f"first.{source}").alias(name) for source, name in attributes.items()),
    )
    return stages.with_flags(viewed, funnel).select(
        *stages.mart_columns(funnel), *attributes.values()
    )
