"""When each session-product pair reached each stage of the funnel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagepath.model import FUNNEL, Funnel

TIME = "event_time"
TIE_BREAK = "event_id"


def in_session() -> Column:
    return F.col("user_session").isNotNull()


def _time_if(condition: Column) -> Column:
    return F.when(condition, F.col(TIME))


def first_stage(ev: DataFrame, stage: str, funnel: Funnel = FUNNEL) -> DataFrame:
    """Pairs with at least one `stage` event, and the time of the first one."""
    return (
        ev.where((F.col("event_type") == stage) & in_session())
        .groupBy(*funnel.keys)
        .agg(F.min(TIME).alias(f"first_{stage}"))
    )


def next_stage(
    prev: DataFrame, ev: DataFrame, stage: str, after: str, funnel: Funnel = FUNNEL
) -> DataFrame:
    """`prev` plus the first time of `stage` at or after the time in `after`.

    `prev` has one row per pair and should be a stored table: it is read twice.
    Pairs with a NULL key never match. The events are reduced before they are
    grouped across the cluster: grouping on the pair as one value keeps the
    join's own partitioning out of the aggregation, so the shuffle between them
    carries one row per pair and task, and a pair that holds much of the log may
    be split over many join tasks.
    """
    hits = (
        ev.where(F.col("event_type") == stage)
        .select(*funnel.keys, TIME)
        .join(prev.select(*funnel.keys, after), list(funnel.keys))
        .where(F.col(TIME) >= F.col(after))
        .groupBy(F.struct(*funnel.keys).alias("pair"))
        .agg(F.min(TIME).alias(funnel.reached(stage)))
        .select("pair.*", funnel.reached(stage))
    )
    return prev.join(hits, list(funnel.keys), "left").select(
        *prev.columns, funnel.reached(stage)
    )


def follow(pairs: DataFrame, events: DataFrame, funnel: Funnel = FUNNEL) -> DataFrame:
    """`pairs` plus the first valid time of every later stage, from `later_events`.

    `pairs` has one row per pair. Its events begin at the first view, so the first
    stage after it is a plain minimum; each further stage is the minimum of
    the times at or after the one before. Nothing is written in between: what a
    stage needs of the one before is one row per pair.
    """
    keys, found, before = list(funnel.keys), pairs, None
    for stage in funnel.later:
        times = events.where(F.col("event_type") == stage)
        if before is not None:
            after, reached = before
            times = times.join(reached, keys).where(F.col(TIME) >= F.col(after))
        first = (
            times.groupBy(F.struct(*keys).alias("pair"))
            .agg(F.min(TIME).alias(funnel.reached(stage)))
            .select("pair.*", funnel.reached(stage))
        )
        found = found.join(first, keys, "left")
        before = funnel.reached(stage), first
    return found.select(*pairs.columns, *(funnel.reached(stage) for stage in funnel.later))


def later_events(pairs: DataFrame, ev: DataFrame, funnel: Funnel = FUNNEL) -> DataFrame:
    """When the given pairs had events of the later stages, from their first view
    on, each time once.

    A log in seconds thus leaves at most 86,400 rows a day for a pair and stage,
    whatever the number of its events. They are told apart as one value, so that
    they are shuffled by all of it and not by their pair.
    """
    start = funnel.reached(funnel.first)
    return (
        ev.where(F.col("event_type").isin(*funnel.later))
        .select(*funnel.keys, "event_type", TIME)
        .join(pairs.select(*funnel.keys, start), list(funnel.keys))
        .where(F.col(TIME) >= F.col(start))
        .select(F.struct(*funnel.keys, "event_type", TIME).alias("event"))
        .distinct()
        .select("event.*")
    )


def first_view_key(attributes: Sequence[str]) -> Column:
    # Ordered as: known times first, then by time, then by event_id. The
    # attributes ride behind the key, so a NULL attribute is kept as it is.
    return F.struct(
        F.col(TIME).isNull().alias("unknown"), F.col(TIME), F.col(TIE_BREAK), *attributes
    )


def first_view_attribute(
    ev: DataFrame, attribute: str, name: str, funnel: Funnel = FUNNEL
) -> DataFrame:
    """The value of `attribute` at each pair's first event of the first stage."""
    return (
        ev.where((F.col("event_type") == funnel.first) & in_session())
        .groupBy(*funnel.keys)
        .agg(F.min(first_view_key([attribute])).alias("first"))
        .select(
            *funnel.keys,
            F.col(f"first.{TIME}").alias(funnel.reached(funnel.first)),
            F.col(f"first.{attribute}").alias(name),
        )
    )


def first_view(attributes: Sequence[str], funnel: Funnel = FUNNEL) -> Column:
    """Aggregate: the key and attributes of the first event of the first stage."""
    return F.min(F.when(F.col("event_type") == funnel.first, first_view_key(list(attributes))))


def later_bounds(funnel: Funnel = FUNNEL) -> list[Column]:
    """Aggregates: the earliest and latest time of every later stage."""
    # A NULL product is a pair of its own, but its later events match nothing.
    has_keys, bounds = F.col("product_id").isNotNull(), []
    for stage in funnel.later:
        time = _time_if((F.col("event_type") == stage) & has_keys)
        bounds += [F.min(time).alias(f"_{stage}_min"), F.max(time).alias(f"_{stage}_max")]
    return bounds


def pair_bounds(
    ev: DataFrame, funnel: Funnel = FUNNEL, attributes: dict[str, str] | None = None
) -> DataFrame:
    """One pass over the log: every pair's first view, its attributes there,
    and the stages that the bounds of their times already decide.

    A stage is decided when all its events lie on one side of the stage before.
    `open` marks the few pairs where they lie on both sides. All the state is
    min/max, so each task sends one row per pair however often the pair occurs.
    """
    attributes = attributes or {}
    is_first = F.col("event_type") == funnel.first
    view_time = funnel.reached(funnel.first)
    if attributes:
        aggregates = [first_view(attributes, funnel).alias("_first")]
        viewed, first_time = F.col("_first").isNotNull(), F.col(f"_first.{TIME}")
    else:
        # Only fixed-width state is left, which Spark aggregates by hashing.
        aggregates = [
            F.bool_or(is_first).alias("_viewed"),
            F.min(_time_if(is_first)).alias("_first_time"),
        ]
        viewed, first_time = F.col("_viewed"), F.col("_first_time")
    pairs = (
        ev.where(F.col("event_type").isin(*funnel.stages) & in_session())
        .groupBy(*funnel.keys)
        .agg(*aggregates, *later_bounds(funnel))
        .where(viewed)
        .withColumn(view_time, first_time)
    )

    prev = F.col(view_time)
    reached, is_open = [prev], F.lit(False)
    for stage in funnel.later:
        low, high = F.col(f"_{stage}_min"), F.col(f"_{stage}_max")
        is_open = is_open | F.coalesce((low < prev) & (high >= prev), F.lit(False))
        prev = F.when(low >= prev, low)
        reached.append(prev.alias(funnel.reached(stage)))
    return pairs.select(
        *funnel.keys,
        *reached,
        *(F.col(f"_first.{source}").alias(name) for source, name in attributes.items()),
        is_open.alias("open"),
    )


def with_flags(pairs: DataFrame, funnel: Funnel = FUNNEL) -> DataFrame:
    """Adds a 0/1 flag for every stage after the first."""
    return pairs.withColumns(
        {
            f"{stage}_flag": F.when(F.col(funnel.reached(stage)).isNotNull(), 1).otherwise(0)
            for stage in funnel.later
        }
    )


def mart_columns(funnel: Funnel = FUNNEL) -> list[str]:
    """Columns of the mart without the first-view attributes."""
    return [
        *funnel.keys,
        *(funnel.reached(stage) for stage in funnel.stages),
        *(f"{stage}_flag" for stage in funnel.later),
    ]
