"""The event model: column names, types and the funnel definition."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Raw log columns in file order. event_time is zone-free, so results do not
# depend on the session time zone.
LOG_SCHEMA = T.StructType(
    [
        T.StructField("event_time", T.TimestampNTZType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("product_id", T.LongType()),
        T.StructField("category_id", T.LongType()),
        T.StructField("category_code", T.StringType()),
        T.StructField("brand", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("user_session", T.StringType()),
    ]
)

# Operators take the log plus event_id, which makes "first" deterministic when
# two events carry the same time.
EVENT_SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), *LOG_SCHEMA.fields])

# What is remembered about a pair's first view: source column -> mart column.
FIRST_VIEW_ATTRIBUTES = {
    "price": "view_price",
    "category_code": "category_code",
    "brand": "brand",
}


@dataclass(frozen=True)
class Funnel:
    """An ordered list of event types, followed per (session, product) pair."""

    stages: tuple[str, ...] = ("view", "cart", "purchase")
    keys: tuple[str, str] = ("user_session", "product_id")

    @property
    def first(self) -> str:
        return self.stages[0]

    @property
    def later(self) -> tuple[str, ...]:
        return self.stages[1:]

    def reached(self, stage: str) -> str:
        """Name of the column holding the time at which `stage` was reached."""
        return f"first_{stage}" if stage == self.first else f"first_valid_{stage}"

    def upto(self, stage: str) -> Funnel:
        return Funnel(self.stages[: self.stages.index(stage) + 1], self.keys)


FUNNEL = Funnel()
