"""Shop events derived from the generic `events` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stagepath.model import EVENT_SCHEMA


def _path(sf_dir: str) -> str:
    return f"{sf_dir}/events.parquet"


def version(spark: SparkSession, sf_dir: str) -> int:
    """A number that changes when files of the `events` table do. Only the file
    listing is read, a few bytes per file, so one task does."""
    files = spark.read.format("binaryFile").load(_path(sf_dir)).coalesce(1)
    stamp = F.xxhash64("path", "modificationTime", "length")
    return files.agg(F.bit_xor(stamp)).first()[0]


def canonical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `events` table in the event model.

    The table has no product, session, price or cart, so they are derived from
    its columns, with NULLs, zero and negative prices, time ties and sessions
    of very different depth.
    """
    k = F.get_json_object("props", "$.k").cast("long")
    raw = spark.read.parquet(_path(sf_dir)).select(
        "event_id",
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("event_time"),
        "event_type",
        "user_id",
        "value",
        k.alias("k"),
    )
    k, user = F.col("k"), F.col("user_id").cast("string")
    event_type, kind = F.col("event_type"), F.col("user_id") % 3
    derived = {
        "event_type": F.when(event_type == "click", "cart")
        .when(event_type == "purchase", "purchase")
        .otherwise("view"),
        "product_id": F.when(k == 99, None).otherwise(k % 40),
        "category_id": k,
        "category_code": F.when(k % 7 != 0, F.concat(F.lit("cat."), (k % 12).cast("string"))),
        "brand": F.when(k % 6 != 0, F.concat(F.lit("brand_"), (k % 20).cast("string"))),
        "price": F.when(k == 13, 0.0)
        .when(k == 14, None)
        .when(k == 15, -F.col("value"))
        .otherwise(F.col("value")),
        "user_session": F.when(F.col("event_id") % 101 == 0, None)
        .when(kind == 0, F.concat(user, F.lit("-m")))
        .when(kind == 1, F.concat(user, F.lit("-w"), week().cast("string")))
        .otherwise(F.concat(user, F.lit("-d"), F.dayofmonth("event_time").cast("string"))),
    }
    return raw.withColumns(derived).select(*EVENT_SCHEMA.names)


def week() -> Column:
    """Week of the month of an event, counted from 0."""
    return F.floor(F.dayofmonth("event_time") / 7)
