"""Shop event logs: gzip CSV in, typed Parquet out."""

from __future__ import annotations

import functools
import hashlib
import json
import posixpath
import warnings
from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagepath.model import EVENT_SCHEMA, LOG_SCHEMA

# Fixed value: how the log writes its times.
LOG_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss 'UTC'"
# Fixed value: a quote inside a quoted field is written twice.
QUOTE = '"'

Logs = str | Sequence[str] | Mapping[str, str | Sequence[str]]


def labelled(logs: Logs) -> dict[str, list[str]]:
    """Paths by label. A label given with its paths may cover several files; a path given
    alone is labelled by its last part, or by all of it if another ends alike."""
    if isinstance(logs, Mapping):
        return {name: [paths] if isinstance(paths, str) else list(paths) for name, paths in logs.items()}
    paths = list(dict.fromkeys([logs] if isinstance(logs, str) else logs))
    short = [posixpath.basename(path.rstrip("/")) for path in paths]
    often = Counter(short)
    return {
        name if often[name] == 1 else path: [path] for name, path in zip(short, paths, strict=True)
    }


def read_log(spark: SparkSession, logs: Logs) -> DataFrame:
    """Events of one or more CSV logs, with the label of the log each row came from.

    A row that does not fit the schema fails a read of all columns; a read of some
    columns may pass it over, so logs are profiled after `ingest_events`, which reads
    them all. Events get an id made from all their columns, which only serves to
    break ties in time.
    """

    def read(label: str, paths: list[str]) -> DataFrame:
        log = (
            spark.read.schema(LOG_SCHEMA)
            .option("header", True)
            .option("enforceSchema", False)
            .option("mode", "FAILFAST")
            .option("escape", QUOTE)
            .option("timestampNTZFormat", LOG_TIME_FORMAT)
            .csv(paths)
        )
        return log.select(
            F.xxhash64(*LOG_SCHEMA.names).alias("event_id"),
            *LOG_SCHEMA.names,
            F.lit(label).alias("source_file"),
        )

    parts = [read(label, paths) for label, paths in labelled(logs).items()]
    return functools.reduce(DataFrame.unionByName, parts)


def write_log(ev: DataFrame, path: str) -> None:
    """Writes events as gzip CSV, the form that `read_log` takes. The form has whole
    seconds, so a time with a fraction of one fails the write."""
    time = F.col("event_time")
    whole = F.when(
        time.isNull() | (F.date_trunc("second", time).cast("timestamp_ntz") == time), time
    ).otherwise(F.raise_error(F.concat(F.lit("a log holds whole seconds, not "), time.cast("string"))))
    (
        ev.select(*LOG_SCHEMA.names)
        .withColumn("event_time", whole.cast("timestamp_ntz"))
        .write.option("header", True)
        .option("compression", "gzip")
        .option("escape", QUOTE)
        .option("timestampNTZFormat", LOG_TIME_FORMAT)
        .csv(path)
    )


def _sources_path(table_path: str) -> str:
    # Readers of the table pass over names that begin with an underscore.
    return f"{table_path}/_sources"


def _stamp(spark: SparkSession, paths: Sequence[str]) -> str:
    """A digest that changes when files of a log do: their names, sizes and times, from the listing alone."""
    files = []
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        for found in store.globStatus(place) or []:
            held = store.listStatus(found.getPath()) if found.isDirectory() else [found]
            files += [(one.getPath().toString(), one.getLen(), one.getModificationTime()) for one in held]
    return hashlib.sha256(json.dumps(sorted(files)).encode()).hexdigest()


def _stored_sources(spark: SparkSession, table_path: str) -> dict[str, dict] | None:
    """What a finished table was ingested from; None for one that is not finished.

    The record is written after the table's own commit, and counts once it is
    committed itself.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{_sources_path(table_path)}/_SUCCESS")
    store = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not store.exists(place):
        return None
    return json.loads(spark.read.text(_sources_path(table_path)).first().value)


def ingest_events(
    spark: SparkSession,
    logs: Logs,
    table_path: str,
    by_day: bool = False,
    by_source: bool = False,
) -> DataFrame:
    """Converts CSV logs to Parquet unless that has been done in full at `table_path`.

    A finished table of other logs is an error. One of logs whose files have been written anew since
    stays as it is, with a warning that names them. A gzip file is read by one task,
    so a log is best delivered as many files; no shuffle is spent on evening them
    out, as Parquet splits on reading. `by_day` lays the table out by date, so a
    query over a month reads a month; `by_source` keeps the label of each row's
    log and lays the table out by it.
    """
    events = read_log(spark, logs)
    layout = ["source_file"] if by_source else []
    events = events.select(*EVENT_SCHEMA.names, *layout)
    if by_day:
        events = events.withColumn("event_date", F.to_date("event_time"))
        layout = [*layout, "event_date"]
    sources = {
        label: {"paths": paths, "files": _stamp(spark, paths)} for label, paths in labelled(logs).items()
    }
    stored = _stored_sources(spark, table_path)
    if stored is None:
        events.write.mode("overwrite").partitionBy(*layout).parquet(table_path)
        record = spark.createDataFrame([(json.dumps(sources),)], "value string")
        record.coalesce(1).write.text(_sources_path(table_path))
    elif {label: one["paths"] for label, one in stored.items()} != labelled(logs):
        raise ValueError(f"{table_path} holds the events of {stored}, not of {sources}")
    else:
        changed = sorted(label for label, one in sources.items() if stored[label] != one)
        if changed:
            warnings.warn(
                f"{changed} changed after {table_path} was made, which keeps the events it has", stacklevel=2
            )
    return spark.read.schema(events.schema).parquet(table_path)
