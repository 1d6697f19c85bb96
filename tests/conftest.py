from __future__ import annotations

import contextlib
import datetime as dt
import glob
import os

import duckdb
import pytest
from pyspark.sql import SparkSession

from stagepath.model import EVENT_SCHEMA
from stagepath.staging import Staging

TESTDATA = "/root/testdata"
START = dt.datetime(2019, 12, 1)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("stagepath-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def staging(spark):
    return Staging(spark)


@contextlib.contextmanager
def settings(spark, **values):
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def at(seconds):
    return None if seconds is None else START + dt.timedelta(seconds=seconds)


def make_events(spark, rows):
    """Events from (session, product, type, seconds, price[, category, brand]);
    event_id is the row order."""
    records = []
    for i, (session, product, kind, seconds, price, *more) in enumerate(rows):
        category, brand = (list(more) + [None, None])[:2]
        records.append(
            (i, at(seconds), kind, product, None, category, brand, price, 1, session)
        )
    return spark.createDataFrame(records, EVENT_SCHEMA)


# Each (session, product) group shows one rule of the funnel.
EDGE_ROWS = [
    ("A", 1, "view", 1, 10.0), ("A", 1, "cart", 2, 10.0), ("A", 1, "purchase", 3, 10.0),
    ("A", 2, "view", 1, 58.95), ("A", 2, "cart", 1, 58.95), ("A", 2, "view", 5, 60.0),
    ("A", 3, "cart", 1, 60.0), ("A", 3, "view", 2, 153.47), ("A", 3, "cart", 3, 60.0),
    ("A", 4, "view", 1, 334.13), ("A", 4, "purchase", 2, 1.0),
    ("A", 5, "view", 1, 334.14), ("A", 5, "purchase", 2, 1.0), ("A", 5, "cart", 3, 1.0),
    ("A", 6, "view", 1, 60.0), ("A", 6, "purchase", 1, 1.0), ("A", 6, "cart", 2, 1.0),
    ("A", 6, "purchase", 4, 1.0),
    ("B", 7, "cart", 1, 1.0), ("B", 7, "purchase", 2, 1.0),
    (None, 1, "view", 1, 1.0),
    ("C", None, "view", 1, 1.0), ("C", None, "cart", 2, 1.0),
    ("C", 8, "view", 1, None), ("C", 8, "view", 2, 5.0),
    ("C", 9, "view", 1, 0.0),
    ("D", 10, "view", 1, -1.0),
    ("E", 11, "view", 1, 10.0), ("E", 11, "view", 1, 200.0),
    ("F", 12, "cart", 1, 1.0), ("F", 12, "view", 2, 1.0),
]


@pytest.fixture(scope="session")
def edge_events(spark):
    return make_events(spark, EDGE_ROWS)


def duckdb_tables(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{path}'")
    return con
