"""Every registered query against its checking SQL."""

import os

import pytest

import __spark_entry__ as entry_points
from oracles import duckdb_sql
from stagepath.plans import catalog
from tests.conftest import TESTDATA, duckdb_tables, settings

QUERIES = catalog.queries()
ORACLES = duckdb_sql.oracle_sql()
TYPES = {
    "bigint": "BIGINT",
    "boolean": "BOOLEAN",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "timestamp_ntz": "TIMESTAMP",
}


def rows_by_name(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def test_every_query_has_checking_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_points_offer_every_query():
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(ORACLES) <= set(entry_points.oracle_sql())


def assert_matches_sql(spark, name, sf_dir):
    frame = QUERIES[name](spark, sf_dir)
    con = duckdb_tables(sf_dir)
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    expected = cursor.fetchall()
    assert {c: TYPES[t] for c, t in frame.dtypes} == kinds
    assert rows_by_name(frame.collect(), frame.columns) == rows_by_name(expected, columns)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    assert_matches_sql(spark, name, f"{TESTDATA}/sf0.01")


@pytest.mark.parametrize(
    "kept", ["event_id < 0", "event_id = 1", "event_type not in ('click', 'purchase')"]
)
def test_queries_match_sql_on_sparse_logs(spark, tmp_path, kept):
    """No events at all, a single one, and only views."""
    con = duckdb_tables(f"{TESTDATA}/sf0.001")
    con.execute(f"copy (from events where {kept}) to '{tmp_path}/events.parquet' (format parquet)")
    # So few rows take one task and one job per query.
    with settings(spark, spark__sql__adaptive__enabled="false", spark__sql__shuffle__partitions="1"):
        for name in QUERIES:
            assert_matches_sql(spark, name, str(tmp_path))


def test_clean_removes_what_queries_wrote(spark, tmp_path):
    con = duckdb_tables(f"{TESTDATA}/sf0.001")
    con.execute(f"copy (from events) to '{tmp_path}/events.parquet' (format parquet)")
    QUERIES["funnel_counts"](spark, str(tmp_path)).collect()
    assert QUERIES["funnel_totals"](spark, str(tmp_path)).first().view_count == 494
    roots = [staging.root for staging in catalog._stagings]
    assert len(roots) >= 2
    catalog.clean()
    assert not any(os.path.exists(root) for root in roots)
    assert QUERIES["funnel_totals"](spark, str(tmp_path)).first().view_count == 494


def test_entry_runs(spark):
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize(
    "scale, expected", [("0.001", (494, 26, 1)), ("0.01", (4954, 309, 29)), ("0.1", (49791, 2915, 262))]
)
def test_funnel_counts_at_every_scale(spark, scale, expected):
    row = QUERIES["funnel_totals"](spark, f"{TESTDATA}/sf{scale}").first()
    assert (row.view_count, row.cart_count, row.purchase_count) == expected


def test_stored_mart_follows_its_table(spark, tmp_path):
    """The mart is reused while the events stay the same, and only then."""
    events = spark.read.parquet(f"{TESTDATA}/sf0.001/events.parquet")
    path = f"{tmp_path}/events.parquet"
    totals = QUERIES["funnel_totals"]
    events.where("event_id < 500").write.parquet(path)
    small = totals(spark, str(tmp_path)).first()
    stored = catalog.stored_mart(spark, str(tmp_path))
    assert catalog.stored_mart(spark, str(tmp_path)) is stored
    events.write.mode("overwrite").parquet(path)
    assert small.view_count < totals(spark, str(tmp_path)).first().view_count == 494
