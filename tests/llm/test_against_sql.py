"""Text queries against their checking SQL, over whole tables."""

import pytest

from stagepath.llm import queries
from tests.conftest import TESTDATA, duckdb_tables
from tests.llm.helpers import as_set

SF_DIR = f"{TESTDATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    found = [row.asDict() for row in queries.queries()[name](spark, SF_DIR).collect()]
    cursor = duckdb_tables(SF_DIR).execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert as_set(found) == as_set(dict(zip(names, row, strict=True)) for row in cursor.fetchall())


def test_every_operator_has_one_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.queries())
    assert numbers == list(range(1, 14))
