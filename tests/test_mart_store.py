"""The mart that grows log by log, and tables that are replaced as a whole."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stagepath.model import EVENT_SCHEMA
from stagepath.plans.mart import build_enriched_mart
from stagepath.plans.mart_store import MartStore
from stagepath.sources.versions import Conflict, VersionedFolder
from stagepath.staging import Staging
from tests.conftest import EDGE_ROWS, at, make_events


def rows_of(frame):
    return sorted(map(repr, frame.collect()))


def parts_of(ev, cuts):
    """The events in parts, by event_id and not by time."""
    bounds = [-1, *sorted(cuts), 10**9]
    return [ev.where(F.col("event_id").between(low + 1, high)) for low, high in zip(bounds, bounds[1:])]


def grown(spark, tmp_path, parts):
    store = MartStore(spark, str(tmp_path / "mart"))
    for i, part in enumerate(parts):
        store.add(part, f"log {i}")
    assert store.logs == [f"log {i}" for i in range(len(parts))]
    return store.mart()


@pytest.mark.parametrize("cuts", [[], [3, 14], [0, 1, 2, 8, 20]])
def test_edge_rows_in_parts(spark, edge_events, staging, tmp_path, cuts):
    whole = build_enriched_mart(edge_events, staging)
    found = grown(spark, tmp_path, parts_of(edge_events, cuts))
    assert found.dtypes == whole.dtypes
    assert rows_of(found) == rows_of(whole)


EVENT = st.tuples(
    st.sampled_from(["a", "b", None]), st.sampled_from([1, 2, None]),
    st.sampled_from(["view", "cart", "cart", "purchase"]), st.sampled_from([None, *range(9)]),
    st.sampled_from([1.0, 2.0, None]),
)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(EVENT, max_size=40), st.lists(st.integers(0, 40), max_size=2))
def test_random_logs_in_parts(spark, tmp_path_factory, rows, cuts):
    """Also logs whose times overlap, so that a later log moves a first view forward."""
    ev = make_events(spark, rows).persist()
    found = grown(spark, tmp_path_factory.mktemp("store"), parts_of(ev, cuts))
    assert rows_of(found) == rows_of(build_enriched_mart(ev, Staging(spark)))
    ev.unpersist()


def test_an_earlier_log_is_not_read_again(spark, tmp_path, staging):
    first = make_events(spark, EDGE_ROWS[:15])
    second = make_events(spark, EDGE_ROWS[15:]).withColumn("event_id", F.col("event_id") + 100)
    log = str(tmp_path / "first")
    first.write.parquet(log)
    store = MartStore(spark, str(tmp_path / "mart"))
    store.add(spark.read.parquet(log), "first")
    # Nothing can read the first log any more.
    spark.createDataFrame([], EVENT_SCHEMA).write.mode("overwrite").parquet(log)
    found = store.add(second, "second")
    assert rows_of(found) == rows_of(build_enriched_mart(first.unionByName(second), staging))
    assert not any("/first/" in name for name in found.inputFiles())


def test_a_pair_waits_for_its_view(spark, tmp_path):
    store = MartStore(spark, str(tmp_path / "mart"))
    store.add(make_events(spark, [("s", 1, "cart", 5, 1.0), ("s", 1, "purchase", 6, 1.0)]), "carts")
    assert store.mart().collect() == []
    views = make_events(spark, [("s", 1, "view", 5, 3.0)]).withColumn("event_id", F.lit(9).cast("long"))
    row = store.add(views, "views").first()
    assert (row.first_valid_cart, row.first_valid_purchase, row.view_price) == (at(5), at(6), 3.0)


def test_a_failed_addition_leaves_the_mart(spark, tmp_path, edge_events):
    store = MartStore(spark, str(tmp_path / "mart"))
    before = rows_of(store.add(edge_events, "one"))
    broken = edge_events.withColumn(
        "event_time", F.when(F.col("event_id") < 90, F.raise_error(F.lit("lost")).cast("timestamp_ntz"))
    )
    with pytest.raises(Exception, match="lost"):
        store.add(broken, "two")
    assert store.logs == ["one"] and rows_of(store.mart()) == before
    with pytest.raises(ValueError):
        store.add(edge_events, "one")
    more = make_events(spark, [("Z", 1, "view", 1, 1.0)]).withColumn("event_id", F.lit(99).cast("long"))
    assert store.add(more, "two").count() == len(before) + 1


def test_no_log_no_mart(spark, tmp_path):
    with pytest.raises(ValueError):
        MartStore(spark, str(tmp_path / "mart")).mart()
    store = MartStore(spark, str(tmp_path / "mart"))
    assert store.add(make_events(spark, []), "none").collect() == []


def folder_names(path):
    return sorted(p.name[:2] for p in path.iterdir())


def test_versions_are_replaced_as_a_whole(spark, tmp_path):
    table = VersionedFolder(spark, str(tmp_path / "t"))
    assert table.current() is None

    def write(n):
        def run(folder):
            spark.range(n).write.parquet(folder)
            return {"n": n}

        return run

    for n in (1, 2, 3):
        table.publish(write(n))
    assert table.current()["n"] == 3
    assert folder_names(tmp_path / "t") == ["_v", "v-", "v-"]

    def fails(folder):
        spark.range(9).write.parquet(folder)
        raise OSError("lost")

    with pytest.raises(OSError):
        table.publish(fails)
    assert table.current()["n"] == 3 and folder_names(tmp_path / "t") == ["_v", "v-", "v-"]


def test_of_two_writers_one_publishes(spark, tmp_path):
    table, other = (VersionedFolder(spark, str(tmp_path / "t")) for _ in range(2))
    table.publish(lambda folder: {"by": "first"})

    def slow(folder):
        other.publish(lambda folder: {"by": "other"}, since=1)
        return {"by": "slow"}

    with pytest.raises(Conflict):
        table.publish(slow, since=1)
    with pytest.raises(Conflict):
        table.publish(lambda folder: {"by": "late"}, since=1)
    assert table.current()["by"] == "other"


def test_an_unfinished_pointer_is_passed_over(spark, tmp_path):
    table = VersionedFolder(spark, str(tmp_path / "t"))
    table.publish(lambda folder: {"n": 1})
    (tmp_path / "t" / "_versions" / "000000000002").write_text('{"n": 2')
    assert table.current()["n"] == 1
    assert table.publish(lambda folder: {"n": 3})["number"] == 3 and table.current()["n"] == 3
