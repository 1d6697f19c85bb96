"""CSV logs, ingestion and staging."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from stagepath.model import EVENT_SCHEMA
from stagepath.operators import profile
from stagepath.sources.event_log import ingest_events, read_log, write_log
from stagepath.sources.event_table import canonical_events
from stagepath.staging import CHECKPOINT_DIR, Staging
from tests.conftest import EDGE_ROWS, TESTDATA, at

HEADER = "event_time,event_type,product_id,category_id,category_code,brand,price,user_id,user_session"
LINES = [
    "2019-12-01 00:00:00 UTC,view,1,2053013555631882655,,samsung,130.76,5,aa",
    "2019-12-01 00:00:01 UTC,cart,1,2053013555631882655,a.b,,0.00,5,",
]


def log_file(folder, name, lines, header=HEADER):
    path = folder / name
    with gzip.open(path, "wt") as out:
        out.write("\n".join([header, *lines]) + "\n")
    return str(path)


def test_read_log(spark, tmp_path):
    rows = read_log(spark, log_file(tmp_path, "2019-Dec.csv.gz", LINES)).orderBy("event_time")
    first, second = rows.collect()
    assert (first.event_time, first.event_type, first.product_id) == (at(0), "view", 1)
    assert (first.category_id, first.category_code, first.brand) == (2053013555631882655, None, "samsung")
    assert (first.price, first.user_id, first.user_session) == (130.76, 5, "aa")
    assert (second.event_time, second.brand, second.price, second.user_session) == (at(1), None, 0.0, None)
    assert first.event_id != second.event_id
    assert first.source_file == "2019-Dec.csv.gz"


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Seoul"])
def test_times_do_not_depend_on_the_session_zone(spark, tmp_path, zone):
    path = log_file(tmp_path, "log.csv.gz", LINES)
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert read_log(spark, path).agg(F.min("event_time")).first()[0] == at(0)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_profile_per_file(spark, tmp_path):
    paths = [
        log_file(tmp_path, "2019-Nov.csv.gz", LINES[:1]),
        log_file(tmp_path, "2019-Dec.csv.gz", LINES),
    ]
    log = read_log(spark, paths)
    profiles = {r.source_file: r for r in profile.log_profile(log, "source_file").collect()}
    assert profiles["2019-Nov.csv.gz"].total_events == 1
    december = profiles["2019-Dec.csv.gz"]
    assert (december.total_events, december.users, december.sessions) == (2, 1, 1)
    assert (december.min_time, december.max_time) == (at(0), at(1))
    shares = profile.event_type_share(log, "source_file").where("source_file like '%Dec%'")
    assert {(r.event_type, r.event_pct) for r in shares.collect()} == {("view", 50.0), ("cart", 50.0)}


def test_bad_rows_fail(spark, tmp_path):
    path = log_file(tmp_path, "bad.csv.gz", ["yesterday,view,1,,,,x,5,aa"])
    with pytest.raises(Exception):
        read_log(spark, path).collect()


def test_wrong_header_fails(spark, tmp_path):
    path = log_file(tmp_path, "bad.csv.gz", LINES, header=HEADER.replace("brand", "maker"))
    with pytest.raises(Exception):
        read_log(spark, path).collect()


def test_doubled_quotes(spark, tmp_path):
    rows = ['2019-12-01 00:00:00 UTC,view,1,,,"x ""y"" z",1,5,aa',
            '2019-12-01 00:00:00 UTC,view,2,,,"x ""y"", z",1,5,aa',
            '2019-12-01 00:00:00 UTC,view,3,,,a\\,1,5,"b\\"']
    log = read_log(spark, log_file(tmp_path, "quoted.csv.gz", rows)).orderBy("product_id")
    assert [r.brand for r in log.collect()] == ['x "y" z', 'x "y", z', "a\\"]
    write_log(log, str(tmp_path / "again"))
    again = read_log(spark, str(tmp_path / "again")).orderBy("product_id")
    assert again.drop("source_file").collect() == log.drop("source_file").collect()


def test_many_files_and_labels(spark, tmp_path):
    for month in ("oct", "nov"):
        (tmp_path / month).mkdir()
    oct_, nov = (log_file(tmp_path / m, "part-0.csv.gz", LINES[:n]) for m, n in (("oct", 1), ("nov", 2)))
    alike = read_log(spark, [oct_, nov])
    assert {r.source_file: r["count"] for r in alike.groupBy("source_file").count().collect()} == {oct_: 1, nov: 2}
    more = log_file(tmp_path / "oct", "part-1.csv.gz", LINES)
    months = ingest_events(spark, {"oct": [oct_, more], "nov": nov}, str(tmp_path / "events"), by_source=True)
    profiles = {r.source_file: r for r in profile.log_profile(months, "source_file").collect()}
    # Users and sessions of a month are counted over all of its files.
    assert (profiles["oct"].total_events, profiles["oct"].users) == (3, 1)
    files = [log_file(tmp_path, f"{i}.csv.gz", LINES[:1]) for i in range(101)]
    assert profile.log_profile(read_log(spark, files), "source_file").count() == 101


def test_fractions_of_a_second_fail_the_write(spark, tmp_path, edge_events):
    exact = edge_events.withColumn("event_time", F.expr("event_time + interval 123 milliseconds"))
    with pytest.raises(Exception, match="whole seconds"):
        write_log(exact, str(tmp_path / "log"))


@pytest.mark.parametrize("report", [
    lambda ev: profile.log_profile(ev, "source_file"), lambda ev: profile.event_type_share(ev, "source_file"),
    profile.row_count,
])
def test_bad_rows_fail_every_profile(spark, tmp_path, report):
    bad = log_file(tmp_path, "bad.csv.gz", [LINES[0], LINES[1].replace("0.00", "xx")])
    with pytest.raises(Exception):
        report(ingest_events(spark, bad, str(tmp_path / "events"), by_source=True)).collect()


def test_ingest_keeps_a_finished_table_of_the_same_logs(spark, tmp_path):
    table, path = str(tmp_path / "events"), log_file(tmp_path, "a.csv.gz", LINES)
    first = ingest_events(spark, path, table)
    assert profile.row_count(first).first().total_rows == 2
    assert first.columns == EVENT_SCHEMA.names
    log_file(tmp_path, "a.csv.gz", LINES * 3)
    assert profile.row_count(ingest_events(spark, path, table)).first().total_rows == 2
    with pytest.raises(ValueError):
        ingest_events(spark, log_file(tmp_path, "b.csv.gz", LINES), table)


def test_a_log_written_anew_is_told(spark, tmp_path, recwarn):
    table, path = str(tmp_path / "events"), log_file(tmp_path, "a.csv.gz", LINES)
    ingest_events(spark, path, table)
    ingest_events(spark, path, table)
    assert not [w for w in recwarn if "changed after" in str(w.message)]
    log_file(tmp_path, "a.csv.gz", LINES * 3)
    with pytest.warns(UserWarning, match="a.csv.gz.*changed after"):
        assert profile.row_count(ingest_events(spark, path, table)).first().total_rows == 2


@pytest.mark.parametrize("mark", ["_SUCCESS", "_sources/_SUCCESS"])
def test_unfinished_tables_are_ingested_again(spark, tmp_path, mark):
    table, path = tmp_path / "events", log_file(tmp_path, "a.csv.gz", LINES)
    ingest_events(spark, path, str(table))
    (table / "_sources" / "_SUCCESS").unlink()
    if mark == "_SUCCESS":
        (table / mark).unlink()
    log_file(tmp_path, "a.csv.gz", LINES * 3)
    assert ingest_events(spark, path, str(table)).count() == 6


def test_ingested_events_are_those_written(spark, tmp_path):
    ev = canonical_events(spark, f"{TESTDATA}/sf0.001")
    write_log(ev, str(tmp_path / "log"))
    columns = [c for c in EVENT_SCHEMA.names if c != "event_id"]
    got = ingest_events(spark, str(tmp_path / "log"), str(tmp_path / "events")).select(columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, ev.select(columns).collect()))


def test_ingest_after_a_failed_one(spark, tmp_path):
    table = str(tmp_path / "events")
    bad = log_file(tmp_path, "bad.csv.gz", [*LINES, "yesterday,view,1,,,,x,5,aa"])
    with pytest.raises(Exception):
        ingest_events(spark, bad, table)
    events = ingest_events(spark, log_file(tmp_path, "good.csv.gz", LINES), table)
    assert events.count() == 2


def test_ingest_by_day_prunes(spark, tmp_path):
    later = [line.replace("12-01", "12-02") for line in LINES]
    events = ingest_events(
        spark, log_file(tmp_path, "a.csv.gz", LINES + later), str(tmp_path / "events"), by_day=True
    )
    day = events.where("event_date = date'2019-12-02'")
    assert day.count() == 2
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_log_round_trip(spark, tmp_path, edge_events):
    write_log(edge_events, str(tmp_path / "log"))
    back = read_log(spark, str(tmp_path / "log"))
    columns = [c for c in EVENT_SCHEMA.names if c != "event_id"]
    assert sorted(back.select(columns).collect(), key=repr) == sorted(
        edge_events.select(columns).collect(), key=repr
    )
    assert back.count() == len(EDGE_ROWS)


def test_staging_uses_the_shared_folder(spark):
    assert Staging(spark).root.startswith(spark.conf.get(CHECKPOINT_DIR))


def test_staging_keeps_empty_frames(spark, staging):
    empty = spark.range(0).withColumn("open", F.lit(True))
    assert staging.save(empty, "empty", partition_by="open").count() == 0


def test_staging_removes_what_it_wrote(spark):
    with Staging(spark) as staging:
        first, second = (staging.save(spark.range(n), "same") for n in (1, 2))
        assert (first.count(), second.count()) == (1, 2)
        root = staging.root
    assert not os.path.exists(root)
