"""The end-to-end run over CSV logs."""

import random

import pytest

from stagepath.plans import report
from tests.conftest import at
from tests.test_sources import log_file


def lines(seed, n=400):
    rng = random.Random(seed)
    for _ in range(n):
        product = rng.randrange(30)
        time = at(rng.randrange(5000)).strftime("%Y-%m-%d %H:%M:%S UTC")
        kind = rng.choice(["view", "view", "view", "cart", "purchase"])
        category = rng.choice([*report.CATEGORIES, "a.b", ""])
        price = rng.choice(["", "0.00", "12.5", "99.0", "400.0"])
        session = rng.choice(["", *(f"s{i}" for i in range(40))])
        yield f"{time},{kind},{product},{product},{category},b{product % 3},{price},{seed},{session}"


def test_all_reports_from_csv(spark, tmp_path):
    logs = [log_file(tmp_path, f"{month}.csv.gz", lines(i)) for i, month in enumerate(["nov", "dec"])]
    reports = report.run(spark, logs, logs[1], str(tmp_path / "tables"))
    assert len(reports) == 39
    rows = {title: frame.collect() for title, frame in reports.items()}
    assert all(rows.values())
    assert rows["Rows"][0].total_rows == 400
    assert {r.source_file for r in rows["Events per file"]} == {"nov.csv.gz", "dec.csv.gz"}
    pairs = rows["Funnel"][0].view_count
    assert sum(r.view_count for r in rows["Price bands"]) == pairs
    # A second run over the same logs keeps the events, also for another month.
    again = report.run(spark, logs, "nov.csv.gz", str(tmp_path / "tables"))
    assert again["Rows"].first().total_rows == 400
    assert again["Events per file"].collect() == rows["Events per file"]
    fresh = report.run(spark, logs, logs[0], str(tmp_path / "other"))
    assert again["Funnel"].collect() == fresh["Funnel"].collect()
    # Other logs never meet these tables.
    with pytest.raises(ValueError):
        report.run(spark, logs[:1], logs[0], str(tmp_path / "tables"))
    with pytest.raises(ValueError):
        report.run(spark, logs, "jan.csv.gz", str(tmp_path / "tables"))


def test_given_baseline(spark, tmp_path):
    logs = [log_file(tmp_path, "dec.csv.gz", lines(1))]
    baseline = report.given_baseline(spark, 4.08, 1.73)
    reports = report.run(spark, logs, logs[0], str(tmp_path / "tables"), baseline)
    sizes = {r.uplift_pct: r.total_n for r in reports["Sample size by uplift"].collect()}
    assert sizes == {5: 301956, 10: 77248, 15: 35112}


def test_every_row_is_printed(spark, capsys):
    report.print_rows(spark.range(250))
    assert capsys.readouterr().out.split() == ["id", *map(str, range(250))]
