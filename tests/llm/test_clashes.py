"""Columns of other tables may have any name, also those that operators use inside."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stagepath.llm import classifier, common, jaccard, quality, secret_scan
from tests.llm.helpers import make_docs

TEXTS = [
    " ".join(f"word{i}x{j}" for j in range(60)) + f"\nshared line of the host\ntoken = \"{'a1B2' * 8}{i}\"" for i in range(24)
] + [None, "", "same words again " * 20, "same words again " * 20]
LABELS = "doc_id long, quality int, toxic int"


def stages_of(spark, staging):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], LABELS)
    return {
        "clean": lambda docs: quality.clean(docs, staging),
        "keep_good": lambda docs: classifier.keep_good(docs, labels, staging),
        "keep_one_of_each": lambda docs: jaccard.keep_one_of_each(docs, staging),
        "redact": lambda docs: secret_scan.redact(docs, staging),
    }


def inner_names(frame, docs):
    """The names of all columns in a stage's plan, of those that a table may have."""
    found = set(re.findall(r"\b([A-Za-z_]\w*)#\d+", frame._jdf.queryExecution().toString()))
    return sorted(name for name in found if name.lower() not in {c.lower() for c in docs.columns})


@pytest.mark.parametrize("stage", ["clean", "keep_good", "keep_one_of_each", "redact"])
def test_names_from_inside_a_stage_are_allowed_outside(spark, staging, stage):
    docs = make_docs(spark, TEXTS)
    run = stages_of(spark, staging)[stage]
    plain = run(docs)
    names = inner_names(plain, docs)
    assert names
    more = sorted({*names, "lines_to_remove", "_judged", "_row", "_values", "_found", "_kept", "_stay", "_rows",
                   "_all", "_new", "_text", "a.b"})
    found = run(docs.withColumns({name: F.lit(f"{name}!") for name in more}))
    assert found.columns == [*docs.columns, *more]
    rows = [row.asDict() for row in found.collect()]
    assert all(row[name] == f"{name}!" for row in rows for name in more)
    same = lambda rows: sorted(repr([row[c] for c in docs.columns]) for row in rows)
    assert same(rows) == same(row.asDict() for row in plain.collect())


def test_what_queries_write_is_removed(spark, tmp_path):
    held = common.held_staging(spark)
    held.save(spark.range(3), "some")
    common.clean()
    assert common._held == []
    with pytest.raises(Exception, match="(?i)path|file"):
        spark.read.parquet(f"{held.root}/some").count()


def test_every_stage_keeps_its_staging_for_cleaning():
    import inspect

    assert "Staging(" not in inspect.getsource(corpus_pipeline).replace("held_staging(", "")
