"""The pipeline's stages, each against what is known of its own input."""

import random

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from stagepath.llm import jaccard, packing, tokens
from stagepath.staging import Staging
from tests.conftest import TESTDATA
from tests.llm.helpers import make_docs
from tests.llm.test_jaccard import Counting, grams, two_groups

SF_DIR = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """The rows before and after each stage."""
    staging = Staging(spark)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = staging.save(stage(spark, docs, SF_DIR), name)
        found.append((name, docs))
    return dict(found)


def texts(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_all_but_the_last_keep_the_columns(steps):
    columns = steps["documents"].dtypes
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert steps[name].dtypes == columns
        assert all(r.n_chars == len(r.text) for r in steps[name].collect())


def test_rules_and_classifier_keep_most_and_only_remove(steps):
    before, rules, good = (texts(steps[n]) for n in ("documents", "quality_rules", "quality_classifier"))
    assert set(good) <= set(rules) <= set(before)
    assert len(rules) > 0.8 * len(before) and len(good) > 0.8 * len(rules)
    assert all(len(text.split()) >= 25 for text in rules.values())


def test_one_of_each_group_stays(steps):
    before, after = texts(steps["quality_classifier"]), texts(steps["near_duplicates"])
    sets = {i: grams(text) for i, text in before.items()}

    def linked(a, b):
        both = len(sets[a] & sets[b])
        return both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both)

    assert not any(linked(a, b) for a in after for b in after if a < b)
    assert all(any(linked(i, j) for j in before if j < i) for i in set(before) - set(after))


def test_no_planted_secret_is_left(steps):
    before, after = texts(steps["near_duplicates"]), texts(steps["secret_scans"])
    assert set(before) == set(after)
    assert not any('token = "' in t and "[SECRET]" not in t for t in after.values())


def test_packs_what_is_left(steps):
    encoder = tokens.encoder(public_tokenizers.path(tokens.VOCABULARY))
    left = {}
    for r in sorted(steps["packing"].collect(), key=lambda r: r["start"]):
        left.setdefault(r.doc_id, []).append(np.frombuffer(bytes(r["ids"]), "<u4"))
    wanted = texts(steps["secret_scans"])
    assert set(left) == set(wanted)
    for doc_id, parts in left.items():
        assert np.concatenate(parts).tolist() == [*encoder.encode(wanted[doc_id]).tolist(), packing.END_ID]


def test_run_gives_the_last_stage(spark, steps):
    columns = ["doc_id", "start", "length", "ids_crc32"]
    found = corpus_pipeline.run(spark, SF_DIR).select(*columns).collect()
    assert sorted(found) == sorted(steps["packing"].select(*columns).collect())


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_and_empty_tables(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    odd = make_docs(spark, [None, "", "a b c", "a b c"], [None, "s", None, "s"], ids=[None, 1, 2, 2])
    stage(spark, odd, SF_DIR).collect()
    assert stage(spark, make_docs(spark, []), SF_DIR).collect() == []


def test_near_duplicates_pairs_grow_with_large_groups_and_not_with_their_square(spark, monkeypatch):
    """Of two large groups of near copies that share a passage one text each stays."""
    monkeypatch.setattr(jaccard, "COMMON", 4)
    counts = []
    for n in (30, 60):
        staging = Counting(spark)
        monkeypatch.setattr(corpus_pipeline, "held_staging", lambda _, held=staging: held)
        kept = corpus_pipeline.near_duplicates(spark, make_docs(spark, two_groups(random.Random(12), n)), SF_DIR)
        assert sorted(r.doc_id for r in kept.collect()) == [0, n + 1]
        counts.append(staging.pairs)
    assert counts[1] <= 2 * counts[0] + 40
