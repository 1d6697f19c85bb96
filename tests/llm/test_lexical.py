import random

import numpy as np

from stagepath.llm import lexical
from stagepath.llm.checks_sql import LEXICAL_SEARCH
from tests.llm.helpers import as_set, make_docs, oracle_rows, with_clashes

ITEMS = "item_id long, text string"


def rows_of(spark, staging, docs, items, top=10):
    return [r.asDict() for r in lexical.search(docs, items, staging, top).collect()]


def both(spark, staging, docs, items):
    found = rows_of(spark, staging, docs, items)
    wanted = oracle_rows(LEXICAL_SEARCH, {"documents": docs.toPandas(), "benchmark": items.toPandas()})
    assert as_set(found) == as_set(wanted)
    return found


def test_terms_are_runs_of_letters_digits_and_other_than_ascii():
    assert lexical.term_counts("Aa aa-AA x1_É é b".encode()) == {
        b"aa": 3, b"x1": 1, "É".encode(): 1, "é b".encode(): 1
    }
    assert not lexical.term_counts(None) and not lexical.term_counts(b" -- ")


def test_long_texts_are_taken_in_parts(monkeypatch):
    text = " ".join(random.Random(2).choices(["ab", "c", "ddd"], k=4000)).encode()
    whole = lexical.term_counts(text)
    monkeypatch.setattr(lexical.parts, "__defaults__", (64,))
    assert lexical.term_counts(text) == whole


def test_masks_group_documents_by_their_terms():
    rng = np.random.default_rng(3)
    for terms in (1, 7, 64, 70, 130):
        present = rng.random((terms, 53)) < 0.1
        masks, group = lexical.presence_masks(np.packbits(present, axis=1), 53)
        assert (masks[group].T.astype(bool) == present).all()
        assert len({m.tobytes() for m in masks}) == len(masks)


def test_search_stops_early_and_is_whole(spark, staging):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 80))) for _ in range(400)]
    found = both(
        spark, staging, make_docs(spark, texts),
        spark.createDataFrame([(i, " ".join(rng.choices(words, k=6))) for i in range(12)], ITEMS),
    )
    assert len(found) == 120


def test_masks_that_cannot_win_are_not_scored():
    """One holder of a rare term, many of a frequent one: the many are left out."""
    n = 500
    docs, lengths = np.arange(n), np.full(n, 10)
    terms = np.concatenate([np.zeros(n, int), np.ones(20, int)])
    owner = np.concatenate([np.arange(n), np.arange(20)])
    order = np.lexsort((terms, owner))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
    block = lexical.Block(
        docs, lengths, offsets, terms[order], np.ones(len(terms), int),
        lexical.Corpus(n, 10 * n), np.array([0, 3000]),
    )
    best = lexical.Best(10)
    assert block.search(np.array([0, 1]), best) == 20
    assert best.docs.tolist() == list(range(10))


def test_nulls_ties_repeats_and_clashing_columns(spark, staging):
    texts = ["same words here", "same words here", "Same WORDS here!", None, "", "...", "other é"] * 3
    ids = [5, 5, 3, 4, 6, None, None] * 3
    docs = with_clashes(make_docs(spark, texts, ids=ids))
    items = spark.createDataFrame(
        [(1, "words same"), (1, "here"), (2, None), (3, ""), (4, "absent"), (5, "É é"), (None, "other")],
        ITEMS,
    )
    found = rows_of(spark, staging, docs, items)
    first = [(r["rank"], r["doc_id"]) for r in found if r["item_id"] == 1]
    assert sorted(first) == [(i + 1, d) for i, d in enumerate([3] * 3 + [5] * 6)]
    assert {r["item_id"] for r in found} == {1, 5, None}


def test_every_part_of_an_empty_table_is_empty(spark, staging):
    empty, items = make_docs(spark, []), spark.createDataFrame([(1, "a")], ITEMS)
    assert rows_of(spark, staging, empty, items) == []
    assert rows_of(spark, staging, make_docs(spark, ["a"]), items.limit(0)) == []


def test_blocks_of_items_give_the_same_rows(spark, staging, monkeypatch):
    docs = make_docs(spark, [f"a b{i % 3} c{i % 5} d{i}" for i in range(40)])
    items = spark.createDataFrame([(i, f"a b{i} c{i} d{i}") for i in range(8)], ITEMS)
    whole = rows_of(spark, staging, docs, items)
    monkeypatch.setattr(lexical, "BLOCK_PAIRS", 16)
    monkeypatch.setattr(lexical, "CELLS", 20)
    assert as_set(rows_of(spark, staging, docs, items)) == as_set(whole)
