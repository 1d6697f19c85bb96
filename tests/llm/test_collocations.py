import random
from collections import Counter

import numpy as np
import pytest

from stagepath.llm import collocations as col
from stagepath.llm.checks_sql import COLLOCATIONS
from tests.llm.helpers import as_set, make_docs, oracle_rows, with_clashes


def both(spark, staging, docs):
    found = [r.asDict() for r in col.collocations(docs, staging).collect()]
    assert as_set(found) == as_set(oracle_rows(COLLOCATIONS, {"documents": docs.toPandas()}))
    return found


def some_texts(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    passage = "Seven Words That always, stand in one row together here."
    texts = []
    for _ in range(n):
        body = [" ".join(rng.choices(words, weights=range(30, 0, -1), k=rng.randrange(0, 12))) for _ in range(4)]
        texts.append(rng.choice([". ", "\n", " ", ";\t "]).join([*body, passage if rng.random() < 0.4 else ""]))
    return texts


def test_edges_count_three_words_and_what_ends():
    (a, b, c), w = col.edges(np.array([1, 2, 1, 2, 0, 3, 0, 0, 1, 2, 1, 0]))
    found = Counter(dict(zip(zip(a.tolist(), b.tolist(), c.tolist()), w.tolist())))
    assert found == {(1, 2, 1): 2, (2, 1, 2): 1, (1, 2, 0): 1, (2, 0, 0): 1, (3, 0, 0): 1, (2, 1, 0): 1, (1, 0, 0): 1}


def test_sums_of_many_words_do_not_depend_on_their_numbers():
    rng = np.random.default_rng(4)
    keys = [rng.integers(0, 5, 200) for _ in range(3)]
    weight = rng.integers(1, 9, 200)
    small, sums = col.add_up(*keys, weight=weight)
    large, again = col.add_up(*(key + (1 << 21) for key in keys), weight=weight)
    assert (sums == again).all() and all((x + (1 << 21) == y).all() for x, y in zip(small, large))
    assert sums.sum() == weight.sum()


@pytest.mark.parametrize("held, hot", [(1 << 22, 200), (40, 200), (40, 0)])
def test_random_texts_match_the_sql(spark, staging, monkeypatch, held, hot):
    monkeypatch.setattr(col, "HELD_WORDS", held)
    monkeypatch.setattr(col, "HOT_WORDS", hot)
    texts = some_texts(250, 11) + [None, "", " . ", "é é É"]
    langs = [random.Random(i).choice(["en", "de", None]) for i in range(len(texts))]
    docs = make_docs(spark, texts, langs=langs).repartition(4)
    found = both(spark, staging, docs)
    assert {r["lang"] for r in found} == {"en", "de", "und"}


def test_a_passage_leaves_only_its_threes(spark, staging):
    found = both(spark, staging, make_docs(spark, ["one two three four five six."] * 12))
    phrases = {r["phrase"] for r in found}
    assert phrases == {"one two three", "two three four", "three four five", "four five six"}
    assert {(r["a"], r["l"], r["r"], r["n"], r["score"]) for r in found} == {(12, 12, 12, 72, 1000000)}


def test_a_phrase_stays_if_longer_ones_are_rare(spark, staging):
    docs = make_docs(spark, ["new york"] * 21 + ["new york city"] * 19 + ["old york"] * 2)
    assert "new york" in {r["phrase"] for r in both(spark, staging, docs)}
    docs = make_docs(spark, ["new york"] * 20 + ["new york city"] * 20)
    assert "new york" not in {r["phrase"] for r in both(spark, staging, docs)}


def test_large_products_stay_exact(spark):
    from pyspark.sql import functions as F

    a, left, right = 900_000_000_000_001, 900_000_000_000_011, 900_000_000_000_007
    row = spark.range(1).select(
        col._score(*(F.lit(x).cast("long") for x in (a, left, right))).alias("score")
    ).first()
    assert row.score == 1000000 * a * a // (left * right)


def test_paths_are_compacted_and_rings_are_left_apart(spark, staging):
    rows = [
        (1, "x", "a", "b", "c", 12, 12, 12), (2, "x", "b", "c", "d", 12, 12, 12),
        (3, "x", "c", "d", "e", 12, 12, 30), (4, "x", "d", "e", "f", 10, 30, 10),
        (5, "x", "p", "q", "p", 11, 11, 11), (6, "x", "q", "p", "q", 11, 11, 11),
    ]
    schema = "id long, lang string, a string, b string, c string, w long, from_flow long, to_flow long"
    paths, inside = col._paths(staging.save(spark.createDataFrame(rows, schema), "e"), staging)
    found = {(" ".join(r.words), r.w, r.from_flow, r.to_flow) for r in paths.collect()}
    assert found == {
        ("a b c d e", 12, 12, 30), ("d e f", 10, 30, 10), ("p q p", 11, 11, 11), ("q p q", 11, 11, 11)
    }
    assert {(r.a, r.b) for r in inside.collect()} == {("b", "c"), ("c", "d"), ("p", "q"), ("q", "p")}


def test_long_texts_are_taken_in_parts(monkeypatch):
    text = " ".join(some_texts(60, 3)).encode()
    whole = col.Graph()
    whole.add(text)
    monkeypatch.setattr(col.parts, "__defaults__", (50,))
    cut = col.Graph()
    cut.add(text)
    assert whole.sequence == cut.sequence


def test_empty_tables_and_clashing_columns(spark, staging):
    assert both(spark, staging, make_docs(spark, [])) == []
    assert both(spark, staging, make_docs(spark, [None, ""])) == []
    docs = with_clashes(make_docs(spark, ["a b"] * 10))
    assert [r.phrase for r in col.collocations(docs, staging).collect()] == ["a b"]
