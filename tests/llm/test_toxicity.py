import random
import zlib

import numpy as np
import pytest

from stagepath.llm import toxicity as tox
from tests.llm.helpers import make_docs, with_clashes

LABELS = "doc_id long, quality int, toxic int"


def small_network():
    words = [b"alpha", b"beta", b"gamma", b"\xc3\xa9t\xc3\xa9", b"x"]
    own = {b"alpha": 1, b"x": 2}
    network = tox.new_network(3, seed=1)
    random = np.random.default_rng(2)
    network["words"][1:] = random.standard_normal((2, tox.EMBEDDED))
    network["trigrams"][:] = random.standard_normal(network["trigrams"].shape) * 0.5
    return {k: v.astype(np.float64) for k, v in network.items()}, words, own


def plain_odds(network, vectors, window):
    """The log odds of one window, word by word."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    h = tox.HIDDEN

    def states(way, order):
        state, out = np.zeros(h), {}
        for at in order:
            x = vectors[window[at]] @ network[f"{way}_in"] + network[f"{way}_bias"]
            u = network[f"{way}_state"]
            z = sig(x[:h] + state @ u[:, :h])
            r = sig(x[h : 2 * h] + state @ u[:, h : 2 * h])
            n = np.tanh(x[2 * h :] + r * (state @ u[:, 2 * h :]))
            state = (1 - z) * n + z * state
            out[at] = state
        return out

    ahead, back = states("ahead", range(len(window))), states("back", reversed(range(len(window))))
    both = np.array([np.concatenate([ahead[i], back[i]]) for i in range(len(window))])
    height = np.tanh(both @ network["attend"] + network["attend_bias"]) @ network["focus"]
    weight = np.exp(height) / np.exp(height).sum()
    return (weight @ both) @ network["out"] + network["out_bias"][0]


def test_windows_of_unlike_length_match_the_plain_form():
    network, words, own = small_network()
    vectors = tox.embed(network, tox.word_inputs(words, own))
    windows = [[0, 1, 2, 3, 4, 0], [3, 3], [4]]
    table = np.array([w + [0] * (6 - len(w)) for w in windows])
    real = np.array([[i < len(w) for i in range(6)] for w in windows])
    found = tox.logits(network, tox.enter(network, vectors), table, real)
    assert np.allclose(found, [plain_odds(network, vectors, w) for w in windows], atol=1e-4)


def test_word_vectors_are_of_the_word_and_its_runs_of_three():
    _, words, own = small_network()
    rows, trigrams, counts = tox.word_inputs(words, own)
    assert rows.tolist() == [1, 0, 0, 0, 2] and counts.tolist() == [5, 4, 5, 5, 1]
    assert len(trigrams) == 20
    again = tox.word_inputs([b"alphabet"], own)[1]
    assert trigrams[:4].tolist() == again[:4].tolist()


def test_slopes_match_differences():
    network, words, own = small_network()
    inputs = tox.word_inputs(words, own)
    table = np.array([[0, 1, 2, 3], [4, 2, 0, 0], [3, 0, 0, 0]])
    real = np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 0, 0, 0]], bool)
    toxic = np.array([1.0, 0.0, 1.0])
    _, slope = tox.gradients(network, inputs, table, real, toxic)
    random = np.random.default_rng(3)
    for name, value in network.items():
        touched = np.flatnonzero(slope[name].reshape(-1))
        for at in random.choice(touched, min(4, len(touched)), replace=False):
            where, step = np.unravel_index(at, value.shape), 1e-2
            value[where] += step
            above, _ = tox.gradients(network, inputs, table, real, toxic)
            value[where] -= 2 * step
            below, _ = tox.gradients(network, inputs, table, real, toxic)
            value[where] += step
            assert slope[name][where] == pytest.approx((above - below) / (2 * step), rel=0.05, abs=2e-4), name


def test_every_window_of_a_long_text_counts():
    network, words, own = small_network()
    network = {k: v.astype(np.float32) for k, v in network.items()}
    scorer = tox.Scorer(tox.Fitted(network, own, 0.5))
    rng = random.Random(4)
    sequence = [rng.choice(words) for _ in range(333)]
    vectors = tox.embed(network, tox.word_inputs(words, own))
    ends = [*range(0, 333 - tox.WINDOW, tox.STRIDE), 333 - tox.WINDOW]
    plain = max(
        plain_odds(network, vectors, [words.index(w) for w in sequence[e : e + tox.WINDOW]]) for e in ends
    )
    found = scorer.scores([b"; ".join(sequence), b"", None, b"beta"])
    assert found[0] == pytest.approx(1 / (1 + np.exp(-plain)), abs=1e-4)
    assert found[1] == found[2] == 0.5


def made(spark, n=260, seed=3):
    rng = random.Random(seed)
    texts, toxic = [], []
    for i in range(n):
        words = [rng.choice("the of and river stone walk light".split()) + rng.choice(["", "s", "ed"]) for _ in range(rng.randrange(20, 120))]
        bad = i % 3 == 0
        if bad:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["vilest", "zonked", "zonker", "zonking"])
        texts.append(" ".join(words))
        toxic.append(int(bad))
    return texts, toxic


def test_held_out_documents_are_told_apart_and_their_labels_not_used(spark, staging):
    texts, toxic = made(spark)
    docs = with_clashes(make_docs(spark, texts + [None, "", texts[0]], ids=[*range(len(texts)), 900, 901, None]))
    out = [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(len(texts))]
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(None, 1, 1), (7, 1, None)], LABELS)
    turned = spark.createDataFrame([(i, 1, 1 - t if o else t) for i, (t, o) in enumerate(zip(toxic, out))], LABELS)
    rows = {r.doc_id: r for r in tox.score(docs, labels, staging, steps=150).collect()}
    assert len(rows) == len(texts) + 3
    assert [rows[i].held_out for i in range(len(texts))] == out and rows[None].held_out is False
    right = [rows[i].predicted == toxic[i] for i in range(len(texts)) if out[i]]
    assert sum(right) >= 0.95 * len(right)
    assert rows[900].score == rows[901].score == pytest.approx(
        np.mean([t for t, o in zip(toxic, out) if not o])
    )
    assert rows[None].score == pytest.approx(rows[0].score, abs=1e-5)
    again = {r.doc_id: r.score for r in tox.score(docs, turned, staging, steps=150).collect()}
    assert all(again[i] == pytest.approx(rows[i].score, abs=1e-3) for i in rows)


def test_without_both_classes_the_share_is_the_score(spark, staging):
    docs = make_docs(spark, ["a b", None, "c"])
    one = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], LABELS)
    assert {r.score for r in tox.score(docs, one, staging).collect()} == {0.0}
    assert {r.score for r in tox.score(docs, one.limit(0), staging).collect()} == {0.0}
    assert tox.score(make_docs(spark, []), one, staging).collect() == []


def test_bounds_of_the_sample_hold(spark, staging, monkeypatch):
    texts, toxic = made(spark, 60)
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], LABELS)
    seen = {}
    monkeypatch.setattr(tox, "fit", lambda windows, owners, toxic, share, steps: seen.update(n=len(windows), docs=len(set(owners)), toxic=toxic))
    tox.fit_on_sample(make_docs(spark, texts * 2, ids=[*range(60)] * 2), labels, staging, toxic=5, clean=9, windows=3)
    assert seen["docs"] == 14 and seen["n"] <= 42 and set(seen["toxic"]) == {0, 1}
