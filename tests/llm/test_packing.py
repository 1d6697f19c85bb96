import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stagepath.llm import packing, tokens
from tests.conftest import TESTDATA
from tests.llm.helpers import make_docs, with_clashes

REFERENCE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
REFERENCE.encode_special_tokens = True
ENCODER = tokens.encoder(public_tokenizers.path(tokens.VOCABULARY))


def reference(text):
    return REFERENCE.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab's'll1²½Ⅷ  é漢​\x1c\x85 \n\t\r,.!<|endoftext|>😀\x0b", max_size=40))
def test_chunks_give_the_ids_of_the_whole(text):
    assert ENCODER.encode(text).tolist() == reference(text)


def test_very_long_runs_give_the_ids_of_the_whole():
    blank = " " * 3000
    for text in (blank, f"a{blank}b", f"{blank}\n\n{blank}x y", "\t" * 1500 + "!" * 5000, f"é {blank}"):
        assert ENCODER.encode(text).tolist() == reference(text)
    assert len(ENCODER.encode(" " * 400_000 + "a" * 400_000)) > 0


def check_pieces(rows, texts):
    """Every id in one piece, in order; sequences gapless and within the window."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc_id, pieces in by_doc.items():
        ids, at = [*reference(texts[doc_id]), 1], 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["start"], r["doc_tokens"], bytes(r["ids"])) == (at, len(ids), part)
            assert r["ids_crc32"] == zlib.crc32(part)
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.WINDOW
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return len(by_sequence)


def test_packs_every_document(spark, staging):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = packing.pack(with_clashes(docs), staging).collect()
    n = check_pieces(rows, texts)
    assert sum(r["length"] for r in rows) > 0.97 * packing.WINDOW * (n - 1)


def test_odd_documents(spark, staging):
    texts = [None, "", "word " * 5000, "x" * 30_000, "tie", "tie"]
    check_pieces(packing.pack(make_docs(spark, texts), staging).collect(), dict(enumerate(texts)))
    with_ids = {(r.doc_id, r["start"]): r for r in packing.pack(make_docs(spark, texts), staging).collect()}
    for r in packing.pack(make_docs(spark, texts), staging, with_ids=False).collect():
        assert with_ids[r.doc_id, r["start"]].asDict() | {"ids": None} == r.asDict() | {"ids": None}
    repeated = packing.pack(make_docs(spark, ["a", "a"], ids=[1, 1]), staging).collect()
    assert [(r.doc_id, r.doc_tokens) for r in repeated] == [(1, 2)] * 2
    assert packing.pack(make_docs(spark, []), staging).collect() == []


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=8, max_size=8))
def test_plan_uses_no_more_than_there_is(counts):
    histogram = dict(enumerate(counts, 1))
    plan = packing.plan_windows(histogram, bins=8, depth=3)
    assert all(plan.taken[b] <= n for b, n in histogram.items())
    assert sum(b * n for b, n in plan.taken.items()) == 8 * plan.n_windows
    # What is left over fills no window by itself.
    left = {b: n - plan.taken[b] for b, n in histogram.items()}
    for way in packing.combinations(8, 3):
        assert any(left[b] < way.count(b) for b in way)


def test_least_squares_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a, b = rng.random((6, 15)), rng.random(6) * 10
        x = packing.non_negative_least_squares(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and (slope <= 1e-6).all() and abs(slope @ x) < 1e-6
