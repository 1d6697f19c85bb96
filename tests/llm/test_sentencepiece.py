import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from stagepath.llm import sentencepiece_bpe as bpe
from tests.conftest import TESTDATA
from tests.llm.helpers import make_docs, with_clashes

PATH = public_tokenizers.path(bpe.MODEL)
REFERENCE = sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.load(PATH))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abtheing  \n▁é漢😀ŕ\x00.0Sq", max_size=30), max_size=6))
def test_ids_are_the_library_s(encoder, texts):
    found = list(encoder.encode(texts))
    assert [ids.tolist() for ids in found] == [REFERENCE.encode(text) for text in texts]
    assert [encoder.decode(ids) for ids in found] == [text.replace(bpe.MARK, " ") for text in texts]


@pytest.mark.parametrize("end", ["", "x", "漢", " the"])
def test_runs_of_blanks(encoder, end):
    texts = [" " * n + end for n in range(70)]
    assert [ids.tolist() for ids in encoder.encode(texts)] == [REFERENCE.encode(text) for text in texts]


def test_long_words_and_a_full_cache(encoder, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_SEGMENTS", 2)
    for text in ("antidisestablishmentarianism" * 200, "a b c d", "x" * 3000, "a b"):
        assert next(encoder.encode([text])).tolist() == REFERENCE.encode(text)


def test_suffix_array_finds_every_occurrence():
    codes = np.random.default_rng(1).integers(1, 4, 500).astype(np.uint16)
    index = bpe.SuffixArray(codes)
    pieces = np.zeros((30, bpe.LONGEST), np.uint16)
    lengths = np.arange(30) % 6 + 1
    for i, n in enumerate(lengths):
        pieces[i, :n] = codes[i * 7 : i * 7 + n]
    low, high = index.find(pieces, lengths)
    for i, n in enumerate(lengths):
        places = [p for p in range(500 - n + 1) if (codes[p : p + n] == pieces[i, :n]).all()]
        assert sorted(index.order[low[i] : high[i]].tolist()) == places


def test_whole_tables(spark):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.encode_documents(with_clashes(docs), PATH).collect():
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == REFERENCE.encode(texts[r.doc_id])
        assert r.decoded == texts[r.doc_id]


def test_odd_rows(spark):
    docs = make_docs(spark, [None, "", "tie", "tie"], ids=[None, 1, 2, 2])
    rows = bpe.encode_documents(docs, PATH).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.decoded) for r in rows) == [
        (False, 1, 0, ""), (False, 2, 1, "tie"), (False, 2, 1, "tie"), (True, 0, 0, "")]
    assert bpe.encode_documents(make_docs(spark, []), PATH).collect() == []
