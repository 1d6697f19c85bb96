import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stagepath.llm import fingerprints as fp
from tests.llm.helpers import make_docs, with_clashes


def plain_signature(text, k, length, size):
    """Order MinHash step by step, over the same k-mer hashes and orders."""
    points = fp.code_points(text)
    kmers = [int(x) for x in fp.kmer_hashes(points, k)]
    if not kmers:
        return [0] * size
    seen, elements = {}, []
    for at, kmer in enumerate(kmers):
        number = seen[kmer] = seen.get(kmer, -1) + 1
        mixed = int(fp._mix(np.array([kmer + (number << 32)], np.uint64))[0]) >> 32
        elements.append((mixed, kmer, number, at))
    out = []
    for i in range(size):
        rank = lambda e: (((e[0] * int(fp._FACTORS[i])) & 0xFFFFFFFF) ^ int(fp._SHIFTS[i]), e[1], e[3])
        chosen = sorted(sorted(elements, key=rank)[:length], key=lambda e: e[3])
        value = np.full(1, 7, np.uint64)
        for e in chosen:
            value = fp._mix(value * np.uint64(5) + np.uint64(e[1]))
        out.append(int(value[0]) >> 32)
    return out


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab é\n", max_size=60))
def test_signature_matches_the_plain_form(text):
    assert fp.signature(text, 3, 2, 16).tolist() == plain_signature(text, 3, 2, 16)


def test_order_of_the_text_matters():
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    text = " ".join(words)
    turned = " ".join(words[200:] + words[:200])
    edited = " ".join(words[:390] + ["new"] * 10)
    mark = fp.signature(text)
    assert fp.likeness(mark, fp.signature(text)) == 1.0
    assert fp.likeness(mark, fp.signature(turned)) < fp.likeness(mark, fp.signature(edited))
    assert fp.likeness(mark, fp.signature(" ".join(f"v{rng.randrange(10**6)}" for _ in range(400)))) < 0.1


def test_long_texts_are_taken_in_blocks(monkeypatch):
    text = "".join(random.Random(1).choices("abcdef ", k=5000))
    whole = fp.signature(text)
    monkeypatch.setattr(fp, "BLOCK", 6000)
    assert (fp.signature(text) == whole).all()


def test_every_row_meets_the_next(spark, staging):
    texts = ["alpha " * i + str(i) for i in range(57)] + [None, "", "é"]
    ids = [(i * 37) % 60 for i in range(60)]
    found = {r.doc_id: r for r in fp.fingerprints(with_clashes(make_docs(spark, texts, ids=ids)), staging).collect()}
    by_id = dict(zip(ids, texts, strict=True))
    assert set(found) == set(range(60))
    for i in range(60):
        text, following = by_id[i] or "", by_id[(i + 1) % 60] or ""
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        r = found[i]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_next == fp.likeness(fp.signature(text), fp.signature(following))
        assert r.near_edited == fp.likeness(fp.signature(text), fp.signature(edited))
        assert bytes.fromhex(r.fingerprint) == fp.signature(text).astype(">u4").tobytes()


def test_null_and_repeated_ids(spark, staging):
    docs = make_docs(spark, ["a", "b", "c", "c", "c", "d"], ids=[None, None, 1, 1, 1, 2])
    found = fp.fingerprints(docs, staging).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in found if r.doc_id is not None) == [
        (False, 1)] * 3 + [(False, 2)]
    assert len(found) == 6 and len({r.fingerprint for r in found if r.doc_id == 1}) == 1


def test_one_row_and_none(spark, staging):
    assert fp.fingerprints(make_docs(spark, []), staging).collect() == []
    (row,) = fp.fingerprints(make_docs(spark, ["only one text here"]), staging).collect()
    assert row.near_next == 1.0
