import zlib

from stagepath.llm.sharding import contiguous_shards
from tests.llm.helpers import make_docs, with_clashes


def rows(spark, staging, texts, **options):
    ids = options.pop("ids", None)
    return contiguous_shards(with_clashes(make_docs(spark, texts, ids=ids)), staging, **options).collect()


def test_shards_are_contiguous_gapless_and_near_equal(spark, staging):
    texts = ["é" * (i * 7 % 50) for i in range(400)]
    found = sorted(rows(spark, staging, texts), key=lambda r: r.doc_id)
    assert [r.doc_id for r in found] == list(range(400))
    assert [r["shard"] for r in found] == sorted(r["shard"] for r in found)
    totals = {}
    for r in found:
        assert r["size"] == len(texts[r.doc_id].encode()) + 1
        assert r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        total, slots = totals.setdefault(r["shard"], [0, []])
        totals[r["shard"]][0] = total + r["size"]
        slots.append(r["slot"])
    assert all(slots == list(range(len(slots))) for _, slots in totals.values())
    sizes = [total for total, _ in totals.values()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 2 * 101


def test_nulls_repeats_and_one_hot_key(spark, staging):
    found = rows(spark, staging, [None, "a", "a", ""] + ["x"] * 60, ids=[None, 1, 1, 2] + [7] * 60, shards=4)
    assert len(found) == 64
    assert {r["size"] for r in found} == {1, 2}
    assert len({(r["shard"], r["slot"]) for r in found}) == 64
    assert min(found, key=lambda r: (r["shard"], r["slot"])).doc_id is None


def test_empty_and_tiny_tables(spark, staging):
    assert rows(spark, staging, []) == []
    assert [(r["shard"], r["slot"]) for r in rows(spark, staging, ["only"], shards=2)] == [(1, 0)]
