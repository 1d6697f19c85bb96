import base64
import gzip
import hashlib

import pytest

from pyspark.sql import functions as F

from stagepath.llm import warc
from tests.conftest import settings
from tests.llm.helpers import with_clashes


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def capture_all(spark, staging, rows, label, **options):
    pages = with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string"))
    path = staging.path(label)
    warc.write_archives(warc.records(warc.captures(pages, **options)), path)
    return path, warc.resolve_revisits(staging.save(warc.assemble(warc.read_archives(spark, path)), f"{label}-c"))


def page_id(fields):
    return int(fields["page-id"]) if fields["page-id"] else None


def test_round_trip_with_revisits_and_odd_payloads(spark, staging):
    rows = [
        (1, "http://a/ b", "same"), (2, "http://a/\r\nX: y", "same"), (3, None, "same"),
        (4, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (5, "u", None), (6, "u", ""), (None, "u", "é漢 \0"),
    ]
    _, found = capture_all(spark, staging, rows, "odd")
    got = {page_id(r.metadata[0].fields): r for r in found.collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, None}
    for number, _, html in rows:
        r = got[number]
        assert r.response.payload_digest == digest(html)
        assert r.request.concurrent_to == r.response.record_id
        if r.response.record_type == "response":
            assert r.response.payload_bytes == len((html or "").encode())
            assert r.response.block.partition(b"\r\n\r\n")[2] == (html or "").encode()
    assert {k: r.response.record_type for k, r in got.items()} == {
        1: "revisit", 2: "revisit", 3: "response", 4: "response", 5: "revisit", 6: "response", None: "response",
    }
    assert page_id(got[1].stored.fields) == 3 and page_id(got[5].stored.fields) == 6


def test_repeated_rows_have_one_response(spark, staging):
    _, found = capture_all(spark, staging, [(1, "u", "x")] * 3 + [(1, "u", "y")], "repeated")
    kinds = sorted(r.response.record_type for r in found.collect())
    assert kinds == ["response", "response", "revisit", "revisit"]


def test_archives_are_cut_by_bytes(spark, staging, monkeypatch):
    """Pages of 5 MB among small ones: no archive holds more than the bound."""
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1 << 24)
    rows = [(i, "u", chr(97 + i) * 5_000_000) for i in range(5)] + [(i, "u", f"page {i % 90}") for i in range(5, 205)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = staging.path("large")
    warc.write_pages(pages, path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    sizes = [len(gzip.decompress(row.content)) for row in files.collect()]
    assert max(sizes) < (1 << 24) + 10_000 and len(sizes) >= 3
    found = warc.resolve_revisits(staging.save(warc.assemble(warc.read_archives(spark, path, blocks=False)), "large-c"))
    got = {page_id(r.metadata[0].fields): r.response for r in found.collect()}
    assert set(got) == {i for i, _, _ in rows}
    assert all(got[i].payload_digest == digest(html) for i, _, html in rows)
    assert sum(r.record_type == "response" for r in got.values()) == 95
    warc.write_pages(pages.limit(0), staging.path("no-pages"))


def test_responses_do_not_meet_in_one_task(spark, staging):
    rows = [(i, "u", f"page {i}") for i in range(400)] + [(1000 + i, "u", "same") for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = staging.path("spread")
    warc.write_pages(pages, path)
    assembled = staging.save(warc.assemble(warc.read_archives(spark, path)), "spread-c").repartition(8)
    with settings(spark, spark__sql__adaptive__enabled="false", spark__sql__autoBroadcastJoinThreshold="-1"):
        found = warc.resolve_revisits(assembled)
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 420 and max(sizes) < 120


def test_short_payloads_are_all_stored(spark, staging):
    _, found = capture_all(spark, staging, [(1, "u", "x"), (2, "u", "x")], "short", min_bytes=2)
    assert {r.response.record_type for r in found.collect()} == {"response"}


def test_empty_table(spark, staging):
    path = staging.path("none")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(warc.records(warc.captures(pages)), path)
    assert warc.assemble(warc.read_archives(spark, path)).collect() == []


def record(kind, number, block, **fields):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{number}>\r\n"
    head += "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items())
    return f"{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("pack", [bytes, gzip.compress, None], ids=["plain", "whole", "by-record"])
def test_reads_foreign_archives(pack):
    records = [record("warcinfo", 0, b"software: x\r\n"), record("resource", 1, b"z" * 3_000_000),
               record("metadata", 2, b"a: b\r\n", WARC_Concurrent_To="<1>")]
    data = pack(b"".join(records)) if pack else b"".join(map(gzip.compress, records))
    found = list(warc.parse_archive(data))
    assert [r["record_type"] for r in found] == ["warcinfo", "resource", "metadata"]
    assert len(found[1]["block"]) == 3_000_000 and found[2]["concurrent_to"] == "<1>"


@pytest.mark.parametrize("cut", [10, 60, -3])
def test_cut_archives_fail(cut):
    with pytest.raises(ValueError):
        list(warc.parse_archive(record("resource", 1, b"x" * 100)[:cut]))


def test_damaged_payload_fails():
    block = b"HTTP/1.1 200 OK\r\n\r\nx"
    data = record("response", 1, block, Content_Type="application/http", WARC_Payload_Digest="sha1:AAAA")
    with pytest.raises(ValueError):
        list(warc.parse_archive(data))


def test_orphans_stand_alone(spark):
    rows = [("request", "<q>", "<gone>"), ("metadata", "<m>", None)]
    found = spark.createDataFrame(rows, "record_type string, record_id string, concurrent_to string")
    got = {r.capture_id: r for r in warc.assemble(found).collect()}
    assert got["<gone>"].response is None and got["<gone>"].request.record_id == "<q>"
    assert [m.record_id for m in got["<m>"].metadata] == ["<m>"]
