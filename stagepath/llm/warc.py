"""WARC archives: records written with revisits, read back and put together by capture."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stagepath.llm.common import ship_code

# Fixed values of the format.
VERSION = "WARC/1.1"
CRLF = "\r\n"
IDENTICAL_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORD_SCHEMA = (
    "record_type string, record_id string, concurrent_to string, refers_to string,"
    " target_uri string, date string, payload_digest string, payload_bytes long,"
    " fields map<string, string>, block binary"
)
READ_BYTES = 1 << 20
#: Payload bytes of an archive at most, unless one page has more, and what counts as a small page.
ARCHIVE_BYTES, SMALL_PAGE = 1 << 29, 1 << 16


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column, by five hexadecimal digits a time."""
    digest = F.sha1(data)
    letters = []
    for at in range(0, 40, 5):
        bits = F.conv(F.substring(digest, at + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            place = F.shiftright(bits, shift).bitwiseAND(31) + 1
            letters.append(F.lit(BASE32).substr(place, F.lit(1)))
    return F.concat(*letters)


def _urn(*parts: Column) -> Column:
    name = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(name, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(fields: list[tuple[str, Column]], block: Column) -> Column:
    head = [F.lit(VERSION + CRLF)]
    for name, value in fields:
        head += [F.lit(f"{name}: "), value, F.lit(CRLF)]
    length = F.octet_length(block).cast("string")
    return F.concat(*head, F.lit("Content-Length: "), length, F.lit(CRLF + CRLF), block)


def captures(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Each page's payload and whether it is stored or revisits an equal one.

    Of equal payloads of at least `min_bytes` bytes the one with the largest page_id
    is stored (of full repeats the last read), the others revisit it; shorter
    payloads are all stored. NULL html is an empty payload; a NULL page_id counts as
    the smallest. Equal means equal SHA-1 and length. Only the largest id per payload
    is gathered, so a payload that many pages share costs one row a task; the
    join that follows can be split.
    """
    paged = pages.select(
        "page_id", "url", F.coalesce("html", F.lit("")).alias("payload")
    ).withColumns(
        {
            "payload_digest": base32_sha1(F.col("payload").cast("binary")),
            "payload_bytes": F.octet_length("payload").cast("long"),
            "_seen": F.monotonically_increasing_id(),
        }
    )
    key = ["payload_digest", "payload_bytes"]
    stored = paged.groupBy(*key).agg(F.max(F.struct("page_id", "_seen")).alias("_stored"))
    is_stored = (F.col("payload_bytes") < min_bytes) | (F.col("_stored._seen") == F.col("_seen"))
    return paged.join(stored, key).select(
        *paged.columns,
        F.when(is_stored, "response").otherwise("revisit").alias("record_type"),
        F.when(~is_stored, F.col("_stored")).alias("_stored"),
    )


def records(captured: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """The request, the response or revisit, and the metadata record of each capture, as text.

    Control characters and blanks in a URL become %20; a NULL URL is about:blank.
    """
    uri = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"), F.lit("about:blank"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))

    def name(kind: str, page_id: str = "page_id", seen: str = "_seen") -> Column:
        return _urn(F.lit(kind), F.col("payload_digest"), F.col(page_id), F.col(seen))

    response = name("capture")
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", uri)]

    def fields(kind: Column, record_id: Column, content: str) -> list[tuple[str, Column]]:
        return [("WARC-Type", kind), ("WARC-Record-ID", record_id), *common,
                ("Content-Type", F.lit(content))]

    beside = [("WARC-Concurrent-To", response)]
    digest = [("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest")))]
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(CRLF + CRLF),
    )
    http_type = "application/http; msgtype="
    request = _record(
        fields(F.lit("request"), name("request"), http_type + "request") + beside,
        F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{CRLF}{CRLF}")),
    )
    stored = _record(
        fields(F.lit("response"), response, http_type + "response") + digest,
        F.concat(http, F.col("payload")),
    )
    revisit = _record(
        fields(F.lit("revisit"), response, http_type + "response")
        + digest
        + [
            ("WARC-Refers-To", name("capture", "_stored.page_id", "_stored._seen")),
            ("WARC-Profile", F.lit(IDENTICAL_PAYLOAD)),
        ],
        http,
    )
    metadata = _record(
        fields(F.lit("metadata"), name("metadata"), "application/warc-fields") + beside,
        F.concat(F.lit("page-id: "), page, F.lit(CRLF)),
    )
    capture = F.when(F.col("record_type") == "response", stored).otherwise(revisit)
    return captured.select(F.explode(F.array(request, capture, metadata)).alias("value"))


def write_archives(found: DataFrame, path: str, records_per_file: int = 6000) -> None:
    """Writes records as gzipped archives through Spark's committer.

    Every record ends in two line ends, so the text writer with that as its line
    separator writes an archive as the format asks for.
    """
    (
        found.write.option("lineSep", CRLF + CRLF)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_file)
        .text(path)
    )


def write_pages(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Writes the records of all pages as archives of at most about ARCHIVE_BYTES, in folders under `path`.

    Pages up to SMALL_PAGE bytes go together, longer ones with those of up to twice their size,
    so that a number of records bounds the bytes of an archive. Equal payloads are of
    one size, so revisits and what they refer to stay together.
    """
    size = F.greatest(F.octet_length(F.coalesce("html", F.lit(""))), F.lit(SMALL_PAGE))
    power = F.ceil(F.log2(size.cast("double"))).cast("int")
    found = sorted(row.power for row in pages.select(power.alias("power")).distinct().collect())
    for each in found:
        some = pages if len(found) == 1 else pages.where(power == each)
        # A page makes three records, of which one holds it.
        most = max(1, ARCHIVE_BYTES // (1 << each))
        write_archives(records(captures(some, min_bytes)), f"{path}/{each}", min(6000, 3 * most))
    if not found:
        write_archives(records(captures(pages, min_bytes)), f"{path}/none")


class _Unzipped:
    """Reads an archive, gzipped as a whole, by record, or not at all, a part at a time."""

    def __init__(self, data: bytes):
        self.data, self.at, self.have, self.left = memoryview(data), 0, bytearray(), b""
        self.gzip = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.gzip is None or self.gzip.eof:
            if self.gzip is not None:
                self.left, self.gzip = self.gzip.unused_data, zlib.decompressobj(31)
        part = self.left or bytes(self.data[self.at : self.at + READ_BYTES])
        if not self.left:
            self.at += len(part)
        self.left = b""
        if not part:
            return False
        if self.gzip is None:
            self.have += part
        else:
            self.have += self.gzip.decompress(part, 4 * READ_BYTES)
            self.left = self.gzip.unconsumed_tail
        return True

    def read(self, size: int) -> bytes:
        while len(self.have) < size and self._more():
            pass
        if len(self.have) < size:
            raise ValueError("an archive ends within a record")
        out = bytes(self.have[:size])
        del self.have[:size]
        return out

    def head(self) -> bytes | None:
        """Up to the next empty line; None at the end."""
        end, seen = -1, 0
        while (end := self.have.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(self.have)
            if not self._more():
                if self.have.strip():
                    raise ValueError("an archive ends within a header")
                return None
        return self.read(end + 4)[:-4]


def _fields(lines: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in lines.decode("utf-8", "replace").split(CRLF))
    return {name.strip().lower(): value.strip() for name, sep, value in pairs if sep}


def parse_archive(data: bytes, blocks: bool = True) -> Iterator[dict]:
    """The records of one archive; `blocks` False leaves out all but their measures."""
    source = _Unzipped(data)
    while (head := source.head()) is not None:
        version, _, rest = head.lstrip().partition(b"\r\n")
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no record starts at {version[:40]!r}")
        field = _fields(rest)
        block = source.read(int(field["content-length"]))
        source.read(4)
        payload = block.partition(b"\r\n\r\n")[2] if "http" in field.get("content-type", "") else block
        kind = field["warc-type"]
        given = field.get("warc-payload-digest", "").removeprefix("sha1:") or None
        measured = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if kind == "response" and given not in (None, measured):
            raise ValueError(f"the payload of {field['warc-record-id']} is damaged")
        yield {
            "record_type": kind,
            "record_id": field["warc-record-id"],
            "concurrent_to": field.get("warc-concurrent-to"),
            "refers_to": field.get("warc-refers-to"),
            "target_uri": field.get("warc-target-uri"),
            "date": field.get("warc-date"),
            "payload_digest": measured if kind == "response" else given,
            "payload_bytes": len(payload) if kind == "response" else None,
            "fields": list(_fields(block).items()) if kind == "metadata" else None,
            "block": block if blocks else None,
        }


def read_archives(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """One row per record of the archives under `path`, on any store that Spark reads.

    An archive is one task's work and must be below 2 GB as stored; it is unzipped
    a part at a time. A damaged or cut archive fails the read.
    """
    kind = pa.schema(
        [(c, pa.string()) for c in ("record_type", "record_id", "concurrent_to", "refers_to",
                                    "target_uri", "date", "payload_digest")]
        + [("payload_bytes", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())),
           ("block", pa.binary())]
    )

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for row in parse_archive(data.as_py(), blocks):
                    rows.append(row)
                    size += len(row["block"] or b"") + 500
                    if size > 16 * READ_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, kind)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, kind)

    ship_code(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    files = files.select("content")
    return files.mapInArrow(parse, RECORD_SCHEMA)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit, its request and its metadata.

    Requests and metadata name their capture in WARC-Concurrent-To. Records that name
    none, or one that is not there, make rows of their own without a response. Of
    several requests the one with the smallest id is taken; all metadata are kept,
    in the order of their ids.
    """
    is_capture = F.col("record_type").isin("response", "revisit")
    capture_id = F.when(is_capture, F.col("record_id")).otherwise(
        F.coalesce("concurrent_to", "record_id")
    )
    record = F.struct("record_id", *[c for c in found.columns if c != "record_id"])

    def of(kind: Column) -> Column:
        return F.when(kind, record)

    return (
        found.groupBy(capture_id.alias("capture_id"))
        .agg(
            F.min_by(of(is_capture), F.when(is_capture, F.col("record_id"))).alias("response"),
            F.min_by(
                of(F.col("record_type") == "request"),
                F.when(F.col("record_type") == "request", F.col("record_id")),
            ).alias("request"),
            F.collect_list(of(F.col("record_type") == "metadata")).alias("metadata"),
        )
        .withColumn(
            "metadata",
            F.array_sort("metadata", lambda a, b: F.when(a.record_id < b.record_id, -1)
                         .when(a.record_id > b.record_id, 1).otherwise(0)),
        )
    )


def resolve_revisits(assembled: DataFrame) -> DataFrame:
    """Captures with `stored`, the capture that a revisit refers to, NULL for responses.

    Of a capture referred to, only its id, its size and its first metadata fields are carried over.
    """
    stored = assembled.where(F.col("response.record_type") == "response").select(
        F.col("capture_id").alias("_id"),
        F.struct(
            "capture_id",
            F.col("response.payload_bytes").alias("payload_bytes"),
            F.get("metadata", F.lit(0))["fields"].alias("fields"),
        ).alias("stored"),
    )
    revisits = F.col("response.record_type").eqNullSafe("revisit")
    # Others refer to nothing: joined, they would meet in the one task of NULL.
    return (
        assembled.where(revisits)
        .join(stored, F.col("response.refers_to") == F.col("_id"), "left")
        .drop("_id")
        .unionByName(assembled.where(~revisits), allowMissingColumns=True)
    )
