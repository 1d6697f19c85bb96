"""Order MinHash fingerprints, which near texts by edit distance share in part."""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagepath.llm.common import ship_code, shuffle_partitions
from stagepath.staging import Staging

KMER = 9
TUPLE = 2
SIZE = 64
BLOCK = 1 << 22
LOWEST = -(1 << 63)

_RANDOM = np.random.default_rng(20240)
_FACTORS = _RANDOM.integers(0, 1 << 31, 1024, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _RANDOM.integers(0, 1 << 32, 1024, dtype=np.uint32)

RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string,"
    " edited_fingerprint string, near_edited double, near_next double"
)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all 64 bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    return x * np.uint64(0xA0761D6478BD642F)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def kmer_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """A 32-bit hash of each run of k code points; of a shorter text, one of all of it."""
    if 0 < len(points) < k:
        points = np.concatenate([points, np.full(k - len(points), 0x110000, np.uint32)])
    power, size = _mix(points.astype(np.uint64) + np.uint64(1)), 1
    whole, have = None, 0
    while len(points) and have < k:
        if k & size:
            if whole is None:
                whole = power
            else:
                whole = _mix(whole[: len(whole) - size] * np.uint64(3) + power[have:])
            have += size
        if have < k:
            power = _mix(power[:-size] * np.uint64(3) + power[size:])
            size *= 2
    return (np.zeros(0, np.uint64) if whole is None else whole >> np.uint64(32)).astype(np.uint32)


def signature(text: str, k: int = KMER, length: int = TUPLE, size: int = SIZE) -> np.ndarray:
    """For each of `size` orders of the occurrence-numbered k-mers, a 32-bit hash of the
    `length` smallest, taken in the order in which they stand in the text.

    The n-th occurrence of a k-mer is an element of its own. A text shorter than k is
    one element; with fewer than `length` elements all are taken. The empty text has
    a signature of zeros.
    """
    hashes = kmer_hashes(code_points(text), k)
    n = len(hashes)
    if not n:
        return np.zeros(size, np.uint32)
    places = np.sort((hashes.astype(np.uint64) << np.uint64(32)) | np.arange(n, dtype=np.uint64))
    kmers = (places >> np.uint64(32)).astype(np.uint32)
    at = (places & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], kmers[1:] != kmers[:-1]]))
    number = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    element = _mix(kmers.astype(np.uint64) + (number.astype(np.uint64) << np.uint64(32)))
    element = (element >> np.uint64(32)).astype(np.uint32)

    out = np.empty(size, np.uint32)
    step = max(1, BLOCK // n)
    for low in range(0, size, step):
        rows = slice(low, min(size, low + step))
        order = element[None, :] * _FACTORS[rows, None]
        order ^= _SHIFTS[rows, None]
        chosen = np.empty((len(order), min(length, n)), np.int64)
        for j in range(chosen.shape[1]):
            chosen[:, j] = order.argmin(axis=1)
            order[np.arange(len(order)), chosen[:, j]] = 0xFFFFFFFF
        in_text = np.take_along_axis(chosen, at[chosen].argsort(axis=1, kind="stable"), axis=1)
        tuples = np.full(len(order), 7, np.uint64)
        for j in range(in_text.shape[1]):
            tuples = _mix(tuples * np.uint64(5) + kmers[in_text[:, j]])
        out[rows] = tuples >> np.uint64(32)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal places, between 0 and 1."""
    return float(np.mean(a == b))


def edited_text(text: str, following: str) -> str:
    """The text, the last half of which is replaced by the start of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _row(doc_id, text: str, mark: np.ndarray, following: str, next_mark: np.ndarray, sizes) -> dict:
    edited = edited_text(text, following)
    edited_mark = signature(edited, *sizes)
    return {
        "doc_id": doc_id,
        "n_chars": len(text),
        "edited_sha256": hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
        "fingerprint": mark.astype(">u4").tobytes().hex(),
        "edited_fingerprint": edited_mark.astype(">u4").tobytes().hex(),
        "near_edited": likeness(mark, edited_mark),
        "near_next": likeness(mark, next_mark),
    }


def fingerprints(
    docs: DataFrame, staging: Staging, k: int = KMER, length: int = TUPLE, size: int = SIZE
) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how near they are.

    Documents stand in the order of doc_id, NULL first; rows of one doc_id are ordered by
    a hash of their text, and full repeats are each other's next. The next of the last
    is the first; a single row is its own next. A NULL text is empty. Other
    columns are left aside, and an empty table gives no rows.

    Only keys are sorted to find where to cut the order into slices; the first row of a
    slice goes to the slice before it as well. The texts are then dealt out once, and
    each task goes through its slice row by row.
    """
    spark, n = docs.sparkSession, shuffle_partitions(docs.sparkSession)
    ship_code(spark)
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    key = [
        F.coalesce("doc_id", F.lit(LOWEST)).alias("_key"),
        F.xxhash64("text").alias("_hash"),
    ]
    keys = staging.save(texts.select(*key), "keys")
    slices = (
        keys.repartitionByRange(n, "_key", "_hash")
        .groupBy(F.spark_partition_id().alias("_slice"))
        .agg(F.min(F.struct("_key", "_hash")).alias("first"))
        .select("first.*")
    )
    # At most one key per partition of the shuffle.
    firsts = sorted({(row._key, row._hash) for row in slices.collect()})
    places = {first: at for at, first in enumerate(firsts)}

    @F.pandas_udf("array<struct<slice: int, ahead: boolean>>")
    def to_slices(keys: pd.Series, hashes: pd.Series) -> pd.Series:
        out = []
        for pair in zip(keys.tolist(), hashes.tolist(), strict=True):
            found = [{"slice": max(0, bisect.bisect_right(firsts, pair) - 1), "ahead": False}]
            if pair in places:
                found.append({"slice": (places[pair] - 1) % len(firsts), "ahead": True})
            out.append(found)
        return pd.Series(out)

    kind = pa.schema(
        [("doc_id", pa.int64()), ("n_chars", pa.int64())]
        + [(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
        + [("near_edited", pa.float64()), ("near_next", pa.float64())]
    )
    sizes = (k, length, size)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, None
        for batch in batches:
            rows = []
            for at, ahead, doc_id, text in zip(
                *(batch.column(c).to_pylist() for c in ("slice", "ahead", "doc_id", "text")),
                strict=True,
            ):
                if done == at:
                    continue  # more repeats of the row that is ahead
                mark = signature(text, *sizes)
                if held is not None and held[0] == at:
                    rows.append(_row(*held[1:], text, mark, sizes))
                held, done = (None, at) if ahead else ((at, doc_id, text, mark), None)
            yield pa.RecordBatch.from_pylist(rows, kind)
        if held is not None:
            raise ValueError("a slice ends without the row ahead of it")

    dealt = (
        texts.withColumns({"_key": key[0], "_hash": key[1]})
        .withColumn("_to", F.explode(to_slices("_key", "_hash")))
        .select("_to.*", "_key", "_hash", "doc_id", "text")
        .repartitionById(max(1, len(firsts)), F.col("slice"))
        .sortWithinPartitions("slice", "ahead", "_key", "_hash")
    )
    return dealt.select("slice", "ahead", "doc_id", "text").mapInArrow(walk, RESULT)
