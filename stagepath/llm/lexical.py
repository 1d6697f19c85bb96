"""Ranked lexical search: items against all documents, grouped by the mask of matched terms."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagepath.llm.common import ship_code
from stagepath.llm.textbytes import as_bytes, parts
from stagepath.staging import Staging

TOP = 10
#: Pairs of item and term in a block of items; what is broadcast grows with it, about 100 bytes a pair.
BLOCK_PAIRS = 1 << 19
#: Cells of a table of documents by terms that a task holds, 4 bytes each.
CELLS = 1 << 23
#: Tasks share the last ranking of an item among so many groups first.
SPREAD = 64

_TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
#: Stands for a NULL doc_id, which comes before all others among equal scores.
NO_ID = -(1 << 63)

RESULT = "item_id long, rank int, doc_id long, score long"


def term_counts(text: bytes | None) -> Counter[bytes]:
    """How often a text holds each term: a run of letters, digits and other than ASCII, A-Z lower-cased."""
    counts: Counter[bytes] = Counter()
    for part in parts(text or b"", _GAP):
        counts.update(_TERM.findall(part.lower()))
    return counts


@dataclass(frozen=True)
class Corpus:
    """What a score needs to know of all documents."""

    documents: int
    occurrences: int

    def weight(self, holders: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * holders + 1)))

    def measure(self, lengths: np.ndarray) -> np.ndarray:
        return 100 - 90 + (90 * lengths * self.documents) // max(self.occurrences, 1)


def contribution(counts: np.ndarray, measures: np.ndarray) -> np.ndarray:
    """The part of a score that a term's number of occurrences gives, before its weight."""
    return (1000000000 * counts) // np.maximum(1000 * counts + 8 * measures, 1)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, terms = [], []
        for item, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
            found = term_counts(text)
            ids.extend([item] * len(found))
            terms.extend(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(terms, pa.binary())], ["item_id", "term"]
        )


def _postings(vocabulary: Broadcast):
    """A row per document with a term: its length, and the searched terms with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for batch in batches:
            ids, lengths, terms, counts = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                found = term_counts(text)
                if not found:
                    continue
                hits = [(number[term], n) for term, n in found.items() if term in number]
                ids.append(doc)
                lengths.append(found.total())
                terms.append([at for at, _ in hits])
                counts.append([n for _, n in hits])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(terms, pa.list_(pa.int32())),
                    pa.array(counts, pa.list_(pa.int64())),
                ],
                ["doc_id", "n", "terms", "counts"],
            )

    return run


def presence_masks(bitmaps: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct sets of matched terms among documents, and the set of each document.

    `bitmaps` holds a row of bits over `size` documents per term. Turned round, each
    document gets the bits of its terms; equal ones form a group. The sets come as a
    boolean row of terms each.
    """
    bits = np.unpackbits(bitmaps, axis=1, count=size)
    packed = np.packbits(bits, axis=0)
    wide = np.zeros((-(-len(packed) // 8) * 8, size), np.uint8)
    wide[: len(packed)] = packed
    words = np.ascontiguousarray(wide.T).view(np.uint64)
    if words.shape[1] == 1:
        _, first, group = np.unique(words[:, 0], return_index=True, return_inverse=True)
    else:
        keys = words.view([("", np.uint64)] * words.shape[1])[:, 0]
        _, first, group = np.unique(keys, return_index=True, return_inverse=True)
    return bits[:, first].T, group


class Best:
    """The highest scores of one item so far, at most `top`, equal ones by document."""

    def __init__(self, top: int):
        self.top = top
        self.scores = np.zeros(0, np.int64)
        self.docs = np.zeros(0, np.int64)

    def least(self) -> int:
        """A score below this cannot enter."""
        return max(1, int(self.scores[-1])) if len(self.scores) == self.top else 1

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        enough = scores >= self.least()
        if not enough.any():
            return
        scores = np.concatenate([self.scores, scores[enough]])
        docs = np.concatenate([self.docs, docs[enough]])
        order = np.lexsort((docs, -scores))[: self.top]
        self.scores, self.docs = scores[order], docs[order]


class Block:
    """Some documents: the bitmap of each term over them, and the contribution of each term and document."""

    def __init__(self, docs, lengths, offsets, terms, counts, corpus: Corpus, weights: np.ndarray):
        self.docs, self.size = docs, len(docs)
        self.terms, column = np.unique(terms, return_inverse=True)
        row = np.repeat(np.arange(self.size), np.diff(offsets))
        parts = contribution(counts, corpus.measure(lengths)[row])
        self.parts = np.zeros((len(self.terms), self.size), np.int32)
        self.parts[column, row] = parts
        present = np.zeros((len(self.terms), self.size), bool)
        present[column, row] = True
        self.bitmaps = np.packbits(present, axis=1)
        self.weights = weights[self.terms]
        self.highest = self.parts.max(axis=1, initial=0).astype(np.int64) * self.weights

    def search(self, terms: np.ndarray, best: Best) -> int:
        """Adds to an item's best; returns how many documents were scored.

        The groups of equal masks are taken by the highest score that a document with all
        of the mask's terms can have here, until that is less than what is found already.
        """
        at = np.flatnonzero(np.isin(self.terms, terms, assume_unique=True))
        if not len(at) or int(self.highest[at].sum()) < best.least():
            return 0
        masks, group = presence_masks(self.bitmaps[at], self.size)
        limits = masks @ self.highest[at]
        order = np.argsort(-limits, kind="stable")
        members = np.argsort(group, kind="stable")
        ends = np.cumsum(np.bincount(group, minlength=len(masks)))
        weights, done, step, scored = self.weights[at], 0, 4, 0
        while done < len(order) and limits[order[done]] >= best.least():
            chosen = order[done : done + step]
            chosen = chosen[limits[chosen] >= best.least()]
            rows = np.concatenate([members[ends[g - 1] if g else 0 : ends[g]] for g in chosen])
            scores = weights @ self.parts[np.ix_(at, rows)].astype(np.int64)
            best.add(scores, self.docs[rows])
            scored += len(rows)
            done, step = done + step, step * 2
        return scored


def _search(items: Broadcast, corpus: Corpus, top: int):
    """The best documents of every item among those that a task reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_terms, weights = items.value
        best = [Best(top) for _ in item_terms]
        for batch in batches:
            docs = np.array(batch.column("doc_id").fill_null(NO_ID), np.int64)
            lengths = np.array(batch.column("n"), np.int64)
            offsets = np.array(batch.column("terms").offsets, np.int64)
            terms = np.array(batch.column("terms").values, np.int64)
            counts = np.array(batch.column("counts").values, np.int64)
            start = 0
            while start < len(docs):
                # As many documents as fit the cells, were all their terms different ones.
                stop = min(len(docs), start + 4096)
                while stop - start > 1:
                    seen = min(offsets[stop] - offsets[start], len(weights))
                    if seen * (stop - start) <= CELLS:
                        break
                    stop = start + (stop - start) // 2
                within = slice(offsets[start], offsets[stop])
                block = Block(
                    docs[start:stop], lengths[start:stop], offsets[start : stop + 1] - offsets[start],
                    terms[within], counts[within], corpus, weights,
                )
                for of_item, found in zip(item_terms, best, strict=True):
                    block.search(of_item, found)
                start = stop
        for low in range(0, len(best), 1000):
            some = best[low : low + 1000]
            found = np.concatenate([b.docs for b in some])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.arange(low, low + len(some)), [len(b.docs) for b in some])),
                    pa.array(found, mask=found == NO_ID),
                    pa.array(np.concatenate([b.scores for b in some])),
                ],
                ["item", "doc_id", "score"],
            )

    return run


def _ranked(frame: DataFrame, keys: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return frame.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, staging: Staging, top: int = TOP) -> DataFrame:
    """The `top` documents of each item with the highest scores above 0: item_id, rank, doc_id, score.

    Terms are runs of ASCII letters and digits and of all other than ASCII, A-Z
    lower-cased; each counts once in an item. NULL and empty texts have no terms: such
    an item has no rows, such a document is not counted. Equal scores go by doc_id, NULL
    first. Rows of `items` with one item_id are one item with the terms of all; every row of
    `docs` is a document, so repeated rows take ranks one after another. Other columns are
    left aside; empty tables give no rows.

    Items are taken in blocks whose terms have a bounded size. For each block the
    documents' texts are read once, for lengths and counts of the searched terms. A task
    then builds, for some thousand documents at a time, a bitmap per term over them.
    Turned round, an item's bitmaps give each document the mask of its matched terms.
    Groups of equal masks are scored by descending highest possible score until no
    group can change the item's best. Only the best of each task are shuffled.
    """
    spark = docs.sparkSession
    ship_code(spark)
    session = spark.sparkContext
    pairs = staging.save(
        items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
        .mapInArrow(_item_terms, "item_id long, term binary")
        .distinct(),
        "item_terms",
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = -(-pairs.count() // BLOCK_PAIRS)
    block_of = F.pmod(F.xxhash64("item_id"), F.lit(max(blocks, 1)))
    found = []
    for number in range(blocks):
        rows = pairs.where(block_of == number).collect()
        vocabulary = {term: at for at, term in enumerate(sorted({bytes(row.term) for row in rows}))}
        ids = sorted({row.item_id for row in rows}, key=lambda i: (i is not None, i))
        terms_of: dict[int | None, list[int]] = {i: [] for i in ids}
        for row in rows:
            terms_of[row.item_id].append(vocabulary[bytes(row.term)])

        shared = session.broadcast(vocabulary)
        postings = staging.save(
            texts.mapInArrow(
                _postings(shared), "doc_id long, n long, terms array<int>, counts array<long>"
            ),
            "postings",
        )
        total = postings.agg(F.count("*").alias("documents"), F.sum("n").alias("occurrences")).first()
        corpus = Corpus(total.documents, total.occurrences or 0)
        # One row per searched term, so at most as many as the block has pairs.
        weights = np.zeros(len(vocabulary), np.int64)
        for row in postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            weights[row.term] = corpus.weight(row["count"])
        shared_items = session.broadcast(
            ([np.array(sorted(terms_of[i]), np.int64) for i in ids], weights)
        )
        best = postings.mapInArrow(
            _search(shared_items, corpus, top), "item long, doc_id long, score long"
        )
        spread = best.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(SPREAD)))
        last = _ranked(_ranked(spread, ["_part", "item"], top).drop("rank", "_part"), ["item"], top)
        names = spark.createDataFrame(
            list(enumerate(ids)), T.StructType().add("item", "long").add("item_id", "long")
        )
        found.append(
            staging.save(
                last.join(names, "item").select("item_id", "rank", "doc_id", "score"), "ranked"
            )
        )
    if not found:
        return spark.createDataFrame([], RESULT)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
