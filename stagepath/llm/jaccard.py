"""Near-duplicate groups by the Jaccard similarity of word n-grams, joined in vertical fragments."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagepath.llm.common import ALL, in_one, ship_code, shuffle_partitions
from stagepath.llm.components import as_links, components
from stagepath.staging import Staging

WORDS = 5
PERCENT = 75
#: An n-gram that more documents hold comes last in the order, which is by hash otherwise.
COMMON = 16
#: Bounds what is broadcast: 8 bytes per common n-gram, 1 bit per place of the filter.
MAX_COMMON = 1 << 20
FILTER_PLACES = 1 << 23
BANDS, ROWS = 8, 3
CUTS = 8
FRAGMENT_GRAMS = 1 << 20
#: What a task holds before it sends.
HELD_GRAMS = 1 << 19

_RANDOM = np.random.default_rng(90210)
_FACTORS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SKETCH = "doc_id long, node long, n long, bands array<long>, bits binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64, for texts of up to 2^bits bytes."""
    base = 0xD1342543DE82EF95
    out = []
    for factor in (base, pow(base, -1, 1 << 64)):
        steps = np.full(1 << bits, factor, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word of a text, A-Z lower-cased.

    A word's bytes are the digits of a number modulo 2^64, taken from sums over the whole text.
    """
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    inside = ~((data == 0x20) | ((data >= 0x09) & (data <= 0x0D)))
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    starts, ends = edges[::2], edges[1::2]
    powers, inverse = _powers(max(12, len(data).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * inverse[starts])


def gram_set(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct word n-grams, A-Z lower-cased.

    A text of fewer words is one n-gram; without words the set is empty.
    """
    hashes = word_hashes(text or "")
    if not len(hashes):
        return hashes
    size = min(n, len(hashes))
    # Each place in an n-gram has an odd factor of its own.
    grams = hashes[: len(hashes) - size + 1] * np.uint64(2 * size + 1)
    factor = 1
    for j in range(1, size):
        factor = factor * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        grams = grams + hashes[j : len(hashes) - size + 1 + j] * np.uint64(factor)
    grams = np.sort(_mix(grams))
    return grams[np.concatenate([[True], grams[1:] != grams[:-1]])]


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """So many first n-grams of two linked sets, in any one order, share at least one."""
    return n - -(-percent * n // 100) + 1


def _node(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def _bands(grams: np.ndarray) -> list[int]:
    step = max(1, HELD_GRAMS // len(grams))
    least = np.concatenate([
        (grams * _FACTORS[low : low + step, None]).min(axis=1) for low in range(0, len(_FACTORS), step)
    ]).tolist()
    return [
        xxhash.xxh64_intdigest(repr((band, least[band * ROWS : (band + 1) * ROWS])).encode()) - (1 << 63)
        for band in range(BANDS)
    ]


def parity_bits(grams: np.ndarray) -> np.ndarray:
    """Whether an odd number of n-grams fall on each of two to four places per n-gram."""
    places = 1 << max(7, int(len(grams)).bit_length() + 1)
    counts = np.bincount((grams % np.uint64(places)).astype(np.int64), minlength=places)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little")


def may_link(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int, percent: int = PERCENT) -> bool:
    """False only if two sets cannot be linked.

    A place of odd parity in the one and even in the other takes an n-gram that only one of them
    holds, and linked sets differ in at most (100 - percent) / (100 + percent) of their sizes'
    sum. The longer bits are folded to the length of the shorter.
    """
    if len(a) < len(b):
        a, b = b, a
    apart = np.bitwise_xor.reduce(a.reshape(-1, len(b)), axis=0) ^ b
    differ = int(np.bitwise_count(apart).sum())
    return differ * (100 + percent) <= (100 - percent) * (n_a + n_b)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(column, field.type) for column, field in zip(columns, schema, strict=True)],
        schema=schema,
    )


def _grams_of(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for text in batch.column(0):
            grams = gram_set(text.as_py(), words)
            if len(grams):
                yield grams


def sketches(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """Per document: a digest of its set, the set's size, min-hash bands and parity bits."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()),
         ("bands", pa.list_(pa.int64())), ("bits", pa.binary())]
    )

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                grams = gram_set(value.as_py(), words)
                if len(grams):
                    bits = parity_bits(grams).tobytes()
                    rows.append((doc_id, _node(grams), len(grams), _bands(grams), bits))
                else:
                    rows.append((doc_id, 0, 0, [], b""))
            yield _batch(schema, rows)
        pa.default_memory_pool().release_unused()

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(sketch, SKETCH)


def _fragment(grams: np.ndarray, fragments: int) -> np.ndarray:
    """Which of as many equal cuts of the order an n-gram lies in; a power of two."""
    return (grams >> np.uint64(65 - fragments.bit_length())).astype(np.int64)


def _in_fragment(grams: np.ndarray, fragments: int) -> np.ndarray:
    """The 32 bits of an n-gram behind those that name its fragment."""
    return (grams >> np.uint64(33 - fragments.bit_length())).astype(np.uint32)


def _split(order: np.ndarray, fragments: int) -> Iterator[tuple[int, slice]]:
    """The slices of sorted n-grams by fragment."""
    part = _fragment(order, fragments)
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        yield int(part[low]), slice(low, high)


def _marks(grams: np.ndarray, fragments: int) -> np.ndarray:
    """What an n-gram is counted by: its fragment and 32 bits more. As a fragment holds about a
    million n-grams at any size of the corpus, few share their mark."""
    return grams >> np.uint64(33 - fragments.bit_length())


def _is_common(grams: np.ndarray, many: np.ndarray, fragments: int) -> np.ndarray:
    """Whether the mark of each n-gram is among the sorted marks of the common ones."""
    if not len(many):
        return np.zeros(len(grams), bool)
    marks = _marks(grams, fragments)
    return many[np.minimum(np.searchsorted(many, marks), len(many) - 1)] == marks


def common_marks(texts: DataFrame, fragments: int, staging: Staging, words: int) -> np.ndarray:
    """Sorted marks of the n-grams that more than COMMON documents hold, counted over all of them.

    A task sends each mark once, those it met again with their counts. If more than MAX_COMMON
    are common, the limit is doubled until they fit: the order may be any, so this
    costs candidates, never links.
    """
    schema = pa.schema(
        [("fragment", pa.int64()), ("once", pa.binary()), ("again", pa.binary()), ("counts", pa.binary())]
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send() -> pa.RecordBatch:
            grams, counts = np.unique(np.concatenate(held), return_counts=True)
            rows = []
            for part, at in _split(grams, fragments):
                marks, n = _in_fragment(grams[at], fragments), counts[at].astype(np.uint32)
                rows.append((part, marks[n == 1].tobytes(), marks[n > 1].tobytes(), n[n > 1].tobytes()))
            return _batch(schema, rows)

        held, size = [], 0
        for grams in _grams_of(batches, words):
            held.append(grams)
            size += len(grams)
            if size > HELD_GRAMS:
                yield send()
                held, size = [], 0
        if held:
            yield send()
        pa.default_memory_pool().release_unused()

    def add_up(group: pa.Table) -> pa.Table:
        once, again, n = (
            np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in group[c]])
            for c in ("once", "again", "counts")
        )
        marks = np.concatenate([once, again])
        counts = np.concatenate([np.ones(len(once), np.int64), n.astype(np.int64)])
        order = np.argsort(marks, kind="stable")
        marks, counts = marks[order], counts[order]
        starts = np.flatnonzero(np.concatenate([[True], marks[1:] != marks[:-1]]))
        total = np.add.reduceat(counts, starts)
        many = total > COMMON
        fragment = group["fragment"][0].as_py()
        pa.default_memory_pool().release_unused()
        return pa.table({"mark": marks[starts][many].astype(np.int64) + (fragment << 32), "n": total[many]})

    common = staging.save(
        texts.mapInArrow(count, "fragment long, once binary, again binary, counts binary")
        .groupBy("fragment").applyInArrow(add_up, "mark long, n long"),
        "common",
    )
    power = F.floor(F.log2("n")).cast("int")
    sizes = {r.power: r.n for r in common.groupBy(power.alias("power")).agg(F.count("*").alias("n")).collect()}
    least = 0
    while sum(n for power, n in sizes.items() if power >= least) > MAX_COMMON:
        least += 1
    kept = common.where(F.col("n") >= 2**least).select("mark").toArrow()["mark"].to_numpy()
    return np.sort(kept.astype(np.uint64))


def shared_prefixes(
    texts: DataFrame, common: Broadcast, fragments: int, words: int, percent: int
) -> DataFrame:
    """(gram, node, place, rare) of every n-gram that stands in the prefixes of two sets or more, its
    place there and how many n-grams of the set are not common. The order puts the common
    n-grams behind the others, so an n-gram is common if its place is not below `rare`.
    """
    schema = pa.schema(
        [("fragment", pa.int64()), ("grams", pa.binary()), ("nodes", pa.binary()), ("places", pa.binary()),
         ("rares", pa.binary())]
    )

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = common.value

        def send() -> pa.RecordBatch:
            grams = np.concatenate(held)
            nodes = np.repeat(np.array(owners, np.int64), [*map(len, held)])
            places = np.concatenate([np.arange(len(prefix), dtype=np.int32) for prefix in held])
            rares = np.repeat(np.array(rare, np.int32), [*map(len, held)])
            order = np.argsort(grams, kind="stable")
            grams, nodes, places, rares = grams[order], nodes[order], places[order], rares[order]
            return _batch(schema, [
                (part, grams[at].tobytes(), nodes[at].tobytes(), places[at].tobytes(), rares[at].tobytes())
                for part, at in _split(grams, fragments)
            ])

        held, owners, rare, size, seen = [], [], [], 0, set()
        for grams in _grams_of(batches, words):
            node = _node(grams)
            if node in seen:
                continue
            seen.add(node)
            length = prefix_length(len(grams), percent)
            last = _is_common(grams, many, fragments)
            grams = np.concatenate([grams[~last], grams[last]])
            held.append(grams[:length])
            owners.append(node)
            rare.append(len(grams) - int(last.sum()))
            size += length
            if size > HELD_GRAMS:
                yield send()
                held, owners, rare, size = [], [], [], 0
        if held:
            yield send()
        pa.default_memory_pool().release_unused()

    def shared(group: pa.Table) -> pa.Table:
        grams = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in group["grams"]])
        nodes = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in group["nodes"]])
        places = np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in group["places"]])
        rares = np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in group["rares"]])
        order = np.lexsort((nodes, grams))
        grams, nodes, places, rares = grams[order], nodes[order], places[order], rares[order]
        new = np.concatenate([[True], (grams[1:] != grams[:-1]) | (nodes[1:] != nodes[:-1])])
        grams, nodes, places, rares = grams[new], nodes[new], places[new], rares[new]
        same = np.concatenate([[False], grams[1:] == grams[:-1]])
        twice = same | np.concatenate([same[1:], [False]])
        return pa.table(
            {"gram": grams[twice].view(np.int64), "node": nodes[twice], "place": places[twice], "rare": rares[twice]}
        )

    return (
        texts.mapInArrow(prefixes, "fragment long, grams binary, nodes binary, places binary, rares binary")
        .groupBy("fragment")
        .applyInArrow(shared, "gram long, node long, place int, rare int")
    )


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_PLACES))


class _Verifier:
    """Counts overlaps of pairs of sets, cut into fragments of the order."""

    def __init__(self, docs, classes, staging, key, text, words, percent):
        self.docs, self.classes, self.staging = docs, classes, staging
        self.key, self.text, self.words, self.percent = key, text, words, percent

    def _fragments(self, chosen_docs: DataFrame, common: Broadcast | None, fragments: int) -> DataFrame | None:
        """(node, n, n_common, cut, grams, frequent) of the classes of the documents with the given `doc_id`;
        `grams` are those that are not common, all of them if none are named. None if no documents are given.

        A filter of fixed size, one bit per hashed doc_id, spares taking most other texts
        apart; what it lets through beside is joined with no pair.
        """
        wanted = chosen_docs.select(_place(F.col("doc_id")).alias("place"))
        words = wanted.groupBy((F.col("place") / 32768).cast("int").alias("word")).agg(
            F.bitmap_construct_agg((F.col("place") % 32768).cast("int")).alias("bits")
        )
        found = words.collect()  # at most 256 rows of 4 kB
        if not found:
            return None
        bits = np.zeros(FILTER_PLACES // 8, np.uint8)
        for row in found:
            bits[row.word * 4096 : row.word * 4096 + 4096] = np.frombuffer(row.bits, np.uint8)
        spark = self.docs.sparkSession
        chosen = spark.sparkContext.broadcast(bits)
        n_words = self.words
        schema = pa.schema(
            [("node", pa.int64()), ("n", pa.int64()), ("n_common", pa.int64()), ("cut", pa.int32()),
             ("grams", pa.list_(pa.int64())), ("frequent", pa.list_(pa.int64()))]
        )

        def take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            many = np.zeros(0, np.uint64) if common is None else common.value
            for batch in batches:
                rows, size = [], 0
                for place, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if not chosen.value[place >> 3] >> (place & 7) & 1:
                        continue
                    grams = gram_set(value.as_py(), n_words)
                    if not len(grams):
                        continue
                    node, last = _node(grams), _is_common(grams, many, fragments)
                    signed, n_common = grams.view(np.int64), int(last.sum())
                    for cut, at in _split(grams, CUTS):
                        part, often = signed[at], last[at]
                        rows.append((node, len(grams), n_common, cut, part[~often], part[often]))
                    size += len(grams)
                    if size > HELD_GRAMS // 4:
                        yield _batch(schema, rows)
                        rows, size = [], 0
                yield _batch(schema, rows)

        return self.docs.select(_place(F.col(self.key).cast("long")), F.col(self.text)).mapInArrow(
            take_apart, "node long, n long, n_common long, cut int, grams array<long>, frequent array<long>"
        )

    def _possible(self, pairs: DataFrame) -> DataFrame:
        """(a, b, doc_a, doc_b): the pairs, but for those whose parity bits show that they are too different,
        with a document of each."""
        percent = self.percent

        @F.pandas_udf("boolean")
        def possible(a: pd.Series, b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
            return pd.Series([
                may_link(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8), n, m, percent)
                for x, y, n, m in zip(a, b, n_a, n_b, strict=True)
            ], dtype=bool)

        def side(name: str) -> DataFrame:
            return self.classes.select(
                F.col("node").alias(name), F.col("doc_id").alias(f"doc_{name}"),
                F.col("n").alias(f"n_{name}"), F.col("bits").alias(f"bits_{name}"),
            )

        sized = pairs.join(side("b"), "b").join(side("a"), "a")
        return sized.where(possible("bits_a", "bits_b", "n_a", "n_b")).select("a", "b", "doc_a", "doc_b")

    def links(
        self, pairs: DataFrame, label: str, common: Broadcast | None = None, fragments: int = 1
    ) -> DataFrame:
        """(a, b, spared): those of the stored pairs of classes that are linked, and if the common n-grams
        are given, the one of the two, if any, that the other stands in for.

        Each fragment's overlap is counted by itself and the counts are summed per pair.
        Repeated documents give the same count again, of which the largest is taken.
        """
        possible = self.staging.save(self._possible(pairs), f"{label}-possible")
        pairs = possible.select("a", "b")
        cuts = self._fragments(possible.select(F.explode(F.array("doc_a", "doc_b")).alias("doc_id")), common, fragments)
        if cuts is None:
            return pairs.withColumn("spared", F.lit(None).cast("long"))  # none
        cuts = self.staging.save(cuts, f"{label}-cuts")

        def side(name: str) -> DataFrame:
            renamed = (F.col(c).alias(f"{c}_{name}") for c in ("n", "n_common", "grams", "frequent"))
            return cuts.select(F.col("node").alias(name), "cut", *renamed)

        def largest(*names: str) -> list[Column]:
            return [F.max(name).alias(name) for name in (*names, "n_a", "n_b", "n_common_a", "n_common_b")]

        often = F.size(F.array_intersect("frequent_a", "frequent_b"))
        overlap = F.size(F.array_intersect("grams_a", "grams_b")) + often
        counted = (
            pairs.join(side("b"), "b")
            .join(side("a"), ["a", "cut"])
            .withColumns({"overlap": overlap, "often": often})
            .groupBy("a", "b", "cut")
            .agg(*largest("overlap", "often"))
            .groupBy("a", "b")
            .agg(F.sum("overlap").alias("both"), F.sum("often").alias("both_common"), *largest())
        )
        linked = 100 * F.col("both") >= self.percent * (F.col("n_a") + F.col("n_b") - F.col("both"))
        spared = F.lit(None).cast("long") if common is None else F.when(
            stands_in("b", "a", self.percent), F.col("a")
        ).when(stands_in("a", "b", self.percent), F.col("b"))
        return self.staging.save(counted.where(linked).select("a", "b", spared.alias("spared")), label)


def _reach(n: Column, n_common: Column, percent: int) -> Column:
    """The larger, the more sets a set is linked to with which it shares common n-grams alone."""
    return (100 + percent) * n_common - percent * n


def stands_in(z: str, x: str, percent: int) -> Column:
    """Whether the class z is linked to every class that x is linked to by common n-grams alone.

    Let x have c common n-grams, d of which z has not. If x shares with y common n-grams alone, z shares
    with y at least as many less d. As the link needs (100 + percent) * overlap >= percent * (n_x + n_y),
    that is enough for z if (100 + percent) * d <= percent * (n_x - n_z). The reach of z is then that of x at least;
    if it is the same, the smaller node stands in, so no two stand in for each other, by however many steps.
    """
    n_z, n_x, c_z, c_x = (F.col(f"{name}_{side}") for name in ("n", "n_common") for side in (z, x))
    missing = (100 + percent) * (c_x - F.col("both_common"))
    first = (_reach(n_z, c_z, percent) > _reach(n_x, c_x, percent)) | (F.col(z) < F.col(x))
    return (missing <= percent * (n_x - n_z)) & first


#: Sizes of sets are told apart in so many levels between a set and the smallest it can be linked to.
LEVELS = 12


def _bound(percent: int) -> Column:
    """How large the other set of a link can be that has its first common n-gram here."""
    n, place = F.col("n"), F.col("place")
    return F.floor(((100 + percent) * (n - place) - percent * n) / percent)


def _sides(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The postings of an n-gram as the smaller and as the larger set of a link, by n-gram and level.

    Where a shared n-gram is the first of two sets' order, no more than what follows it in
    either can be shared beside it, so it bounds the size of the other set; if the first fails, so do
    all. A set is the smaller one of a link only if its own size is within its bound, and the larger one at
    the levels of all sizes from the least that can be linked to it up to its bound. So two sets whose n-gram
    stands too far back in both never meet.
    """
    step = max(math.log(100 / percent), 0.01) / LEVELS
    n, place = F.col("n"), F.col("place")

    def level(size: Column) -> Column:
        return F.floor(F.log(size.cast("double")) / step)

    bounded = rows.withColumn("bound", _bound(percent)).withColumn("least", F.ceil(percent * n / 100))
    smaller = bounded.where(F.col("bound") >= n).select(
        "gram", level(n).alias("level"), F.col("component").alias("c"), F.col("node").alias("x"),
        n.alias("n_x"), place.alias("place_x"), F.col("bound").alias("bound_x"),
    )
    top = F.least("bound", "n")
    larger = bounded.where(top >= F.col("least")).select(
        "gram", F.explode(F.sequence(level(F.col("least")), level(top))).alias("level"),
        F.col("component").alias("d"), F.col("node").alias("y"),
        n.alias("n_y"), F.col("bound").alias("bound_y"),
    )
    return smaller, larger


def _paired(rows: DataFrame) -> DataFrame:
    fits = (F.col("n_x") <= F.least("n_y", "bound_y")) & (F.col("n_y") <= F.col("bound_x"))
    return rows.where(fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def star_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """The set whose n-gram stands foremost, with all of other components that it may be linked to, by n-gram and level.

    Sets that consist of the same common n-grams but for a few differ from each other by just those few, so
    each that is linked to any is linked to the one with the fewest.
    """
    smaller, larger = _sides(rows, percent)
    centres = smaller.groupBy("gram", "level").agg(
        F.min(F.struct("place_x", "x", "n_x", "bound_x", "c")).alias("first")
    ).select("gram", "level", "first.*")
    return _paired(centres.join(larger, ["gram", "level"]).where("c <> d"))


def few_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """All pairs of sets of different components that share an n-gram of few sets and fit by its places."""
    bounded = rows.select("gram", "component", "node", "n", _bound(percent).alias("bound"))
    x = bounded.toDF("gram", "c", "x", "n_x", "bound_x")
    y = bounded.toDF("gram", "d", "y", "n_y", "bound_y")
    fits = (F.col("n_x") <= F.col("bound_y")) & (F.col("n_y") <= F.col("bound_x"))
    return x.join(y, "gram").where((F.col("c") < F.col("d")) & fits).select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")
    ).distinct()


def fitting_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """All pairs of sets of different components that share an n-gram and may be linked by its places.

    Components meet first, so sets of one component are never paired.
    """
    smaller, larger = _sides(rows, percent)
    meet = smaller.select("gram", "level", "c").distinct().join(
        larger.select("gram", "level", "d").distinct(), ["gram", "level"]
    ).where("c <> d")
    return _paired(
        meet.join(smaller, ["gram", "level", "c"]).join(larger, ["gram", "level", "d"])
    )


def stand_in_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Each set with the one of its component that is most likely to stand in for it.

    Of the sets that share a common n-gram within a component, that of the largest reach among those that are no
    larger; a set is paired with the one that it finds so at most of its n-grams.
    """
    lack = -_reach(F.col("n"), F.col("n") - F.col("rare"), percent)
    known = rows.where("place >= rare").withColumn("lack", lack)
    best = known.groupBy("gram", "component", "n").agg(F.min(F.struct("lack", F.col("node").alias("z"))).alias("first"))
    up_to = Window.partitionBy("gram", "component").orderBy("n").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    best = best.withColumn("first", F.min("first").over(up_to))
    met = known.select("gram", "component", "n", F.col("node").alias("x")).join(best, ["gram", "component", "n"])
    times = met.select("x", "first.*").where("x <> z").groupBy("x", "lack", "z").agg((-F.count("*")).alias("turned"))
    chosen = times.groupBy("x").agg(F.min(F.struct("turned", "lack", "z")).alias("most")).select("x", "most.z")
    return chosen.select(F.least("x", "z").alias("a"), F.greatest("x", "z").alias("b")).distinct()


def near_groups(
    docs: DataFrame,
    staging: Staging,
    words: int = WORDS,
    percent: int = PERCENT,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Each document's number of distinct n-grams and the smallest key it is linked to.

    Two documents are linked if the overlap of their sets is at least `percent` of the union;
    groups are the components of the links. Documents with equal sets are one class from the
    start. NULL and empty texts have no n-grams and are linked with nothing.
    Rows with equal keys are documents of their own; a NULL key is no group's smallest, so
    a group of NULL keys alone has NULL. Other columns are left aside. An empty table gives no rows.

    1. Classes that agree in a min-hash band are compared with the band's smallest
       class, and those linked form components. This joins large groups of near copies by
       one pair per member and band.
    2. The n-gram order is cut into fragments. Linked sets share an n-gram in their
       prefixes. Classes of different components that share one of at most COMMON classes are paired if they
       fit by size and place; of one that more share, the class in which it stands foremost is
       paired with those that fit. Beside, classes are compared with one of their own component that
       may stand in for them.
    3. All classes of the components that are left, if they share an n-gram of many prefixes and
       fit by size and place, are paired, so that no link between groups is lost. By common n-grams
       a class is left out if one that it is linked to has every link that it can have by them (`stands_in`):
       of the many near copies of one text, that text meets the others for all.
    Pairs whose parity bits do not rule them out are verified exactly, fragment by fragment.

    This gives groups and not links: neither linked pairs nor their overlaps or number. Pairs of
    documents with equal sets are never enumerated, nor are pairs of classes inside a component
    that steps 1 or 2 have already joined, other than those compared on the way.
    """
    spark = docs.sparkSession
    ship_code(spark)
    stored = staging.save(sketches(docs, key, text, words), "sketches")
    classes = staging.save(
        stored.where("n > 0").groupBy("node").agg(
            F.min("doc_id").alias("doc_id"), F.max("n").alias("n"),
            F.first("bands").alias("bands"), F.first("bits").alias("bits"),
        ),
        "classes",
    )
    verifier = _Verifier(docs, classes, staging, key, text, words, percent)

    banded = classes.select("node", F.explode("bands").alias("band"))
    centres = banded.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("last"))
    stars = (
        banded.join(centres.where("a < last").drop("last"), "band")
        .where("a <> node").select("a", F.col("node").alias("b")).distinct()
    )
    stars = staging.save(stars, "star-pairs")
    links = verifier.links(stars, "star-links")

    total = stored.agg(F.sum("n")).first()[0] or 0
    least = max(shuffle_partitions(spark), -(-total // FRAGMENT_GRAMS))
    fragments = 1 << (least - 1).bit_length()
    texts = docs.select(text)
    common = spark.sparkContext.broadcast(common_marks(texts, fragments, staging, words))
    postings = staging.save(shared_prefixes(texts, common, fragments, words, percent), "postings")

    def between(member: DataFrame, label: str) -> DataFrame:
        """The postings of n-grams that two components or more share, with component and size, and
        whether there are many of the n-gram."""
        sized = classes.select("node", "n").join(member, "node", "left").withColumn(
            "component", F.coalesce("component", "node")
        )
        placed = staging.save(postings.join(sized, "node"), f"{label}-placed")
        mixed = placed.groupBy("gram").agg(
            F.min("component").alias("low"), F.max("component").alias("high"),
            (F.count("*") > COMMON).alias("many"),
        ).where("low < high").select("gram", "many")
        return placed.join(mixed, "gram")

    member = components(links, staging, "first-of")
    shared = staging.save(between(member, "first"), "first-between")
    few, many = few_pairs(shared.where("not many"), percent), star_pairs(shared.where("many"), percent)
    alike = stand_in_pairs(shared.where("many"), percent)
    chosen_pairs = staging.save(few.unionByName(many).unionByName(alike).distinct(), "chosen-pairs")
    chosen = verifier.links(chosen_pairs, "chosen-links", common, fragments)
    # Each time the components so far stand for the links that they were found by.
    member = components(as_links(member).unionByName(chosen.drop("spared")), staging, "second-of")

    # A link by an n-gram that is not common is no stand-in's, so it is looked for in any case.
    spared = chosen.where("spared is not null").select(F.col("spared").alias("node"), F.lit(True).alias("left_out"))
    shared = between(member, "second").where("many").join(spared.distinct(), "node", "left")
    meeting = staging.save(shared.where("left_out is null or place < rare").drop("left_out"), "meeting")
    rest = fitting_pairs(meeting, percent).join(stars.unionByName(chosen_pairs), ["a", "b"], "left_anti")
    rest = staging.save(rest, "rest-pairs")
    rest_links = verifier.links(rest, "rest-links").drop("spared")
    member = components(as_links(member).unionByName(rest_links), staging, "all")
    grouped = classes.select("node", "doc_id").join(member, "node").groupBy("component").agg(
        F.min("doc_id").alias("_least")
    )
    named = staging.save(
        classes.select("node", "doc_id").join(member.join(grouped, "component"), "node", "left").select(
            "node", F.coalesce("_least", "doc_id").alias("component_id")
        ),
        "named",
    )
    with_grams = stored.where("n > 0").join(named, "node").select(
        F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), "component_id"
    )
    without = stored.where("n = 0").select(
        F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")
    )
    return with_grams.unionByName(without)


def keep_one_of_each(docs: DataFrame, staging: Staging, **options) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate group, in its own columns.

    Rows that repeat both doc_id and text count as one document. Rows of one doc_id with
    different texts stay or go together.
    """
    groups = staging.save(near_groups(docs, staging, **options), "groups")
    stay = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("doc_id").alias("_stay")
    )
    once = stay.groupBy("_stay").agg(F.count("*").alias("_rows"))
    kept = in_one(docs).join(once, F.col(f"{ALL}.doc_id").eqNullSafe(F.col("_stay")))
    if once.where("_rows > 1").isEmpty():
        return kept.select(f"{ALL}.*")
    repeated = kept.where("_rows > 1").withColumn("_text", F.col(f"{ALL}.text")).dropDuplicates(["_stay", "_text"])
    return kept.where("_rows = 1").select(ALL).unionByName(repeated.select(ALL)).select(f"{ALL}.*")
