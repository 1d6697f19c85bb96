"""Phrases whose words stand together more often than apart, from a weighted de Bruijn graph."""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagepath.llm.common import ship_code, shuffle_partitions
from stagepath.llm.textbytes import as_bytes, parts
from stagepath.staging import Staging

MIN_COUNT = 10
DROP_PERCENT = 50
TOP = 2000
NO_LANG = "und"
#: Words that a task turns into one graph before it sends it.
HELD_WORDS = 1 << 21
#: Bytes of text for each bucket in which graphs are merged.
BUCKET_BYTES = 1 << 23
#: The most frequent words of a sample of so many texts, each up to so many characters, are
#: looked up to spread the edges between them. They only decide where rows are merged.
SAMPLE_TEXTS, SAMPLE_CHARS, HOT_WORDS = 2000, 10000, 200

_TOKEN = re.compile(rb"[^\x20\x09.,;:!?\x0A-\x0D]+|[.,;:!?\x0A-\x0D]")
_GAP = re.compile(rb"[\x20\x09.,;:!?\x0A-\x0D]")
_ENDS = [bytes([c]) for c in b".,;:!?\x0a\x0b\x0c\x0d"]

GRAPH = (
    "bucket int, lang string, words binary,"
    " a array<int>, b array<int>, fan array<int>, c array<int>, w array<int>"
)
COUNTED = "kind string, lang string, a string, b string, c string, w long"


class Numbering(dict):
    """Numbers words from 1 in order of appearance; what ends a piece is 0."""

    def __init__(self) -> None:
        super().__init__(dict.fromkeys(_ENDS, 0))

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self) - len(_ENDS) + 1
        return number

    def words(self) -> list[bytes]:
        return list(self)[len(_ENDS) :]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E6C63D0676A9A99)
    return x ^ (x >> np.uint64(32))


def add_up(*keys: np.ndarray, weight: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct combinations of up to three keys in order, and the sum of each one's weights."""
    if not len(weight):
        return list(keys), weight.astype(np.int64)
    if max(int(key.max()) for key in keys) < 1 << 21:
        packed = np.zeros(len(weight), np.int64)
        for key in keys:
            packed = (packed << 21) | key
        order = np.argsort(packed, kind="stable")
        packed = packed[order]
        new = packed[1:] != packed[:-1]
    else:
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(order) - 1, bool)
        for key in keys:
            new |= key[order][1:] != key[order][:-1]
    starts = np.flatnonzero(np.concatenate([[True], new]))
    return [key[order[starts]] for key in keys], np.add.reduceat(weight[order].astype(np.int64), starts)


def edges(numbers: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The edges of the graph that a sequence of words and ends of pieces gives, with weights.

    A node is two words in a row, an edge three: it leads from its first two to its last
    two. Where a piece ends after one or two words, the rest is 0.
    """
    wide = np.concatenate([numbers, np.zeros(2, numbers.dtype)]).astype(np.int64)
    first, second, third = wide[:-2], wide[1:-1], np.where(wide[1:-1] == 0, 0, wide[2:])
    real = first > 0
    return add_up(first[real], second[real], third[real], weight=np.ones(int(real.sum()), np.int64))


def _rows_by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    found, starts = np.unique(bucket[order], return_index=True)
    for number, rows in zip(found, np.split(order, starts[1:]), strict=True):
        yield int(number), rows


class Graph:
    """The graph of some texts of one language."""

    def __init__(self) -> None:
        self.numbering, self.sequence = Numbering(), array("i")

    def add(self, text: bytes) -> int:
        before = len(self.sequence)
        for part in parts(text, _GAP):
            self.sequence.extend(map(self.numbering.__getitem__, _TOKEN.findall(part.lower())))
        self.sequence.append(0)
        return len(self.sequence) - before

    def rows(self, lang: str, buckets: int, hot: frozenset[bytes]) -> Iterator[tuple]:
        """The flow out of every word, and the nodes with their edges, by bucket.

        A node's edges share a bucket, but between two hot words they are spread by the
        third word.
        """
        (a, b, c), w = edges(np.array(self.sequence, np.int32))
        if not len(w):
            return
        words = self.numbering.words()
        hashes = np.array([0, *map(xxhash.xxh64_intdigest, words)], np.uint64)
        is_hot = np.array([False, *(word in hot for word in words)])
        seed = np.uint64(xxhash.xxh64_intdigest(lang.encode()))

        flow = np.zeros(len(hashes), np.int64)
        np.add.at(flow, a, w)
        for bucket, rows in _rows_by_bucket(_mix(hashes[1:] ^ seed) % np.uint64(buckets)):
            yield bucket, lang, b" ".join([words[i] for i in rows]), None, None, None, None, flow[rows + 1]

        inner = b > 0
        a, b, c, w = a[inner], b[inner], c[inner], w[inner]
        node = _mix(_mix(hashes[a] ^ seed) + hashes[b])
        node = np.where(is_hot[a] & is_hot[b], _mix(node + hashes[c]), node)
        for bucket, rows in _rows_by_bucket(node % np.uint64(buckets)):
            used = np.unique(np.concatenate([[0], a[rows], b[rows], c[rows]]))
            x, y, z = (np.searchsorted(used, key[rows]) for key in (a, b, c))
            starts = np.flatnonzero(
                np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
            )
            yield (
                bucket, lang, b" ".join([words[i - 1] for i in used[1:]]),
                x[starts], y[starts], np.diff(np.append(starts, len(x))), z, w[rows],
            )


def _graphs(buckets: int, hot: Broadcast):
    """The graphs of the texts that a task reads, in rows by bucket."""

    def sent(graphs: dict[str, Graph]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.string(), pa.binary(), *[pa.list_(pa.int32())] * 5]
        for lang, graph in graphs.items():
            some, size = [], 0
            for row in graph.rows(lang, buckets, hot.value):
                some.append(row)
                size += len(row[2]) + 8 * len(row[7])
                if size > 1 << 23:
                    yield _record(some, kinds)
                    some, size = [], 0
            if some:
                yield _record(some, kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graphs: dict[str, Graph] = {}
        held = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                if text:
                    held += graphs.setdefault(lang, Graph()).add(text)
                if held > HELD_WORDS:
                    yield from sent(graphs)
                    graphs, held = {}, 0
        yield from sent(graphs)

    return run


def _record(rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
    names = [field.split()[0] for field in GRAPH.split(", ")]
    columns = [pa.array(list(column), kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names)


def _numbers(column: pa.ChunkedArray, row: int) -> np.ndarray:
    return np.asarray(column[row].values, np.int64)


def _merged(min_count: int, hot: Broadcast):
    """The graphs of one bucket as one: what reaches the count of each kind.

    `word`: occurrences of a word. `total`: those of all words. `edge`: occurrences of three
    words. `node`: occurrences of two, the flow through the node, which is that along its edges
    and what ends there. `part` is a share of a node that is spread over buckets.
    """

    def of_language(lang: str, table: pa.Table) -> Iterator[tuple]:
        numbering = Numbering()
        flows, graph = [], []
        for i in range(table.num_rows):
            words = table["words"][i].as_py().split(b" ")
            number = np.fromiter(map(numbering.__getitem__, words), np.int64, len(words))
            weight = _numbers(table["w"], i)
            if table["a"][i].as_py() is None:
                flows.append((number, weight))
                continue
            number = np.concatenate([[0], number])
            fan = _numbers(table["fan"], i)
            graph.append(
                (
                    np.repeat(number[_numbers(table["a"], i)], fan),
                    np.repeat(number[_numbers(table["b"], i)], fan),
                    number[_numbers(table["c"], i)],
                    weight,
                )
            )
        words = np.array([b"", *numbering.words()], object)
        none = np.full(1, None)
        if flows:
            word, weight = (np.concatenate(x) for x in zip(*flows, strict=True))
            (word,), weight = add_up(word, weight=weight)
            yield "total", lang, none, none, none, np.array([weight.sum()])
            many = weight >= min_count
            blank = np.full(int(many.sum()), None)
            yield "word", lang, words[word[many]], blank, blank, weight[many]
        if graph:
            a, b, c, weight = (np.concatenate(x) for x in zip(*graph, strict=True))
            (a, b, c), weight = add_up(a, b, c, weight=weight)
            many = (weight >= min_count) & (c > 0)
            yield "edge", lang, words[a[many]], words[b[many]], words[c[many]], weight[many]
            starts = np.flatnonzero(
                np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            )
            a, b, flow = a[starts], b[starts], np.add.reduceat(weight, starts)
            is_hot = np.array([word in hot.value for word in words])
            spread = is_hot[a] & is_hot[b]
            for kind, chosen in (("node", ~spread & (flow >= min_count)), ("part", spread)):
                blank = np.full(int(chosen.sum()), None)
                yield kind, lang, words[a[chosen]], words[b[chosen]], blank, flow[chosen]

    def text(column: np.ndarray) -> pa.Array:
        return pa.array(column.tolist(), pa.binary()).cast(pa.string())

    def run(table: pa.Table) -> pa.Table:
        found = []
        langs = table["lang"]
        for lang in langs.unique().to_pylist():
            some = table.filter(pa.compute.equal(langs, lang))
            for kind, of, a, b, c, w in of_language(lang, some):
                if not len(w):
                    continue
                found.append(
                    pa.table(
                        {
                            "kind": pa.array([kind] * len(w)),
                            "lang": pa.array([of] * len(w)),
                            "a": text(a), "b": text(b), "c": text(c),
                            "w": pa.array(w, pa.int64()),
                        }
                    )
                )
        return pa.concat_tables(found)

    return run


def _hot_words(texts: DataFrame, rows: int) -> frozenset[bytes]:
    if not rows:
        return frozenset()
    some = texts.sample(min(1.0, SAMPLE_TEXTS / rows), 1).limit(2 * SAMPLE_TEXTS)
    counts: Counter[bytes] = Counter()
    for row in some.select(F.substring("text", 1, SAMPLE_CHARS).alias("text")).toLocalIterator():
        counts.update(_TOKEN.findall((row.text or "").encode().lower()))
    return frozenset(word for word, _ in counts.most_common(HOT_WORDS + len(_ENDS)))


def _paths(edge: DataFrame, staging: Staging) -> tuple[DataFrame, DataFrame]:
    """Unary paths of the graph in one row each, and the nodes inside them.

    `edge` carries the flow of the node where it starts and of the one where it ends. Where
    one edge brings a node's whole flow and one takes it, they are neighbours on a path.
    Places on the paths are found by doubling pointers: each round halves the distance to
    the first edge. A path that closes to a ring has no first edge; its edges stay apart.
    A path lies inside one piece of text, so it is as short as that.
    """
    comes = edge.where("w = to_flow").select("lang", F.col("b").alias("a"), F.col("c").alias("b"), F.col("id").alias("at"))
    goes = edge.where("w = from_flow").select("lang", "a", "b", "id")
    inside = staging.save(comes.join(goes, ["lang", "a", "b"]), "inside")
    steps = staging.save(inside.select("id", "at", F.lit(1).cast("long").alias("place")), "steps")
    rounds = steps.count().bit_length() + 1
    for _ in range(rounds):
        before = steps.select(
            F.col("id").alias("at"), F.col("at").alias("further"), F.col("place").alias("more")
        )
        steps = staging.save(
            steps.join(before, "at", "left").select(
                "id",
                F.coalesce("further", "at").alias("at"),
                (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"),
                F.col("further").isNotNull().alias("going"),
            ),
            "steps",
        )
        if steps.where("going").isEmpty():
            break
    # After that many rounds only those on rings still go on.
    ended = steps.where("not going").drop("going")
    placed = edge.join(ended, "id", "left").select(
        F.coalesce("at", "id").alias("path"), F.coalesce("place", F.lit(0)).alias("place"),
        "lang", "a", "b", "c", "w", "from_flow", "to_flow",
    )
    row = F.struct("place", "a", "b", "c", "from_flow", "to_flow")
    paths = placed.groupBy("lang", "path").agg(
        F.array_sort(F.collect_list(row)).alias("steps"), F.min("w").alias("w")
    )
    return paths.select(
        "lang",
        "w",
        F.concat(
            F.array(F.col("steps")[0]["a"], F.col("steps")[0]["b"]),
            F.transform("steps", lambda step: step["c"]),
        ).alias("words"),
        F.col("steps")[0]["from_flow"].alias("from_flow"),
        F.element_at("steps", -1)["to_flow"].alias("to_flow"),
    ), inside.select("lang", "a", "b")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), in decimals of 38 digits."""

    def exact(x: Column) -> Column:
        return x.cast("decimal(15,0)")

    above = F.lit(1000000).cast("decimal(7,0)") * exact(a) * exact(a)
    return F.call_function("div", above, exact(left) * exact(right))


def collocations(
    docs: DataFrame,
    staging: Staging,
    min_count: int = MIN_COUNT,
    drop_percent: int = DROP_PERCENT,
    top: int = TOP,
) -> DataFrame:
    """Each language's `top` phrases of two and three words: lang, rank, phrase, a, l, r, n, score.

    Texts, A-Z lower-cased, are split at `.,;:!?` and line ends into pieces and at blanks and tabs
    into words. `a` counts a phrase's occurrences within pieces, `n` all words of the
    language. Of a phrase's cuts the one with the lowest score counts, among equal ones the
    first; `l` and `r` count its two sides. A phrase of two that stands in one of three with at
    least `drop_percent` (1 to 100) of its occurrences is left out. Equal scores go by `a`, then by phrase.

    A NULL lang is `und`; NULL and empty texts have no words, repeated rows count each time,
    other columns are left aside. Without a phrase of `min_count` occurrences there are no rows.
    Counts are exact up to 10^15.

    Three words in a row are an edge between nodes of two. Tasks send the graphs of their texts, in which
    equal edges are added up; buckets of nodes are merged. The shorter counts come from the graph: a node
    occurs as often as its edges and the pieces that end there say, a word as often as the nodes that begin
    with it and the pieces that end with it. Paths without branches are then made one row
    each; the nodes inside occur as often as the path and are left out with it.
    """
    if not 1 <= drop_percent <= 100:
        raise ValueError("drop_percent must be from 1 to 100")
    spark = docs.sparkSession
    ship_code(spark)
    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"),
        F.col("text").cast("string").alias("text"),
    )
    size = texts.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    hot = spark.sparkContext.broadcast(_hot_words(texts, size.rows))
    buckets = max(shuffle_partitions(spark), (size.bytes or 0) // BUCKET_BYTES + 1)
    counted = staging.save(
        texts.mapInArrow(_graphs(buckets, hot), GRAPH)
        .repartition(buckets, "bucket")
        .groupBy("bucket")
        .applyInArrow(_merged(min_count, hot), COUNTED),
        "counted",
    )

    node = counted.where("kind = 'node'").select("lang", "a", "b", F.col("w").alias("flow"))
    spread = counted.where("kind = 'part'").groupBy("lang", "a", "b").agg(F.sum("w").alias("flow"))
    node = staging.save(node.unionByName(spread.where(F.col("flow") >= min_count)), "nodes")
    word = counted.where("kind = 'word'").select("lang", F.col("a").alias("word"), F.col("w").alias("count"))
    total = counted.where("kind = 'total'").groupBy("lang").agg(F.sum("w").alias("n"))

    start = node.withColumnRenamed("flow", "from_flow")
    end = node.select("lang", F.col("a").alias("b"), F.col("b").alias("c"), F.col("flow").alias("to_flow"))
    edge = staging.save(
        counted.where("kind = 'edge'")
        .drop("kind")
        .join(start, ["lang", "a", "b"])
        .join(end, ["lang", "b", "c"])
        .withColumn("id", F.monotonically_increasing_id()),
        "edges",
    )
    paths, inside = _paths(edge, staging)

    place = F.col("place")
    three = paths.select("*", F.explode(F.sequence(F.lit(0), F.size("words") - 3)).alias("place")).select(
        "lang",
        F.get("words", place).alias("first"),
        F.get("words", place + 2).alias("last"),
        F.concat_ws(" ", F.slice("words", place + 1, 3)).alias("phrase"),
        F.col("w").alias("a"),
        F.when(place == 0, F.col("from_flow")).otherwise(F.col("w")).alias("left_two"),
        F.when(place == F.size("words") - 3, F.col("to_flow")).otherwise(F.col("w")).alias("right_two"),
    )
    longer = (
        edge.select("lang", "a", "b", "w")
        .unionByName(edge.select("lang", F.col("b").alias("a"), F.col("c").alias("b"), "w"))
        .groupBy("lang", "a", "b")
        .agg(F.max("w").alias("longer"))
    )
    two = (
        node.join(inside, ["lang", "a", "b"], "left_anti")
        .join(longer, ["lang", "a", "b"], "left")
        .where(F.coalesce(100 * F.col("longer") < drop_percent * F.col("flow"), F.lit(True)))
        .select(
            "lang",
            F.col("a").alias("first"),
            F.col("b").alias("last"),
            F.concat_ws(" ", "a", "b").alias("phrase"),
            F.col("flow").alias("a"),
            F.lit(None).cast("long").alias("left_two"),
            F.lit(None).cast("long").alias("right_two"),
        )
    )
    first = word.select("lang", F.col("word").alias("first"), F.col("count").alias("first_count"))
    last = word.select("lang", F.col("word").alias("last"), F.col("count").alias("last_count"))
    cut = (
        two.unionByName(three)
        .join(first, ["lang", "first"])
        .join(last, ["lang", "last"])
        .withColumn("right", F.coalesce("right_two", "last_count"))
        .withColumn("score_1", _score(F.col("a"), F.col("first_count"), F.col("right")))
        .withColumn("score_2", _score(F.col("a"), F.col("left_two"), F.col("last_count")))
    )
    second = F.coalesce(F.col("score_2") < F.col("score_1"), F.lit(False))
    scored = cut.select(
        "lang",
        "phrase",
        "a",
        F.when(second, F.col("left_two")).otherwise(F.col("first_count")).alias("l"),
        F.when(second, F.col("last_count")).otherwise(F.col("right")).alias("r"),
        F.when(second, F.col("score_2")).otherwise(F.col("score_1")).alias("score"),
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        scored.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
        .join(total, "lang")
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )
