"""Packs documents into training windows by counts that a least-squares fit has found."""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagepath.llm import tokens
from stagepath.llm.common import ship_code
from stagepath.staging import Staging

WINDOW = 2048
END_ID = 1
BINS = 128
DEPTH = 4
FLUSH_BYTES = 4 << 20

PIECES = (
    "doc_id long, start long, length long, doc_tokens long, ids binary, ids_crc32 long,"
    " task int, bin int, rank long"
)
PACKED = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long,"
    " sequence_id long, offset long, ids binary"
)


def cut_documents(
    docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, bins: int = BINS
) -> DataFrame:
    """Each document's ids and an end id, cut into whole windows and a rest.

    `bin` says into how many parts of a window the rest fits, 0 is a whole window;
    `rank` counts the pieces of a bin within the task. A NULL text is empty.
    """
    step = window // bins
    kind = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
         ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64()),
         ("task", pa.int32()), ("bin", pa.int32()), ("rank", pa.int64())]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = tokens.encoder(path), TaskContext.get().partitionId()
        seen: Counter[int] = Counter()
        rows, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encoder.encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                small = ids.max() < 1 << 16
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    part = 0 if len(piece) == window else -(-len(piece) // step)
                    held = piece.astype("<u2") if small else piece
                    rows.append((doc_id, start, len(piece), len(ids), held.tobytes(), zlib.crc32(piece),
                                 task, part, seen[part]))
                    seen[part] += 1
                    size += held.nbytes + 64
                if size > FLUSH_BYTES:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind
                    )
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def combinations(bins: int = BINS, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Every way of filling a window with at most `depth` bins, largest first."""
    found = []
    for n in range(1, depth + 1):
        for tail in itertools.combinations_with_replacement(range(1, bins), n - 1):
            head = bins - sum(tail)
            if head >= max(tail, default=1):
                found.append((head, *tail[::-1]))
    return found


def non_negative_least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by growing and pruning the set of positive entries."""
    x = np.zeros(a.shape[1])
    active = np.zeros(a.shape[1], bool)
    limit = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(3 * a.shape[0]):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= limit:
            break
        active[best] = True
        while True:
            fit = np.zeros_like(x)
            fit[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if (fit[active] > 0).all():
                break
            falls = active & (fit <= 0)
            reach = (x[falls] / np.maximum(x[falls] - fit[falls], 1e-300)).min(initial=1.0)
            x = x + reach * (fit - x)
            active &= x > 1e-12
            x[~active] = 0
        x = fit
    return x


@dataclass(frozen=True)
class Plan:
    """For each bin, which ranks go to which window: sorted first ranks and, beside each,
    the combination's first window, how often it holds the bin, and the place of the
    first of these. Ranks from `taken` on are left over."""

    firsts: dict[int, np.ndarray]
    windows: dict[int, np.ndarray]
    times: dict[int, np.ndarray]
    places: dict[int, np.ndarray]
    taken: dict[int, int]
    n_windows: int


def plan_windows(histogram: dict[int, int], bins: int = BINS, depth: int = DEPTH) -> Plan:
    """Repeat counts for the combinations that use up the histogram.

    The fit is rounded down and cut back to what is there; what rounding leaves is
    then filled with further whole combinations, those of few pieces first.
    """
    ways = combinations(bins, depth)
    left = np.array([histogram.get(b, 0) for b in range(bins + 1)], np.int64)
    matrix = np.zeros((bins, len(ways)))
    for column, way in enumerate(ways):
        for b in way:
            matrix[b - 1, column] += 1
    fit = non_negative_least_squares(matrix, left[1:].astype(float))
    repeats = np.zeros(len(ways), np.int64)
    fitted = [(column, int(fit[column])) for column in np.argsort(-fit, kind="stable")]
    for column, wanted in [*fitted, *((column, None) for column in range(len(ways)))]:
        way = Counter(ways[column])
        add = min(int(left[b]) // n for b, n in way.items())
        if wanted is not None:
            add = min(add, wanted)
        repeats[column] += add
        for b, n in way.items():
            left[b] -= n * add

    spans: dict[int, list[tuple[int, int, int, int]]] = {b: [] for b in range(1, bins + 1)}
    used, window = Counter(), 0
    for column in np.flatnonzero(repeats):
        place = 0
        for b, n in sorted(Counter(ways[column]).items(), reverse=True):
            spans[b].append((used[b], window, n, place))
            used[b] += n * int(repeats[column])
            place += n
        window += int(repeats[column])
    columns = {b: np.array(rows, np.int64).reshape(-1, 4).T for b, rows in spans.items()}
    return Plan(
        *({b: rows[i] for b, rows in columns.items()} for i in range(4)),
        taken={b: used[b] for b in spans},
        n_windows=window,
    )


def _places(plan: Plan, bins: pd.Series, ranks: pd.Series) -> pd.DataFrame:
    part, rank = bins.to_numpy(), ranks.to_numpy()
    window = np.full(len(part), -1, np.int64)
    place = np.zeros(len(part), np.int32)
    for b in np.unique(part):
        mine = np.flatnonzero((part == b) & (rank < plan.taken.get(int(b), 0)))
        if b == 0 or not len(mine):
            continue
        at = np.searchsorted(plan.firsts[b], rank[mine], side="right") - 1
        inside = rank[mine] - plan.firsts[b][at]
        window[mine] = plan.windows[b][at] + inside // plan.times[b][at]
        place[mine] = plan.places[b][at] + inside % plan.times[b][at]
    return pd.DataFrame({"window": window, "place": place})


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts each row's ids to its part and adds their checksum."""
    names = ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "skip", "stored")
    for batch in batches:
        doc_id, start, length, doc_tokens, sequence, offset, skip, stored = (
            batch.column(c).to_pylist() for c in names
        )
        sums, parts = [], []
        for at, data in enumerate(batch.column("ids")):
            raw = data.as_py()
            ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * stored[at] else "<u4")
            part = ids[skip[at] : skip[at] + length[at]].astype("<u4").tobytes()
            sums.append(zlib.crc32(part))
            parts.append(part)
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc_id, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
             pa.array(sums, pa.int64()), pa.array(doc_tokens, pa.int64()),
             pa.array(sequence, pa.int64()), pa.array(offset, pa.int64()), pa.array(parts, pa.binary())],
            ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
        )


def pack(
    docs: DataFrame,
    staging: Staging,
    path: str | None = None,
    window: int = WINDOW,
    end_id: int = END_ID,
    bins: int = BINS,
    depth: int = DEPTH,
    with_ids: bool = True,
) -> DataFrame:
    """Every document's ids in sequences of at most `window` tokens with little padding.

    Whole windows are cut from each document and stand alone. The rests are counted
    by length, in `bins` steps; combinations of up to `depth` lengths that fill a window
    are fitted to the counts by non-negative least squares. A rest's rank within its
    length says which window and place it takes, so no task ever sees more than a
    window. What is left over is laid end to end and cut at every window.

    The ranks come from counts per task added up in order: a length that a third of
    all documents share is spread over all tasks. The driver sees the histogram only.

    NULL text is empty and gives the end id alone; rows with equal doc_id are packed
    each for itself; other columns are left aside; an empty table gives no rows. A text of any
    length is cut. Returns a row per piece with its ids (little-endian unsigned 32-bit) and their
    checksum. Without `with_ids` the ids are read again only for what is left over.
    """
    spark = docs.sparkSession
    ship_code(spark)
    path = path or public_tokenizers.path(tokens.VOCABULARY)
    stored = staging.path("pieces")
    cut_documents(docs, path, window, end_id, bins).write.option("compression", "zstd").parquet(stored)
    pieces = spark.read.schema(PIECES).parquet(stored)

    counts = staging.save(pieces.groupBy("task", "bin").agg(F.count("*").alias("n")), "counts")
    total = {row.bin: row.n for row in counts.groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    plan = plan_windows({b: n for b, n in total.items() if b}, bins, depth)

    # One row per task: how many pieces of each bin lie in the tasks before it.
    earlier = Window.partitionBy("bin").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .groupBy("task")
        .agg(F.map_from_entries(F.collect_list(F.struct("bin", "before"))).alias("before"))
    )

    @F.pandas_udf("window long, place int")
    def places(part: pd.Series, rank: pd.Series) -> pd.DataFrame:
        return _places(plan, part, rank)

    ranked = (
        pieces.join(before, "task")
        .withColumn("rank", F.col("rank") + F.col("before")[F.col("bin")])
        .drop("before")
    )
    whole = ranked.where("bin = 0")
    rests = ranked.where("bin > 0").withColumn("to", places("bin", "rank"))

    in_window = Window.partitionBy("to.window").orderBy("to.place")
    ids = ["ids"] if with_ids else []
    combined = rests.where("to.window >= 0").select(
        "doc_id", "start", "length", "doc_tokens", *ids, "ids_crc32",
        F.col("to.window").alias("sequence_id"),
        F.coalesce(
            F.sum("length").over(in_window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("offset"),
    )

    # What is left over lies end to end: by task, then by length, the longest first.
    left = rests.where("to.window < 0")
    by_task = staging.save(
        left.groupBy("task").agg(F.sum("length").alias("tokens")), "left-over"
    )
    tasks = Window.orderBy("task")  # one row per task
    base = by_task.select(
        "task",
        (F.sum("tokens").over(tasks.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")).alias("base"),
    )
    of_task = Window.partitionBy("task").orderBy(F.desc("bin"), "rank")
    laid = left.join(base, "task").withColumn(
        "at", F.col("base") + F.sum("length").over(of_task.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    )
    cuts = laid.withColumn(
        "nth", F.explode(F.expr(f"sequence(at div {window}, (at + length - 1) div {window})"))
    )
    low = F.greatest("at", F.col("nth") * window)
    high = F.least(F.col("at") + F.col("length"), (F.col("nth") + 1) * window)
    streamed = cuts.select(
        "doc_id", (F.col("start") + low - F.col("at")).alias("start"), (high - low).alias("length"),
        "doc_tokens", "ids",
        (F.col("nth") + plan.n_windows).alias("sequence_id"),
        (low - F.col("nth") * window).alias("offset"),
        (low - F.col("at")).alias("skip"), F.col("length").alias("stored"),
    )
    n_left = by_task.agg(F.sum("tokens")).first()[0] or 0
    alone = plan.n_windows + -(-n_left // window)
    filled = whole.select(
        "doc_id", "start", "length", "doc_tokens", *ids, "ids_crc32",
        (F.col("rank") + alone).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    uncut = filled.unionByName(combined)
    if not with_ids:
        return uncut.unionByName(streamed.mapInArrow(_finish, PACKED).drop("ids")).select(
            "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
        )
    rows = uncut.drop("ids_crc32").withColumns({"skip": F.lit(0), "stored": F.col("length")})
    return rows.unionByName(streamed).mapInArrow(_finish, PACKED)
