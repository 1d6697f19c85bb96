"""Toxicity of whole texts by a bidirectional gated recurrent network with attention pooling."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagepath.llm.common import ship_code
from stagepath.llm.textbytes import as_bytes, parts
from stagepath.staging import Staging

#: Words of a window; windows begin at every half of it.
WINDOW = 64
STRIDE = WINDOW // 2
#: What the network is fitted on at most: labelled documents of each class, windows of each.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_WINDOWS = 1500, 3000, 8
STEPS, BATCH, RATE = 700, 64, 0.02
#: How fast vectors of words fade.
DECAY = 0.5

#: Words with a vector of their own: at most so many, each met between so many pairs of neighbours.
WORD_ROWS, WORD_NEIGHBOURS = 1 << 14, 20
#: Runs of three bytes that fewer words of the sample hold stay without meaning.
TRIGRAM_ROWS, TRIGRAM_WORDS = 1 << 15, 20
EMBEDDED, HIDDEN, ATTENTION = 8, 8, 8
#: Windows that are scored at once, words that are held for it, and words whose inputs are kept.
WINDOWS_AT_ONCE, HELD_WORDS, KEPT_WORDS = 512, 1 << 20, 1 << 18

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")

RESULT = "doc_id long, held_out boolean, score double, predicted int"

Arrays = dict[str, np.ndarray]


def words_of(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text, A-Z lower-cased, in parts of bounded size."""
    for part in parts(text or b"", _GAP):
        yield _WORD.findall(part.lower())


def word_inputs(words: list[bytes], own: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row of each word in the table of words (0 for one without its own), the rows of all its
    runs of three bytes (marks at both ends counted) one word after another, and how many each word has."""
    rows = np.fromiter((own.get(word, 0) for word in words), np.int64, len(words))
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer(b"".join(b"\x02" + word + b"\x03" for word in words), np.uint8).astype(np.uint32)
    mixed = (flat[:-2] * np.uint32(66_049) + flat[1:-1] * np.uint32(257) + flat[2:]) * np.uint32(2654435761)
    inside = np.ones(len(flat), bool)
    last = np.cumsum(counts + 2) - 1
    inside[last] = inside[last - 1] = False
    return rows, (mixed >> np.uint32(17))[inside[:-2]].astype(np.int64), counts


def new_network(words: int, seed: int = 5) -> Arrays:
    random = np.random.default_rng(seed)

    def normal(*shape: int, scale: float) -> np.ndarray:
        return (random.standard_normal(shape) * scale).astype(np.float32)

    network = {
        "words": np.zeros((words, EMBEDDED), np.float32),
        "trigrams": np.zeros((TRIGRAM_ROWS, EMBEDDED), np.float32),
        "attend": normal(2 * HIDDEN, ATTENTION, scale=0.3),
        "attend_bias": np.zeros(ATTENTION, np.float32),
        "focus": normal(ATTENTION, scale=0.3),
        "out": normal(2 * HIDDEN, scale=0.3),
        "out_bias": np.zeros(1, np.float32),
    }
    for way in ("ahead", "back"):
        network[f"{way}_in"] = normal(2 * EMBEDDED, 3 * HIDDEN, scale=0.4)
        network[f"{way}_bias"] = np.zeros(3 * HIDDEN, np.float32)
        network[f"{way}_state"] = normal(HIDDEN, 3 * HIDDEN, scale=0.3)
    return network


def embed(network: Arrays, inputs) -> np.ndarray:
    """A word's vector: its own, and the mean of those of its runs of three bytes."""
    rows, trigrams, counts = inputs
    starts = np.cumsum(counts) - counts
    mean = np.add.reduceat(network["trigrams"][trigrams], starts, axis=0) / counts[:, None]
    return np.concatenate([network["words"][rows], mean], axis=1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _gates(entered: np.ndarray, state: np.ndarray, weights: np.ndarray):
    """One step: update gate, reset gate, proposal and its share of the state, and the new state."""
    moved = state @ weights
    both = _sigmoid(entered[:, : 2 * HIDDEN] + moved[:, : 2 * HIDDEN])
    update, reset, share = both[:, :HIDDEN], both[:, HIDDEN:], moved[:, 2 * HIDDEN :]
    proposal = np.tanh(entered[:, 2 * HIDDEN :] + reset * share)
    return update, reset, proposal, share, proposal + update * (state - proposal)


def run_gates(entered: np.ndarray, real: np.ndarray, weights: np.ndarray, keep: list | None = None) -> np.ndarray:
    """The states after each step of (steps, windows, 3 * HIDDEN) inputs; 0 where a window has no word."""
    states = np.empty((*entered.shape[:2], HIDDEN), np.float32)
    state = np.zeros((entered.shape[1], HIDDEN), np.float32)
    for at in range(len(entered)):
        update, reset, proposal, share, new = _gates(entered[at], state, weights)
        if keep is not None:
            keep.append((state, update, reset, proposal, share))
        state = new * real[at]
        states[at] = state
    return states


def pool(network: Arrays, states: np.ndarray, real: np.ndarray):
    """Attention over the states of each window: its weights, what they come from, and the mean."""
    bent = np.tanh(states @ network["attend"] + network["attend_bias"])
    height = np.where(real[..., 0] > 0, bent @ network["focus"], -np.inf)
    weight = np.exp(height - height.max(axis=0))
    weight /= weight.sum(axis=0)
    return bent, weight, (weight[..., None] * states).sum(axis=0)


def logits(network: Arrays, entered: dict[str, np.ndarray], windows: np.ndarray, real: np.ndarray) -> np.ndarray:
    """The log odds of windows, given as (windows, steps) rows of the words' inputs."""
    steps, mask = windows.T, real.T[..., None].astype(np.float32)
    ahead = run_gates(entered["ahead"][steps], mask, network["ahead_state"])
    back = run_gates(entered["back"][steps[::-1]], mask[::-1], network["back_state"])[::-1]
    _, _, mean = pool(network, np.concatenate([ahead, back], axis=2), mask)
    return mean @ network["out"] + network["out_bias"][0]


def enter(network: Arrays, vectors: np.ndarray) -> dict[str, np.ndarray]:
    """What each word brings to the gates, in both directions."""
    return {way: vectors @ network[f"{way}_in"] + network[f"{way}_bias"] for way in ("ahead", "back")}


def _sums(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((size, values.shape[1]), np.float32)
    order = np.argsort(rows, kind="stable")
    found, starts = np.unique(rows[order], return_index=True)
    if len(found):
        out[found] = np.add.reduceat(values[order], starts, axis=0)
    return out


def gradients(network: Arrays, inputs, windows: np.ndarray, real: np.ndarray, toxic: np.ndarray) -> tuple[float, Arrays]:
    """The mean cross-entropy of windows and its slope in every parameter."""
    vectors = embed(network, inputs)
    entered = enter(network, vectors)
    steps, mask = windows.T, real.T[..., None].astype(np.float32)
    kept = {"ahead": [], "back": []}
    ahead = run_gates(entered["ahead"][steps], mask, network["ahead_state"], kept["ahead"])
    back = run_gates(entered["back"][steps[::-1]], mask[::-1], network["back_state"], kept["back"])[::-1]
    states = np.concatenate([ahead, back], axis=2)
    bent, weight, mean = pool(network, states, mask)
    odds = mean @ network["out"] + network["out_bias"][0]
    loss = float(np.mean(np.logaddexp(0, odds) - toxic * odds))

    slope: Arrays = {}
    d_odds = ((_sigmoid(odds) - toxic) / len(toxic)).astype(np.float32)
    slope["out"], slope["out_bias"] = d_odds @ mean, d_odds.sum(keepdims=True)
    d_mean = d_odds[:, None] * network["out"]
    d_weight = (states * d_mean).sum(axis=2)
    d_height = weight * (d_weight - (weight * d_weight).sum(axis=0))
    d_bent = d_height[..., None] * network["focus"] * (1 - bent**2)
    slope["focus"] = (d_height[..., None] * bent).sum(axis=(0, 1))
    slope["attend_bias"] = d_bent.sum(axis=(0, 1))
    slope["attend"] = np.tensordot(states, d_bent, axes=([0, 1], [0, 1]))
    d_states = weight[..., None] * d_mean + d_bent @ network["attend"].T

    d_vectors = np.zeros_like(vectors)
    for way, turn, share in (("ahead", 1, slice(0, HIDDEN)), ("back", -1, slice(HIDDEN, None))):
        d_out, at_step, its_mask = d_states[::turn, :, share], steps[::turn], mask[::turn]
        weights = network[f"{way}_state"]
        d_weights = np.zeros_like(weights)
        d_entered = np.empty((*steps.shape, 3 * HIDDEN), np.float32)
        d_state = np.zeros((steps.shape[1], HIDDEN), np.float32)
        for at in range(len(steps) - 1, -1, -1):
            before, update, reset, proposal, moved = kept[way][at]
            d_state = (d_state + d_out[at]) * its_mask[at]
            d_proposal = d_state * (1 - update) * (1 - proposal**2)
            d_update = d_state * (before - proposal) * update * (1 - update)
            d_reset = d_proposal * moved * reset * (1 - reset)
            d_entered[at] = np.concatenate([d_update, d_reset, d_proposal], axis=1)
            d_moved = np.concatenate([d_update, d_reset, d_proposal * reset], axis=1)
            d_weights += before.T @ d_moved
            d_state = d_state * update + d_moved @ weights.T
        slope[f"{way}_state"] = d_weights
        per_word = _sums(at_step.reshape(-1), d_entered.reshape(-1, 3 * HIDDEN), len(vectors))
        slope[f"{way}_in"], slope[f"{way}_bias"] = vectors.T @ per_word, per_word.sum(axis=0)
        d_vectors += per_word @ network[f"{way}_in"].T
    rows, trigrams, counts = inputs
    slope["words"] = _sums(rows, d_vectors[:, :EMBEDDED], len(network["words"]))
    slope["words"][0] = 0
    shared = np.repeat(d_vectors[:, EMBEDDED:] / counts[:, None], counts, axis=0)
    slope["trigrams"] = _sums(trigrams, shared, TRIGRAM_ROWS)
    return loss, slope


def _some_inputs(inputs, starts: np.ndarray, chosen: np.ndarray):
    rows, trigrams, counts = inputs
    size = counts[chosen]
    ends = np.cumsum(size)
    places = np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(starts[chosen], size)
    return rows[chosen], trigrams[places], size


class Fitted:
    """A network, the rows of the words that have their own, and the share of toxic documents fitted on."""

    def __init__(self, network: Arrays | None, own: dict[bytes, int], share: float):
        self.network, self.own, self.share = network, own, share


def own_rows(windows: list[list[bytes]]) -> dict[bytes, int]:
    """Rows, from 1, for the words met between most different neighbours.

    Others would only stand for the text that they are from, or for its copies.
    """
    met: set[tuple[bytes, ...]] = set()
    for words in windows:
        met.update(zip(words, [b"", *words], [*words[1:], b""]))
    held = Counter(word for word, _, _ in met)
    often = sorted((-n, word) for word, n in held.items() if n >= WORD_NEIGHBOURS)
    return {word: row for row, (_, word) in enumerate(often[: WORD_ROWS - 1], 1)}


def _often(inputs) -> np.ndarray:
    """Which runs of three bytes enough different words hold."""
    _, trigrams, counts = inputs
    held = np.unique(np.repeat(np.arange(len(counts)), counts) * TRIGRAM_ROWS + trigrams)
    return np.bincount(held % TRIGRAM_ROWS, minlength=TRIGRAM_ROWS) >= TRIGRAM_WORDS


def fit(windows: list[list[bytes]], owners: np.ndarray, toxic: np.ndarray, share: float,
        steps: int = STEPS, seed: int = 5) -> Fitted:
    """Fits a network to windows of words whose documents (`owners`) are toxic or not.

    A label is the document's, so not every window of a toxic one need be toxic. After two
    fifths of the steps, and again after seven tenths, windows of toxic documents are left
    out that the network takes for clean, but for the highest of each document, and clean
    windows are drawn by how toxic they seem. With one class alone nothing is fitted.
    """
    if not len(toxic) or toxic.min() == toxic.max():
        return Fitted(None, {}, share)
    random = np.random.default_rng(seed)
    number: dict[bytes, int] = {}
    size = max(map(len, windows))
    table = np.zeros((len(windows), size), np.int64)
    real = np.zeros((len(windows), size), bool)
    for at, words in enumerate(windows):
        table[at, : len(words)] = [number.setdefault(word, len(number)) for word in words]
        real[at, : len(words)] = True
    own = own_rows(windows)
    inputs = word_inputs(list(number), own)
    starts = np.cumsum(inputs[2]) - inputs[2]

    often = _often(inputs)[:, None]
    network = new_network(len(own) + 1, seed)
    mean = {name: np.zeros_like(value) for name, value in network.items()}
    square = {name: np.zeros_like(value) for name, value in network.items()}
    chance = {of: np.where(toxic == of, 1.0, 0.0) for of in (0, 1)}
    for step in range(1, steps + 1):
        if step in (1 + 2 * steps // 5, 1 + 7 * steps // 10):
            entered = enter(network, embed(network, inputs))
            odds = np.concatenate(
                [
                    logits(network, entered, table[low : low + 512], real[low : low + 512])
                    for low in range(0, len(table), 512)
                ]
            )
            highest = np.full(owners.max() + 1, -np.inf)
            np.maximum.at(highest, owners, odds)
            chance[1] = ((toxic == 1) & ((odds > 0) | (odds == highest[owners]))).astype(float)
            chance[0] = np.where(toxic == 0, 0.05 + _sigmoid(odds), 0.0)
        batch = np.concatenate(
            [random.choice(len(table), BATCH // 2, p=chance[of] / chance[of].sum()) for of in (0, 1)]
        )
        used, local = np.unique(table[batch], return_inverse=True)
        _, slope = gradients(
            network, _some_inputs(inputs, starts, used), local.reshape(len(batch), size), real[batch],
            toxic[batch].astype(np.float32),
        )
        slope["trigrams"] *= often
        rate = RATE * min(1.0, step / 20) * (1.05 - step / steps)
        for name, value in network.items():
            mean[name] += 0.1 * (slope[name] - mean[name])
            square[name] += 0.01 * (slope[name] ** 2 - square[name])
            scaled = (mean[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.99**step)) + 1e-8)
            value -= np.float32(rate) * scaled.astype(np.float32)
            if name in ("words", "trigrams"):
                value *= np.float32(1 - rate * DECAY)
    return Fitted(network, own, share)


class Known(dict):
    """Numbers the words that a task meets."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class Scorer:
    """Scores texts with a fitted network; keeps what known words bring to the gates."""

    def __init__(self, fitted: Fitted):
        self.fitted = fitted
        self._forget()

    def _forget(self) -> None:
        self.known, self.entered = Known(), None

    def _learn(self) -> None:
        have = 0 if self.entered is None else len(self.entered["ahead"])
        if len(self.known) == have:
            return
        new = enter(self.fitted.network, embed(self.fitted.network, word_inputs(list(self.known)[have:], self.fitted.own)))
        if self.entered is None:
            self.entered = new
        else:
            self.entered = {way: np.concatenate([self.entered[way], new[way]]) for way in new}

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        """The highest chance of any window of each text; without words the share of toxic texts."""
        out = np.full(len(texts), self.fitted.share)
        if self.fitted.network is None:
            return out
        held: list[tuple[int, np.ndarray]] = []
        size = 0
        for at, text in enumerate(texts):
            numbers = [np.fromiter(map(self.known.__getitem__, some), np.int32, len(some)) for some in words_of(text)]
            sequence = np.concatenate(numbers)
            if len(sequence):
                held.append((at, sequence))
                size += len(sequence)
            if size >= HELD_WORDS:
                self._score(held, out)
                held, size = [], 0
        self._score(held, out)
        return out

    def _score(self, held: list[tuple[int, np.ndarray]], out: np.ndarray) -> None:
        if not held:
            return
        self._learn()
        sequence = np.concatenate([numbers for _, numbers in held])
        owners, starts, sizes, offset = [], [], [], 0
        for at, numbers in held:
            n = len(numbers)
            first = np.arange(0, max(n - WINDOW, 0) + STRIDE, STRIDE)
            first = np.minimum(first, max(n - WINDOW, 0))
            first = np.unique(first)
            owners.append(np.full(len(first), at))
            starts.append(first + offset)
            sizes.append(np.minimum(n - first, WINDOW))
            offset += n
        owner, start, size = (np.concatenate(x) for x in (owners, starts, sizes))
        # Windows of like size go together, so that few places stay empty.
        order = np.argsort(size, kind="stable")
        best = np.full(len(out), -np.inf)
        for low in range(0, len(order), WINDOWS_AT_ONCE):
            rows = order[low : low + WINDOWS_AT_ONCE]
            steps = np.arange(size[rows].max())
            real = steps < size[rows][:, None]
            places = np.where(real, start[rows][:, None] + steps, 0)
            np.maximum.at(best, owner[rows], logits(self.fitted.network, self.entered, sequence[places], real))
        found = best > -np.inf
        # It was fitted on as many toxic windows as clean ones.
        out[found] = _sigmoid(best[found] + np.log(self.fitted.share / (1 - self.fitted.share)))
        if len(self.known) > KEPT_WORDS:
            self._forget()


def _windows(per_doc: int):
    """Up to so many windows of every document, spread evenly over it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            texts = as_bytes(batch.column(2))
            for doc, toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                words = [word for some in words_of(text) for word in some]
                if not words:
                    continue
                last = max(len(words) - WINDOW, 0)
                for first in sorted({round(last * i / max(per_doc - 1, 1)) for i in range(per_doc)}):
                    rows.append((doc, toxic, b" ".join(words[first : first + WINDOW])))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int32()),
                    pa.array([r[2] for r in rows], pa.binary()),
                ],
                ["row", "toxic", "words"],
            )

    return run


def held_out(doc_id: Column) -> Column:
    """Whether a document's label must not be learnt from; false for a NULL doc_id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def fit_on_sample(
    docs: DataFrame,
    labels: DataFrame,
    staging: Staging,
    toxic: int = SAMPLE_TOXIC,
    clean: int = SAMPLE_CLEAN,
    windows: int = SAMPLE_WINDOWS,
    steps: int = STEPS,
) -> Fitted:
    """A network fitted on a sample of labelled documents that are not held out.

    Of each class the documents with the smallest hashes of doc_id are taken, at most
    `toxic` and `clean`, of each at most `windows` windows, so what reaches the driver is
    bounded. Rows without a label or a document are left aside; of several labels of one
    document the highest counts. Texts are all that the network sees.
    """
    labelled = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    share = labelled.agg(F.avg("toxic").alias("share")).first().share or 0.0
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    some = labelled.where("toxic = 1").orderBy(*order).limit(toxic)
    some = staging.save(
        some.unionByName(labelled.where("toxic = 0").orderBy(*order).limit(clean)), "sample"
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Repeated rows of a document give its windows once more; one of them is enough.
    first = some.join(texts, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = (
        first.mapInArrow(_windows(windows), "row long, toxic int, words binary").orderBy("row", "words").collect()
    )
    _, owners = np.unique([row.row for row in rows], return_inverse=True)
    return fit(
        [bytes(row.words).split(b" ") for row in rows],
        owners,
        np.array([row.toxic for row in rows]),
        float(share),
        steps,
    )


def _score(fitted: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(fitted.value)
        for batch in batches:
            scores = scorer.scores(as_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, staging: Staging, **sample: int) -> DataFrame:
    """The chance of every document that it is toxic: doc_id, held_out, score, predicted.

    A network is fitted on a bounded sample of the labels of documents that are not held
    out (`sample`: the bounds, see `fit_on_sample`), then goes over every window of every text; the highest chance counts. Words are runs of
    ASCII letters and digits and of all other than ASCII, A-Z lower-cased; each enters by its own vector
    and those of its runs of three bytes.

    NULL and empty texts, and all texts when the labels do not show both classes, score the share of
    toxic ones among the labels (0 without any). Equal texts score alike, repeated rows are all returned,
    other columns are left aside, and an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship_code(spark)
    fitted = spark.sparkContext.broadcast(fit_on_sample(docs, labels, staging, **sample))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = texts.mapInArrow(_score(fitted), "doc_id long, score double")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
