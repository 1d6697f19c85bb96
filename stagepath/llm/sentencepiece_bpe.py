"""SentencePiece BPE ids by suffix-array matching of a batch's text, and their decoding."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagepath.llm.common import ship_code

MODEL = "piece_bpe_32k.model"
MARK = "▁"
LONGEST = 16
CACHED_SEGMENTS = 1 << 19
BATCH_CHARS = 1 << 22
INDEXED_CHARS = 1 << 19

_NONE = -1  # before a segment
_FAR = -2  # no edge has reached this place
_RUN = re.compile(f"{MARK}+")


@dataclass
class Vocabulary:
    """A BPE model's pieces in the order of their merges, which comes after single characters."""

    pieces: list[str]
    ids: np.ndarray  # model id of each token; -1 for a character without a piece
    left: np.ndarray  # the two tokens whose merge makes a token last; itself for characters
    right: np.ndarray
    pair_keys: np.ndarray  # sorted left * size + right of every merge, and what it makes
    pair_tokens: np.ndarray
    byte_ids: np.ndarray
    runs: list[list[int]]  # model ids of runs of marks, by length below the longest
    run_ids: dict[int, int]  # model id of each run's piece, and its length
    codes: dict[str, int]
    digest: str

    @property
    def unknown(self) -> int:
        return len(self.pieces)

    @property
    def longest_run(self) -> int:
        return len(self.runs) - 1


def _merge(symbols: list[str], score: dict[str, float]) -> list[str]:
    """Merges the best-scored adjacent pair, the leftmost of equals, while there is one."""
    while len(symbols) > 1:
        at = max(
            range(len(symbols) - 1),
            key=lambda i: (score.get(symbols[i] + symbols[i + 1], -np.inf), -i),
        )
        if symbols[at] + symbols[at + 1] not in score:
            break
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
    return symbols


def load(path: str) -> Vocabulary:
    """Reads a BPE model with byte fallback. Marks stand at the start of pieces or make up runs."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    score, number, byte_ids = {}, {}, np.zeros(256, np.int64)
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
        elif not (model.is_unknown(i) or model.is_control(i)):
            score[piece], number[piece] = model.get_score(i), i
    runs = {piece for piece in score if _RUN.fullmatch(piece)}
    if any(MARK in piece[1:] for piece in score.keys() - runs):
        raise ValueError("a piece of this model crosses the border of words")
    single = sorted(piece for piece in score if len(piece) == 1)
    merged = sorted((p for p in score if len(p) > 1 and p not in runs), key=lambda p: -score[p])
    if len({score[p] for p in merged}) != len(merged) or max(map(len, score)) > LONGEST:
        raise ValueError("the pieces of this model have no strict order or are too long")
    tokens = {piece: i for i, piece in enumerate(single)}
    left, right = list(range(len(single))), list(range(len(single)))
    kept, pairs = list(single), {}
    for piece in merged:
        symbols = list(piece)
        # The merges that lead to the piece are all better than its own.
        below = {p: s for p in {piece[i:j] for i in range(len(piece)) for j in range(i + 2, len(piece) + 1)}
                 if (s := score.get(p)) is not None and s > score[piece]}
        halves = _merge(symbols, below)
        if len(halves) != 2 or halves[0] not in tokens or halves[1] not in tokens:
            continue  # never made by merging
        pairs[tokens[halves[0]], tokens[halves[1]]] = len(kept)
        tokens[piece] = len(kept)
        left.append(tokens[halves[0]])
        right.append(tokens[halves[1]])
        kept.append(piece)
    size = len(kept) + 1  # one more for characters without a piece
    keys = np.array([a * size + b for a, b in pairs], np.int64)
    order = np.argsort(keys)
    run_score = {piece: score[piece] for piece in runs}
    return Vocabulary(
        kept,
        np.array([*(number[p] for p in kept), -1], np.int64),
        np.array([*left, len(kept)], np.int64),
        np.array([*right, len(kept)], np.int64),
        keys[order],
        np.fromiter(pairs.values(), np.int64, len(pairs))[order],
        byte_ids,
        [[number[p] for p in _merge([MARK] * n, run_score)] for n in range(max(map(len, runs), default=1) + 1)],
        {number[p]: len(p) for p in runs},
        {c: i + 2 for i, c in enumerate(sorted({c for p in kept for c in p}))},
        hashlib.sha256(repr(sorted(number.items())).encode()).hexdigest(),
    )


def compatible(words: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether merging leaves tokens a and b apart when they stand side by side.

    Takes back the merges of both, the latest first. At each step no merge may join what
    lies at the border before the one that was taken back there.
    """
    size = len(words.ids)
    apart = np.ones(len(a), bool)
    open_ = np.arange(len(a))
    a, b = a.copy(), b.copy()
    limit = np.full(len(a), size, np.int64)
    while len(open_):
        key = a * size + b
        at = np.minimum(np.searchsorted(words.pair_keys, key), len(words.pair_keys) - 1)
        joined = (words.pair_keys[at] == key) & (words.pair_tokens[at] < limit)
        apart[open_[joined]] = False
        back_a = words.right[a]
        back_b = words.left[b]
        whole_a, whole_b = back_a == a, back_b == b
        take_a = ~whole_a & ((a > b) | whole_b)
        go = ~joined & ~(whole_a & whole_b)
        limit = np.where(take_a, a, b + 1)
        a, b = np.where(take_a, back_a, a), np.where(take_a, b, back_b)
        open_, a, b, limit = open_[go], a[go], b[go], limit[go]
    return apart


class SuffixArray:
    """The places of a text sorted by the characters that follow, as far as the longest piece."""

    def __init__(self, codes: np.ndarray):
        wide = np.concatenate([codes, np.zeros(LONGEST, np.uint16)]).astype(np.uint64)
        four = sum(wide[j : len(wide) - 3 + j] << np.uint64(48 - 16 * j) for j in range(4))
        words = [four[4 * j : 4 * j + len(codes)] for j in range(4)]
        self.order = np.lexsort(words[::-1])
        self.words = [word[self.order] for word in words]

    def _bound(self, targets: list[np.ndarray], after: bool) -> np.ndarray:
        low = np.zeros(len(targets[0]), np.int64)
        high = np.full(len(targets[0]), len(self.order), np.int64)
        while (going := low < high).any():
            middle = (low + high) >> 1
            at = np.minimum(middle, len(self.order) - 1)
            less = np.full(len(low), after)
            for word, target in zip(self.words[::-1], targets[::-1], strict=True):
                here = word[at]
                less = (here < target) | ((here == target) & less)
            low = np.where(going & less, middle + 1, low)
            high = np.where(going & ~less, middle, high)
        return low

    def find(self, pieces: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For pieces as rows of codes padded with 0, the first and last place in the order."""
        inside = np.arange(LONGEST) < lengths[:, None]

        def packed(fill: int) -> list[np.ndarray]:
            rows = np.where(inside, pieces, fill).astype(np.uint64)
            return [sum(rows[:, 4 * j + i] << np.uint64(48 - 16 * i) for i in range(4)) for j in range(4)]

        return self._bound(packed(0), False), self._bound(packed(0xFFFF), True)


class Encoder:
    """Encodes batches of texts; segments seen before keep their ids until the cache is full."""

    def __init__(self, words: Vocabulary):
        self.words = words
        self.lengths = np.array([*map(len, words.pieces), 1], np.int64)
        self.rows = np.zeros((len(words.pieces), LONGEST), np.uint16)
        for i, piece in enumerate(words.pieces):
            self.rows[i, : len(piece)] = [words.codes[c] for c in piece]
        points = np.array([ord(c) for c in words.codes], np.uint32)
        self.code_of = np.ones(0x110000, np.uint16)  # 1: no piece has the character
        self.code_of[points] = np.fromiter(words.codes.values(), np.uint16, len(points))
        # The text of a token by its model id, bytes as they are.
        self.bytes_of = {int(i): p.replace(MARK, " ").encode() for p, i in zip(words.pieces, words.ids)}
        self.bytes_of |= {i: b" " * n for i, n in words.run_ids.items()}
        self.bytes_of |= {int(i): bytes([b]) for b, i in enumerate(words.byte_ids)}
        self.start_afresh()

    def start_afresh(self) -> None:
        self.known: dict[str, int] = {}
        self.starts = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, segments: list[str]) -> None:
        """Adds segments, each a mark and what follows it, to the cache, a bounded text at a time."""
        part, size = [], 0
        for segment in segments:
            part.append(segment)
            size += len(segment) + 2
            if size > INDEXED_CHARS:
                self._learn_part(part)
                part, size = [], 0
        if part:
            self._learn_part(part)

    def _learn_part(self, segments: list[str]) -> None:
        ids, counts = encode_segments(self, segments)
        ends = np.cumsum(counts)
        self.starts = np.concatenate([self.starts, len(self.ids) + ends - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
        for segment in segments:
            self.known[segment] = len(self.known)

    def _with_runs(self, words: list[str]) -> np.ndarray:
        """A text in which marks follow each other: each run goes to its own pieces."""
        mark = int(self.words.runs[1][0])
        parts, run = [], 0

        def run_ids(n: int) -> list[int]:
            whole, rest = divmod(n, self.words.longest_run)
            return self.words.runs[-1] * whole + self.words.runs[rest]

        for word in words:
            if not word:
                run += 1
                continue
            number = self.known[word]
            own = self.ids[self.starts[number] : self.starts[number] + self.counts[number]]
            if run and own[0] == mark:  # the word's own mark joins the run
                parts += [np.array(run_ids(run + 1), np.uint32), own[1:]]
            else:
                parts += [np.array(run_ids(run), np.uint32), own]
            run = 0
        parts.append(np.array(run_ids(run), np.uint32))
        return np.concatenate(parts)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text of a batch. Blanks and marks are the same, as in the model."""
        if len(self.known) > CACHED_SEGMENTS:
            self.start_afresh()
        apart = [text.replace(MARK, " ").split(" ") if text else [] for text in texts]
        new = dict.fromkeys(word for words in apart for word in words if word and word not in self.known)
        if new:
            self._learn(list(new))
        for words in apart:
            if not words:
                yield np.zeros(0, np.uint32)
            elif "" in words:
                yield self._with_runs(words)
            else:
                numbers = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
                counts = self.counts[numbers]
                ends = np.cumsum(counts)
                shift = np.repeat(self.starts[numbers] - (ends - counts), counts)
                yield self.ids[shift + np.arange(ends[-1])]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the blank before the first word is not part of it."""
        text = b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_encoders: dict[str, Encoder] = {}


def _encoder(words: Vocabulary) -> Encoder:
    """One encoder for all tasks of a worker; another vocabulary takes its place."""
    if words.digest not in _encoders:
        _encoders.clear()
        _encoders[words.digest] = Encoder(words)
    return _encoders[words.digest]


def encode_segments(encoder: Encoder, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Model ids of all segments in a row, and how many each has; a mark goes before each segment.

    The segments are laid end to end, each after a border, and indexed by a suffix
    array. Each piece's range of occurrences is found by binary search; its places are the
    lattice's edges. Edges are sorted by how far into their segment they end and relaxed
    in that order, all segments at once: of the tokens that end at a place, merging
    keeps the one that is compatible with the token kept where it begins.
    """
    words = encoder.words
    points = np.frombuffer(
        ("\0" + MARK + ("\0" + MARK).join(segments)).encode("utf-32-le", "surrogatepass"), np.uint32
    )
    sizes = np.array([len(segment) + 1 for segment in segments], np.int64)
    begins = np.cumsum(sizes + 1) - sizes
    codes = encoder.code_of[points]
    codes[begins - 1] = 0  # the borders
    index = SuffixArray(codes)
    low, high = index.find(encoder.rows, encoder.lengths[:-1])
    counts = high - low
    ends = np.cumsum(counts)
    at = index.order[np.repeat(low - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]
    token = np.repeat(np.arange(len(counts)), counts)
    other = np.flatnonzero(codes == 1)
    at, token = np.concatenate([at, other]), np.concatenate([token, np.full(len(other), words.unknown)])

    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    end = at + encoder.lengths[token]
    reach = end - begins[owner[at]]
    order = np.argsort(reach, kind="stable")
    at, token, end, reach = at[order], token[order], end[order], reach[order]
    best = np.full(len(points) + 1, _FAR, np.int64)
    # Boundary p lies before the character at p; a segment's first one is its begin.
    best[begins] = _NONE
    steps = np.flatnonzero(np.concatenate([[True], reach[1:] != reach[:-1], [True]])) if len(reach) else []
    for first, last in zip(steps[:-1], steps[1:], strict=True):
        before = best[at[first:last]]
        fits = before == _NONE
        held = np.flatnonzero(before >= 0)
        fits[held] = compatible(words, before[held], token[first:last][held])
        best[end[first:last][fits]] = token[first:last][fits]

    place, who, step = begins + sizes, np.arange(len(sizes)), 0
    walked: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(who):
        token = best[place]
        if (token < 0).any():
            raise ValueError("no sequence of pieces covers a segment")
        place = place - encoder.lengths[token]
        walked.append((who, token, place))
        going = place > begins[who]
        place, who = place[going], who[going]
    owner = np.concatenate([w[0] for w in walked])
    token = np.concatenate([w[1] for w in walked])
    place = np.concatenate([w[2] for w in walked])
    order = np.argsort(place, kind="stable")
    owner, token, place = owner[order], token[order], place[order]

    # A character without a piece becomes its bytes.
    out, repeat = words.ids[token], np.ones(len(token), np.int64)
    missing = np.flatnonzero(token == words.unknown)
    if len(missing):
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in points[place[missing]].tolist()]
        repeat[missing] = [*map(len, raw)]
        out = np.repeat(out, repeat)
        out[out == -1] = words.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
    n_ids = np.bincount(owner, weights=repeat, minlength=len(sizes)).astype(np.int64)
    return out, n_ids


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text's ids under a SentencePiece BPE model, and the text that they decode to.

    NULL and empty texts have no ids and decode to the empty text. A text with the mark of blanks
    decodes to blanks, as in the model. Rows with equal keys are each encoded; other
    columns are left aside; an empty table gives no rows.

    Texts are taken a bounded number of characters at a time; a longer text is a batch of its own.
    Returns key, ids (little-endian unsigned 32-bit), n_tokens and decoded.
    """
    spark = docs.sparkSession
    ship_code(spark)
    shared = spark.sparkContext.broadcast(load(path))  # as large as the vocabulary
    schema = pa.schema(
        [("_key", pa.int64()), ("ids", pa.binary()), ("n_tokens", pa.int64()), ("decoded", pa.string())]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)

        def done(keys: list, texts: list[str]) -> pa.RecordBatch:
            found = list(encoder.encode(texts))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.int64()),
                    pa.array([ids.astype("<u4").tobytes() for ids in found], pa.binary()),
                    pa.array([*map(len, found)], pa.int64()),
                    pa.array([encoder.decode(ids) for ids in found], pa.string()),
                ],
                schema=schema,
            )

        keys, texts, size = [], [], 0
        for batch in batches:
            for key_, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys.append(key_)
                texts.append(value.as_py() or "")
                size += len(texts[-1])
                if size > BATCH_CHARS:
                    yield done(keys, texts)
                    keys, texts, size = [], [], 0
        if keys:
            yield done(keys, texts)

    rows = docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(
        encode, "_key long, ids binary, n_tokens long, decoded string"
    )
    return rows.withColumnRenamed("_key", key)


