"""Language-model scoring by logistic context mixing.

A text is lower-cased (A-Z), cut into words at white space and coded as bytes:
each word followed by a space, a line feed at the end. Every byte is eight
binary decisions. A predictor for each context order, and one for the word so
far, looks up the counts of zeros and ones in a hashed slot of (predictor,
class, context, decision path). The predictors' logits, shrunk where counts are
few, are summed with weights that a gate selects by the highest order seen, the
word predictor's confidence and the decision's depth; an adaptive probability
map refines the mixed probability. The sum of the decisions' log-probabilities is the
score; bits per byte follow.

The class is worked out again before each word, from the frequent words that a
document has had so far, under a mixture of multinomials; before the first of
these it is a class of its own. A decision thus depends on earlier ones alone,
and the scores are those of one probability model: over all texts they sum to one.

What is learnt covers all training texts: the counts of every slot, the exact
token counts, and the classes, by distributed rounds of expectation
maximisation over each text's counts of the frequent words. The weights and the map are
learnt online, each task on all its texts, each decision without its own count: equal bytes in equal
contexts make one step together, with their number. The tasks' results
are averaged by how often each gate was used.

The number of slots follows the vocabulary's size up to ``MOST_BITS`` for each
predictor; beyond that contexts share slots, as hashing implies, and none is left out. A byte's
probability depends on the class, the word so far and the last ``max(ORDERS)``
bytes alone, so workers remember it by a hash of those.

The base score uses exact token counts. The most frequent tokens, at most
``HEAD`` of them and of ``HEAD_BYTES`` each, are broadcast; occurrences of the others are
joined with the vocabulary, whose keys there are rare or long.

Defined results: a null or empty text consists of the end alone. Repeated rows
are scored alike. Without training texts N and V are 0, every count is 0 and
all decisions have probability one half.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_slices, fold, pack, salt, segment_sums, stage, sum_arrays, unpack

#: Context orders in bytes, and log2 of the slots of each and of the predictor by the word so far, at most and at least.
ORDERS = (2, 3, 4, 5)
MOST_BITS, LEAST_BITS = (19, 20, 21, 22, 23), 16
#: Slots of a block, the unit in which count arrays are summed.
BLOCK_BITS = 16
#: Weights are learnt from one training text in so many, that is from all, however few a table has.
LEARN_ONE_IN, LEARN_LEAST = 1, 200
#: Bytes of an online step, and what the map's start counts.
STEP, MAP_PRIOR = 4096, 200.0
#: log2 of the cells for distinct bytes in context that a task holds before it learns from or counts them, cells that a byte is looked for in, bytes without one
#: that are held, and the share of a slice's bytes without one, one in so many, at which the cells are emptied.
DISTINCT_BITS, COUNT_BITS, PROBES, LEFT, FULL = 21, 20, 8, 1 << 16, 32
#: Tokens whose counts are broadcast, at most, and their bytes.
HEAD, HEAD_BYTES = 200_000, 64
#: Texts are worked on in slices of about so many characters, whose arrays stay in a core's cache.
SLICE = 100_000
#: Buckets of the adaptive probability map; log2 of the byte probabilities that a worker remembers, and of the cells that find equal bytes of a slice.
MAP_CELLS, REMEMBERED_BITS, STAND_BITS = 33, 22, 20
END, SPACE = b"\n", b" "
LOGIT_MAX = 8.0
#: No decision's probability is taken as smaller.
LEAST_P = 1 / 65536
#: Classes of documents, frequent words that they are told by, texts of the first fit, its seeded starts and rounds, and rounds over all texts.
CLASSES, CLASS_WORDS, SEED_TEXTS, STARTS, ROUNDS, FULL_ROUNDS = 6, 64, 400, 8, 30, 3
DEPTH = max(ORDERS)
#: Bits of a key that hold a byte and those before it; the class is above them.
BYTE_BITS = 8 * (DEPTH + 1)
CLASS_MIX = np.uint64(0x5851F42D4C957F2D)
#: Low bits of a word key, which hold the class and the byte.
WORD_LOW = np.uint64(0x7FFF)
CHUNK = 4096


def tokens(text: str | None) -> list[bytes]:
    """Words; bytes.split cuts at exactly 0x20 and 0x09-0x0D, bytes.lower changes exactly A-Z."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def coded(words: list[bytes]) -> bytes:
    return SPACE.join([*words, END])


@dataclass
class DocumentClasses:
    """A mixture of multinomials over frequent words."""

    #: Column of each frequent word.
    words: dict[bytes, int]
    #: classes x words
    log_p: np.ndarray
    log_share: np.ndarray

    def vector(self, words: list[bytes]) -> np.ndarray:
        known = self.words
        return np.bincount([known[w] for w in words if w in known], minlength=len(known)) if known else np.zeros(0)

    def before(self, columns: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Class before each token: the likeliest by the frequent words (a column, or -1) that its text has had, or len(log_share) before the first of them."""
        none = len(self.log_share)
        if none == 1:
            return np.zeros(len(columns), dtype=np.int64)
        hits = np.flatnonzero(columns >= 0)
        if not len(hits):
            return np.full(len(columns), none)
        # a class for each frequent word, from it and those before it; other tokens have the last one's
        text = np.searchsorted(ends, hits, "right")
        first = np.searchsorted(hits, starts[text])
        sums = np.zeros((len(hits) + 1, none))
        np.cumsum(self.log_p.T[columns[hits]], axis=0, out=sums[1:])
        own = (sums[1:] - sums[first] + self.log_share).argmax(axis=1)
        marked = columns >= 0
        last = np.cumsum(marked) - marked - 1
        begun = last >= np.repeat(np.searchsorted(hits, starts), ends - starts)
        return np.where(begun, own[np.maximum(last, 0)], none)


def _round(x: np.ndarray, log_p: np.ndarray, log_share: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Expected counts of the classes' words and of the classes, and the log-likelihood, over rows of ``x``."""
    logs = x @ log_p.T + log_share
    most = logs.max(axis=1, keepdims=True)
    r = np.exp(logs - most)
    total = r.sum(axis=1, keepdims=True)
    r /= total
    return r.T @ x, r.sum(axis=0), float((np.log(total) + most).sum())


def _smoothed(counts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = counts + 0.5
    return np.log(p / p.sum(axis=1, keepdims=True)), np.log((sizes + 1) / (sizes.sum() + len(sizes)))


def fit_classes(top: dict[bytes, int], x: np.ndarray) -> DocumentClasses:
    """Expectation maximisation from several seeded starts over rows of counts; the likeliest fit."""
    if len(x) < 2 * CLASSES or not top:
        return DocumentClasses({}, np.zeros((1, 0)), np.zeros(1))
    best, held, x = -math.inf, None, x.astype(np.float64)
    for seed in range(STARTS):
        p = x[np.random.default_rng(seed).choice(len(x), CLASSES, replace=False)] + x.mean(axis=0) / 2 + 0.1
        log_p, log_share = np.log(p / p.sum(axis=1, keepdims=True)), np.full(CLASSES, -math.log(CLASSES))
        for _ in range(ROUNDS):
            counts, sizes, likely = _round(x, log_p, log_share)
            log_p, log_share = _smoothed(counts, sizes)
        if likely > best:
            best, held = likely, DocumentClasses(top, log_p, log_share)
    return held


def top_words(vocabulary: DataFrame) -> dict[bytes, int]:
    rows = vocabulary.where(F.col("token") != F.lit(END)).orderBy(F.desc("c"), "token").limit(CLASS_WORDS).collect()
    return {bytes(r.token): k for k, r in enumerate(rows)}


def document_classes(training: DataFrame, vocabulary: DataFrame) -> DocumentClasses:
    """Classes of all training texts: a first fit on SEED_TEXTS of them, then rounds over all."""
    top = top_words(vocabulary)
    if not top:
        return fit_classes(top, np.zeros((0, 0)))
    blank = DocumentClasses(top, np.zeros((1, len(top))), np.zeros(1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [blank.vector(tokens(t)).astype(np.int32).tobytes() for _, texts in column_slices(batch["text"], SLICE) for t in texts]
            yield pa.RecordBatch.from_arrays([batch["h"], pa.array(rows, pa.binary())], ["h", "x"])

    vectors = stage(training.select(F.xxhash64("doc_id", "text").alias("h"), "text").mapInArrow(count, "h long, x binary"), "lm-vectors")
    rows = [np.frombuffer(r.x, np.int32) for r in vectors.orderBy("h", "x").limit(SEED_TEXTS).collect()]
    held = fit_classes(top, np.array(rows).reshape(len(rows), -1))
    size = len(held.log_share)
    if size == 1:
        return held
    for _ in range(FULL_ROUNDS):
        log_p, log_share = held.log_p, held.log_share

        def add(batches: Iterator[pa.RecordBatch], log_p=log_p, log_share=log_share) -> Iterator[pa.RecordBatch]:
            total = np.zeros(log_p.size + len(log_share))
            for batch in batches:
                x = np.frombuffer(b"".join(batch["x"].to_pylist()), np.int32).reshape(-1, log_p.shape[1]).astype(np.float64)
                counts, sizes, _ = _round(x, log_p, log_share)
                total += np.concatenate((counts.ravel(), sizes))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["cell", "n"])

        total = np.zeros(log_p.size + size)
        for r in vectors.select("x").mapInArrow(add, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # a row a cell
            total[r.cell] = r.n
        held = DocumentClasses(top, *_smoothed(total[: log_p.size].reshape(log_p.shape), total[log_p.size :]))
    return held


@dataclass
class Contexts:
    """Keys of all bytes of some texts, and the bounds of each text's bytes."""

    #: The byte, those before it (spaces before a text) and the class.
    keys: np.ndarray
    #: A hash of the word so far, the class and the byte.
    words: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def contexts(parts: list[bytes], classes: np.ndarray) -> Contexts:
    """``classes`` has the class of each byte of all parts."""
    wide = np.frombuffer(b"".join(parts), dtype=np.uint8).astype(np.uint64)
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    keys, kinds = wide.copy(), np.asarray(classes, dtype=np.uint64)
    for k in range(1, DEPTH + 1):
        keys[k:] |= wide[:-k] << np.uint64(8 * k)
    for k in range(DEPTH):  # the bytes before a text's first ones are spaces
        at = starts[sizes > k] + k
        low = np.uint64((1 << 8 * (k + 1)) - 1)
        keys[at] = keys[at] & low | np.uint64(0x2020202020202020 & (1 << BYTE_BITS) - 1) & ~low
    words = _word_hashes(wide, starts)
    words &= ~WORD_LOW
    words |= wide
    words |= kinds << np.uint64(8)
    keys |= kinds << np.uint64(BYTE_BITS)
    return Contexts(keys, words, starts, ends)


def _word_hashes(wide: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each byte a hash of the word's bytes before it."""
    n = len(wide)
    begins = np.zeros(n, dtype=np.int64)
    begins[starts] = starts
    after = np.flatnonzero(wide[:-1] == 32) + 1
    begins[after] = after
    begins = np.maximum.accumulate(begins)
    places = np.arange(n) - begins
    powers = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(int(places.max(initial=0)), np.uint64(0x9E3779B97F4A7C15)))))
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((wide + np.uint64(1)) * powers[places], out=sums[1:])
    mixed = sums[:n] - sums[begins]
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return mixed


def contexts_of(cut: list[list[bytes]], classes: DocumentClasses, places: dict[bytes, int] | None = None) -> tuple[Contexts, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of the texts with the class before each word; their tokens, ends included, each token's place and each text's bounds.

    ``places`` number tokens, the classes' words as in their columns and others above; a token without one has -1.
    """
    flat: list[bytes] = []
    for words in cut:
        flat += words
        flat.append(END)
    found = np.fromiter(map((classes.words if places is None else places).get, flat, repeat(-1)), np.int64, len(flat))
    columns = np.where(found < len(classes.words), found, -1)
    sizes = np.fromiter(map(len, flat), np.int64, len(flat)) + 1
    ends = np.cumsum([len(words) + 1 for words in cut], dtype=np.int64)
    sizes[ends - 1] = 1
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    return contexts([coded(w) for w in cut], np.repeat(classes.before(columns, starts, ends), sizes)), flat, found, starts, ends


def based(context: np.ndarray, seed: int) -> np.ndarray:
    """What the slots of a predictor's context have in common."""
    mixed = (context + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    return mixed


def slots(base: np.ndarray, bits: int, path: np.ndarray) -> np.ndarray:
    """Slots of the decisions that a path leads to."""
    mixed = base + path
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed >>= np.uint64(64 - bits)
    return mixed.view(np.int64)


def without_above(keys: np.ndarray, order: int) -> np.ndarray:
    """Keys without the bytes that a context of ``order`` does not hold."""
    return keys & np.uint64(((1 << 64) - (1 << BYTE_BITS)) | ((1 << 8 * (order + 1)) - 1))


def order_base(keys: np.ndarray, order: int) -> np.ndarray:
    """Of the class and the ``order`` bytes before the last."""
    past, kinds = keys >> np.uint64(8), (keys >> np.uint64(BYTE_BITS)) * CLASS_MIX
    return based((past & np.uint64((1 << (8 * order)) - 1)) + kinds, order)


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their ``times``."""
    if not len(keys):
        return keys, times
    by = np.argsort(keys)
    keys = keys[by]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(times[by], first)


class Gathered:
    """Distinct bytes in context with their number, in as many cells as are given: ``use`` gets keys, words and numbers once these are full, and at the end."""

    def __init__(self, bits: int, use: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> None:
        self.bits, self.use = bits, use
        self.times, self.keys, self.words = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.left: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_left = 0

    def add(self, keys: np.ndarray, words: np.ndarray) -> None:
        n = len(keys)
        keys, words = self._into_cells(keys, words)
        if len(keys) * FULL > n:
            self._empty_cells()
            keys, words = self._into_cells(keys, words)
        if len(keys):
            self.left.append((keys, words))
            self.n_left += len(keys)
            if self.n_left >= LEFT:
                self._empty_left()

    def finish(self) -> None:
        self._empty_cells()
        self._empty_left()

    def _into_cells(self, keys: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What finds its cells taken by others."""
        mixed = words ^ (keys * np.uint64(0x9E3779B97F4A7C15))
        mixed ^= mixed >> np.uint64(32)
        for _ in range(PROBES):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15)
            at = (mixed >> np.uint64(64 - self.bits)).view(np.int64)
            free = np.flatnonzero(self.times.take(at) == 0)
            # of equal cells the last writer is the same for both arrays
            self.keys[at[free]], self.words[at[free]] = keys[free], words[free]
            own = (self.keys.take(at) == keys) & (self.words.take(at) == words)
            np.add.at(self.times, at[own], 1)
            rest = np.flatnonzero(~own)
            keys, words, mixed = keys[rest], words[rest], mixed[rest] ^ (mixed[rest] >> np.uint64(29))
            if not len(rest):
                break
        return keys, words

    def _empty_cells(self) -> None:
        at = np.flatnonzero(self.times)
        if len(at):
            self.use(self.keys[at], self.words[at], self.times[at])
            self.times[:] = 0

    def _empty_left(self) -> None:
        if self.left:
            keys, words = (np.concatenate(x) for x in zip(*self.left, strict=True))
            by = np.lexsort((words, keys))
            keys, words = keys[by], words[by]
            first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (words[1:] != words[:-1]))))
            self.use(keys[first], words[first], np.diff(np.append(first, len(keys))))
            self.left, self.n_left = [], 0


def word_base(words: np.ndarray) -> np.ndarray:
    return based(words >> np.uint64(8), 99)


def all_bases(keys: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
    return [*(order_base(keys, order) for order in ORDERS), word_base(words)]


def decisions(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Depth, path before the decision with a leading one, and the bit, from the most significant."""
    last = keys & np.uint64(255)
    for depth in range(8):
        yield depth, np.uint64(1 << depth) | (last >> np.uint64(8 - depth)), ((last >> np.uint64(7 - depth)) & np.uint64(1)).view(np.int64)


def slots_of(keys: np.ndarray, bases: list[np.ndarray], bits: tuple[int, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bit, and each predictor's slots, of all decisions: a row for each depth."""
    last, depth = (keys & np.uint64(255)).view(np.int64), np.arange(8)[:, None]
    path = ((last | 256) >> (8 - depth)).view(np.uint64)
    return (last >> (7 - depth)) & 1, [slots(base, b, path) for base, b in zip(bases, bits, strict=True)]


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def quantised(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Both counts in one number, the zeros above 8 bits; counts over 255 are halved together until they fit, and stay at least 1 if they were."""
    most = np.maximum(n0, n1)
    shift = np.maximum(0, np.ceil(np.log2(np.maximum(most, 1) + 1)).astype(np.int64) - 8)
    a, b = (np.where(n > 0, np.maximum(n >> shift, 1), 0) for n in (n0, n1))
    return ((a << 8) | b).astype(np.uint16)


#: Logit, times 15, of each pair of quantised counts; 0 where nothing was seen.
_A, _B = np.meshgrid(np.arange(256), np.arange(256), indexing="ij")
LOGITS = np.round(np.clip(np.log((_B + 0.1) / (_A + 0.1)), -LOGIT_MAX, LOGIT_MAX) * 15).astype(np.int8)
#: The same without the decision's own count, for a zero and above for a one.
LOGITS_WITHOUT = np.concatenate((LOGITS[np.maximum(_A - 1, 0), _B].ravel(), LOGITS[_A, np.maximum(_B - 1, 0)].ravel()))


@dataclass
class ContextMixer:
    #: For each order, then the word so far, the slots' quantised counts.
    tables: list[np.ndarray]
    #: GATES x (predictors and a bias)
    weights: np.ndarray
    #: (orders + 1) gates x MAP_CELLS probabilities
    refined: np.ndarray

    def __post_init__(self) -> None:
        self._keys = None
        self._logits = [LOGITS.reshape(-1)[t] for t in self.tables]
        self.bits = tuple(len(t).bit_length() - 1 for t in self.tables)

    def __getstate__(self) -> dict:
        # a worker needs the logits alone
        return {"tables": [], "_logits": self._logits, "bits": self.bits, "weights": self.weights, "refined": self.refined}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, _keys=None)

    def byte_log2(self, keys: np.ndarray, words: np.ndarray) -> np.ndarray:
        """log2 of each last byte's probability given those before it and the word so far."""
        out = np.zeros(len(keys), dtype=np.float32)
        for first in range(0, len(keys), CHUNK):
            k = keys[first : first + CHUNK]
            bit, found = slots_of(k, all_bases(k, words[first : first + CHUNK]), self.bits)
            p = refine(*mix([t.take(at) for t, at in zip(self._logits, found, strict=True)], self.weights)[1:], self.refined)
            out[first : first + CHUNK] = np.log2(np.where(bit == 1, p, 1 - p)).sum(axis=0)
        return out

    def log2(self, held: Contexts) -> np.ndarray:
        """log2 probability of each text."""
        if self._keys is None:
            self._keys, self._values, self._first = np.zeros(1 << REMEMBERED_BITS, np.uint64), np.full(1 << REMEMBERED_BITS, np.nan, np.float32), np.zeros(1 << STAND_BITS, np.int32)
        both = held.words ^ (held.keys * np.uint64(0x9E3779B97F4A7C15))
        both ^= both >> np.uint64(32)
        at = ((both * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - REMEMBERED_BITS)).view(np.int64)
        values = self._values[at]
        missing = np.flatnonzero((self._keys[at] != both) | np.isnan(values))
        if len(missing):
            # one of the positions that share a cell stands for those with its key; the others are worked out themselves
            cells = at[missing] & ((1 << STAND_BITS) - 1)
            self._first[cells] = missing
            stands = self._first[cells].astype(np.int64)
            same = both[stands] == both[missing]
            one = missing[(stands == missing) | ~same]
            values[one] = self.byte_log2(held.keys[one], held.words[one])
            values[missing[same]] = values[stands[same]]
            kept = stands[stands == missing]
            self._keys[at[kept]], self._values[at[kept]] = both[kept], values[kept]
        return segment_sums(values, held.starts, held.ends)


#: Highest order seen, three grades of the word predictor's confidence, depth of the decision.
ROWS = (len(ORDERS) + 1) * 3
GATES = ROWS * 8


def mix(inputs: list[np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Logits, map's row, mixed probability of a one, map's cell and share of the next cell, each with a row for each depth; a gate is eight times the map's row and the depth."""
    x = np.empty((len(inputs) + 1, *inputs[0].shape), dtype=np.float32)
    seen = np.zeros(inputs[0].shape, dtype=np.int8)
    for k, raw in enumerate(inputs):
        np.multiply(raw, np.float32(1 / 15), out=x[k])
        if k < len(ORDERS):
            np.maximum(seen, (raw != 0).view(np.int8) * np.int8(k + 1), out=seen)
    x[-1] = 0.25
    seen *= np.int8(3)
    seen += inputs[-1] != 0
    seen += np.abs(inputs[-1]) > 50
    row = seen.astype(np.intp)
    gate = row * 8
    gate += np.arange(8)[:, None]
    z = np.zeros(row.shape, dtype=np.float32)
    for own, v in zip(weights.T.copy(), x, strict=True):
        z += own.take(gate) * v
    np.clip(z, -12, 12, out=z)
    position = (z + np.float32(12)) * np.float32((MAP_CELLS - 1) / 24)
    cell = np.minimum(position.astype(np.int32), MAP_CELLS - 2)
    return x, row, squash(z), cell, position - cell.astype(np.float32)


def refine(row: np.ndarray, mixed: np.ndarray, cell: np.ndarray, share: np.ndarray, refined: np.ndarray) -> np.ndarray:
    """Probability of a one by the mean of the mixed one and the map's."""
    flat, cells = row * MAP_CELLS + cell, refined.reshape(-1)
    smooth = cells.take(flat) * (1 - share) + cells.take(flat + 1) * share
    return np.clip((mixed + smooth) / 2, LEAST_P, 1 - LEAST_P)


def start_weights() -> tuple[np.ndarray, np.ndarray]:
    weights = np.zeros((GATES, len(ORDERS) + 2), dtype=np.float32)
    for seen in range(len(ORDERS) + 1):
        for grade in range(3):
            own = weights[(seen * 3 + grade) * 8 : (seen * 3 + grade) * 8 + 8]
            own[:, :seen] = 0.15
            own[:, max(0, seen - 1) : seen] = 0.3
            own[:, -2] = (0.0, 0.4, 0.7)[grade]
    cells = squash(np.linspace(-12, 12, MAP_CELLS))
    return weights, np.tile(cells, (ROWS, 1)).astype(np.float32)


class Learner:
    """Weights and map by online steps; each decision is scored without its own count in the slots."""

    def __init__(self, tables: list[np.ndarray]) -> None:
        self.tables, self.bits = tables, tuple(len(t).bit_length() - 1 for t in tables)
        self.weights, self.refined = start_weights()
        self.squares = np.full(self.weights.shape, 1.0, dtype=np.float32)
        self.used = np.zeros(GATES)
        self.start, self.ones, self.n = self.refined.astype(np.float64), np.zeros(self.refined.size), np.zeros(self.refined.size)
        self._gathered: Gathered | None = None

    def gather(self, held: Contexts) -> None:
        """Count bytes in context, to be learnt from once the cells for them are full, or at the end."""
        if self._gathered is None:
            self._gathered = Gathered(DISTINCT_BITS, lambda keys, words, times: self.see(Contexts(keys, words, times[:0], times[:0]), times))
        self._gathered.add(held.keys, held.words)

    def finish(self) -> None:
        if self._gathered is not None:
            self._gathered.finish()
            self._gathered = None

    def see(self, held: Contexts, times: np.ndarray | None = None) -> None:
        for first in range(0, len(held.keys), STEP):
            keys = held.keys[first : first + STEP]
            often = np.ones(len(keys)) if times is None else times[first : first + STEP].astype(np.float64)
            bit, found = slots_of(keys, all_bases(keys, held.words[first : first + STEP]), self.bits)
            own = bit << 16
            x, row, mixed, cell, share = mix([LOGITS_WITHOUT.take(t.take(at) + own) for t, at in zip(self.tables, found, strict=True)], self.weights)
            # each depth has gates of its own
            x *= (bit - mixed) * often
            chosen = (np.arange(ROWS, dtype=np.int8)[:, None] == row.astype(np.int8)[:, None]).astype(np.float32)
            slope = (chosen @ x.transpose(1, 2, 0)).transpose(1, 0, 2).reshape(self.weights.shape)
            self.squares += slope * slope
            self.weights += 0.05 * slope / np.sqrt(self.squares)
            self.used += (chosen @ often).T.ravel()
            near = (row * MAP_CELLS + cell + (share >= 0.5)).ravel()
            often = np.tile(often, 8)
            self.n += np.bincount(near, weights=often, minlength=self.n.size)
            self.ones += np.bincount(near, weights=bit.ravel() * often, minlength=self.n.size)
            held_map = (self.start.ravel() * MAP_PRIOR + self.ones) / (MAP_PRIOR + self.n)
            self.refined.reshape(-1)[:] = np.clip(held_map, LEAST_P, 1 - LEAST_P)


def learn(training: DataFrame, tables: list[np.ndarray], classes: DocumentClasses) -> ContextMixer:
    """The mixer whose weights are the mean of what tasks learnt on their texts, by how often each gate was used."""
    shared = training.sparkSession.sparkContext.broadcast((tables, classes))

    def online(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, classes = shared.value
        learner, seen = Learner(tables), False
        for batch in batches:
            for _, texts in column_slices(batch["text"], SLICE):
                learner.gather(contexts_of([tokens(t) for t in texts], classes)[0])
                seen = True
        learner.finish()
        if seen:
            used, by_row = learner.used, learner.used.reshape(ROWS, 8).sum(axis=1)
            total = np.concatenate((used, (learner.weights * used[:, None]).ravel(), (learner.refined * by_row[:, None]).ravel()))
            yield pa.RecordBatch.from_pydict({"key": ["learnt"], "salt": pa.array([salt()], pa.int32()), "payload": [pack(total)]})

    weights, refined = start_weights()
    for row in sum_arrays(training.select("text").mapInArrow(online, "key string, salt int, payload binary"), "float64").collect():  # one row
        total = unpack(row.payload, "float64")
        used, by_row = total[:GATES], total[:GATES].reshape(ROWS, 8).sum(axis=1)
        own = total[GATES : GATES + weights.size].reshape(weights.shape)
        weights = np.divide(own, used[:, None], out=weights.astype(np.float64), where=used[:, None] > 0).astype(np.float32)
        own = total[GATES + weights.size :].reshape(refined.shape)
        refined = np.divide(own, by_row[:, None], out=refined.astype(np.float64), where=by_row[:, None] > 0).astype(np.float32)
    return ContextMixer(tables, weights, refined)


def slot_bits(letters: int) -> tuple[int, ...]:
    """log2 of the predictors' numbers of slots for a vocabulary of so many letters: two to four for each letter, within the bounds."""
    wanted = max(letters, 1).bit_length() + 1
    return tuple(max(LEAST_BITS, min(most, wanted)) for most in MOST_BITS)


def sum_blocks(parts: DataFrame, dtype: str, out: Callable[[np.ndarray], bytes]) -> DataFrame:
    """Sum packed blocks of a key inside each partition, in 64 bits. Keys come sorted, so a worker holds one block and one sum however many keys a partition has."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([out(total)], pa.binary())], ["key", "payload"])

        key, total = None, None
        for batch in batches:
            for k, payload in zip(batch["key"], batch["payload"], strict=True):
                if (own := k.as_py()) != key:
                    if key is not None:
                        yield done()
                    key, total = own, 0
                total = total + unpack(payload.as_py(), dtype).astype(np.int64, copy=False)
        if key is not None:
            yield done()

    return parts.select("key", "payload").sortWithinPartitions("key").mapInArrow(add, "key string, payload binary")


def count_slots(training: DataFrame, classes: DocumentClasses, bits: tuple[int, ...]) -> list[np.ndarray]:
    """Quantised counts of zeros and ones in every slot, over all texts of ``training``."""
    shared = training.sparkSession.sparkContext.broadcast(classes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros(2 << b, dtype=np.int32) for b in bits]

        def into(place: int, keys: np.ndarray, times: np.ndarray, base_of: Callable[[np.ndarray], np.ndarray]) -> None:
            table, b = tables[place], bits[place]
            for first in range(0, len(keys), CHUNK):
                k, n = keys[first : first + CHUNK], times[first : first + CHUNK].astype(np.int32)
                bit, (found,) = slots_of(k, [base_of(k)], (b,))
                found += bit << b
                np.add.at(table, found.ravel(), np.tile(n, 8))

        def use(keys: np.ndarray, words: np.ndarray, times: np.ndarray) -> None:
            into(len(ORDERS), *_summed(words, times), word_base)
            for place in reversed(range(len(ORDERS))):
                # a shorter context's counts are sums of a longer one's
                keys, times = _summed(without_above(keys, ORDERS[place]), times)
                into(place, keys, times, lambda k, order=ORDERS[place]: order_base(k, order))

        gathered = Gathered(COUNT_BITS, use)
        for batch in batches:
            for _, texts in column_slices(batch["text"], SLICE):
                held = contexts_of([tokens(t) for t in texts], shared.value)[0]
                gathered.add(held.keys, held.words)
        gathered.finish()
        del gathered
        for k, (table, b) in enumerate(zip(tables, bits, strict=True)):
            both = table.reshape(2, 1 << b)
            for block in range(1 << (b - BLOCK_BITS)):
                part = both[:, block << BLOCK_BITS : (block + 1) << BLOCK_BITS]
                if part.any():
                    yield pa.RecordBatch.from_pydict({"key": [f"{k}:{block}"], "salt": pa.array([salt(4)], pa.int32()), "payload": [pack(part)]})

    out = [np.zeros(1 << b, np.uint16) for b in bits]
    counted = training.select("text").mapInArrow(count, "key string, salt int, payload binary")
    first = sum_blocks(counted.repartition("key", "salt"), "int32", pack)
    # as many rows as there are blocks, whatever the corpus
    for row in stage(sum_blocks(first.repartition("key"), "int64", lambda total: pack(quantised(*total.reshape(2, -1)))), "lm-slots").toLocalIterator():
        k, block = map(int, row.key.split(":"))
        out[k][block << BLOCK_BITS : (block + 1) << BLOCK_BITS] = unpack(row.payload, "uint16")
    return out


def count_tokens(docs: DataFrame) -> DataFrame:
    """token binary, c long: exact counts over all texts, the end included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["token", "c"])

        held: Counter = Counter()
        for batch in batches:
            for _, texts in column_slices(batch["text"], SLICE):
                for text in texts:
                    held.update(tokens(text))
                    held[END] += 1
                if len(held) > 200_000:
                    yield out()
                    held.clear()
        yield out()

    return docs.select("text").mapInArrow(count, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def least_count(vocabulary: DataFrame, most: int) -> int | None:
    """The smallest count that at most ``most`` tokens reach."""
    least, held = None, 0
    # Counts over 1e6 are one class, so that there is a bounded number of rows.
    sizes = vocabulary.select(F.least("c", F.lit(1_000_000)).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    for row in sizes.orderBy(F.desc("c")).collect():
        held += row.n
        if held > most:
            break
        least = row.c
    return least


def head_of(vocabulary: DataFrame) -> dict[bytes, int]:
    """The most frequent tokens of at most HEAD_BYTES, at most HEAD of them."""
    short = vocabulary.where(F.length("token") <= HEAD_BYTES)
    least = least_count(short, HEAD)
    return {bytes(r.token): r.c for r in short.where(F.col("c") >= least).collect()} if least else {}


#: What a scoring task returns: its rows' numbers, and the tokens that are not broadcast, with how often a row has them.
SCORED = "doc_id long, held_out boolean, row long, n_tokens long, head_known long, head_base double, score double, bits_per_byte double, rare array<binary>, times array<long>"
SCORED_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()))


def scored_slices(batches: Iterator[pa.RecordBatch], mixer: ContextMixer, classes: DocumentClasses, places: dict[bytes, int], log_of: np.ndarray, row: int) -> Iterator[pa.RecordBatch]:
    """A batch of ``SCORED`` for each slice of texts, so that a worker never holds more than one slice's strings; rows are numbered from ``row``."""
    names = [field.split()[0] for field in SCORED.split(", ")]
    for batch in batches:
        for first, texts in column_slices(batch["text"], SLICE):
            held, flat, found, starts, ends = contexts_of([tokens(t) for t in texts], classes, places)
            bits, sizes = mixer.log2(held), held.ends - held.starts
            logs = log_of[found]
            known = ~np.isnan(logs)
            base = segment_sums(np.where(known, logs, 0.0), starts, ends)
            heads = segment_sums(known.astype(np.int64), starts, ends).astype(np.int64)
            rest = np.flatnonzero(~known)
            cuts = np.searchsorted(rest, ends).tolist()
            rare = [Counter(map(flat.__getitem__, rest[a:b].tolist())) for a, b in zip([0, *cuts], cuts, strict=False)]
            values = (range(row, row + len(texts)), ends - starts, heads, base, bits * math.log10(2), -bits / sizes, [list(c) for c in rare], [list(c.values()) for c in rare])
            part = batch.slice(first, len(texts))
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], *(pa.array(c, k) for c, k in zip(values, SCORED_KINDS, strict=True))], names)
            row += len(texts)


def run(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row of ``docs``."""
    spark = docs.sparkSession
    training = docs.where(fold("doc_id", 5) != 1)
    vocabulary = stage(count_tokens(training), "lm-vocabulary")
    total = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.length("token") + 1), F.lit(0)).alias("letters")).first()
    n, v = int(total.n), int(total.v)
    classes = document_classes(training, vocabulary)
    model = learn(training, count_slots(training, classes, slot_bits(int(total.letters))), classes)
    places, head = dict(classes.words), head_of(vocabulary)
    for token in head:
        places.setdefault(token, len(places))
    log_of = np.array([math.log10(head[token] + 0.5) if token in head else math.nan for token in places] + [math.nan])
    shared = spark.sparkContext.broadcast((model, classes, places, log_of))
    floor = math.log10(n + 0.5 * (v + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from scored_slices(batches, *shared.value, TaskContext.get().partitionId() << 33)

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", 5) == 1).alias("held_out"), "text")
    scored = stage(given.mapInArrow(score, SCORED), "lm-scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("token"), "r.times")
    joined = rare.join(vocabulary, "token", "left").groupBy("row").agg(
        F.sum("times").alias("all"), F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("known"), F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("base")
    )
    return scored.drop("rare", "times").join(joined, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("base", F.lit(0.0)) - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        "score",
        "bits_per_byte",
    )
