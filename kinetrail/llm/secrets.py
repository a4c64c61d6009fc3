"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

The patterns give the base spans. The method adds spans: every run of
``LEAST_LENGTH`` and more characters of the alphabet that keys are written in is read by two
first-order Markov models, one of random strings and one of ordinary identifiers;
a string whose log-likelihood ratio, over the square root of its length, reaches the calibrated bound
is a ``markov`` span, unless it overlaps a base span.

Both models are trained from labelled samples: random strings from a seeded
generator over the alphabets of common kinds of keys, together with the values
that the patterns found; ordinary identifiers from the words of all
documents, and compounds of them (snake_case, camelCase, slashed, numbered, dotted), every other group of
three neighbouring words. A word as long as a candidate is unlabelled, as it may be a secret, and teaches neither.
The bound is calibrated on what the models have not seen: seeded strings of another seed,
and the compounds of the other groups of all documents. It lies halfway between
the scores that ``FALSE_RATE`` of the ordinary ones and all but ``MISS_RATE`` of the random ones reach, and never
below the former.

Positions are code points, ends exclusive. Defined results: null and empty
texts have no span; matches that a kind's bounds reject are dropped and still
consume their text; spans are ordered by start, then kind in KINDS' order.
Repeated rows are scanned alike.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# The patterns and bounds of the base kinds.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a maximal run of 32 or more, as a leftmost match of any run starts where the run does
KINDS = ("assign", "access", "hex", "markov")
LEAST_VALUE, LEAST_ACCESS = 8, 16
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Candidates of the method; a full stop ends a sentence unless it is inside.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-][A-Za-z0-9+/_=.-]{14,}[A-Za-z0-9+/_=-]")
LEAST_LENGTH = 16
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
#: Words that compounds are made of at once, a multiple of 600 so that slices give what the whole gives.
COMPOUND_WORDS = 30_000
#: Shares of held-out ordinary and random strings that the bound may get wrong.
FALSE_RATE, MISS_RATE = 1e-4, 0.02
#: Scores are counted in steps of so much, between bounds beyond which none lies in practice; further ones count there.
STEP, MOST_SCORE = 0.05, 60.0
_CODE = np.full(256, len(ALPHABET), dtype=np.int64)
_CODE[np.frombuffer(ALPHABET.encode(), dtype=np.uint8)] = np.arange(len(ALPHABET))
STATES = len(ALPHABET) + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the three base kinds, by start, then kind."""
    out = []
    lower = text.lower()
    if any(word in lower for word in KEYWORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def codes(text: bytes) -> np.ndarray:
    return _CODE[np.frombuffer(text, dtype=np.uint8)]


def transitions(strings: list[bytes]) -> np.ndarray:
    """Counts of character pairs, a separator before and after each string."""
    held = codes(b"\n" + b"\n".join(strings) + b"\n") if strings else np.zeros(0, np.int64)
    return np.bincount(held[:-1] * STATES + held[1:], minlength=STATES * STATES) if len(held) else np.zeros(STATES * STATES, np.int64)


def random_strings(n: int = 6000, seed: int = 7) -> list[bytes]:
    """Labelled samples of the random class."""
    rng = random.Random(seed)
    kinds = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", ALPHABET[:62], ALPHABET[:64], ALPHABET[26:62], ALPHABET[:52])
    return ["".join(rng.choices(kinds[k % len(kinds)], k=rng.randint(16, 48))).encode() for k in range(n)]


def compounds(words: list[bytes], held_out: bool = False) -> list[bytes]:
    """Ordinary identifiers made of groups of three neighbouring words: of every other group, or of those between."""
    out = []
    for k in range(3 if held_out else 0, len(words) - 2, 6):
        a, b, c = words[k : k + 3]
        if max(len(a), len(b), len(c)) >= LEAST_LENGTH:
            continue
        out += [a + b"_" + b, a.lower() + b.title() + c.title(), a + b"-" + b + str(len(c) + k % 100).encode(), b"/".join((a, b, c)), a + str(k % 10).encode() + b"." + b + b"." + c]
    return out


def ordinary_words(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """The words of a text without its base spans, and the values of those."""
    text, rest, at, values = text or "", [], 0, []
    for kind, start, end in base_spans(text):
        values.append((ASSIGN.match(text, start).group(2) if kind == "assign" else text[start:end]).encode())
        rest.append(text[at : max(at, start)])
        at = max(at, end)
    return " ".join([*rest, text[at:]]).encode("ascii", "replace").split(), values


def scores(strings: list[bytes], ratio: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each string over the square root of its length."""
    if not strings:
        return np.zeros(0)
    held = codes(b"\n".join(strings) + b"\n")
    sums = np.concatenate(([0.0], np.cumsum(ratio[held[:-1], held[1:]])))
    lengths = np.array([len(x) for x in strings])
    ends = np.cumsum(lengths + 1) - 1
    # pairs inside a string, its separators left out
    return (sums[np.maximum(ends - 1, ends - lengths)] - sums[ends - lengths]) / np.sqrt(np.maximum(lengths, 1))


def bins(values: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(values, -MOST_SCORE, MOST_SCORE) / STEP).astype(np.int64)


def bound_of(ordinary: dict[int, int], random_scores: np.ndarray) -> float:
    """The bound, from counts of held-out ordinary scores by bin and the scores of held-out random strings."""
    low = float(np.quantile(random_scores, MISS_RATE))
    allowed, high = FALSE_RATE * sum(ordinary.values()), -MOST_SCORE
    for k in sorted(ordinary, reverse=True):
        if ordinary[k] > allowed:
            high = (k + 1) * STEP
            break
        allowed -= ordinary[k]
    return max(high, (max(high, 0.0) + low) / 2)


@dataclass
class MarkovPair:
    #: STATES x STATES log-likelihood ratios of random against ordinary
    ratio: np.ndarray
    #: Least score of a span.
    bound: float = math.inf

    def spans(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        found = [m.span() for m in CANDIDATE.finditer(text)]
        found = [(a, b) for a, b in found if not any(s < b and a < e for _, s, e in base)]
        marks = scores([text[a:b].encode() for a, b in found], self.ratio) >= self.bound
        return [("markov", a, b) for (a, b), mark in zip(found, marks, strict=True) if mark]

    def scan(self, text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """Base spans; all spans."""
        if not text:
            return [], []
        base = base_spans(text)
        return base, sorted(base + self.spans(text, base), key=lambda s: (s[1], KINDS.index(s[0])))


def train(docs: DataFrame, alpha: float = 0.5) -> MarkovPair:
    """Models and bound from seeded samples and all texts of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, STATES * STATES), dtype=np.int64)
        for batch in batches:
            for text in batch["text"].to_pylist():
                words, values = ordinary_words(text)
                counts[0] += transitions(values)
                for first in range(0, len(words), COMPOUND_WORDS):
                    part = words[first : first + COMPOUND_WORDS]
                    # long words may be secrets, so they are samples of neither class
                    counts[1] += transitions([w for w in part if len(w) < LEAST_LENGTH])
                    counts[1] += transitions(compounds(part))
        for kind in (0, 1):
            cells = np.flatnonzero(counts[kind])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), kind), pa.int32()), pa.array(cells, pa.int32()), pa.array(counts[kind][cells], pa.int64())], ["kind", "cell", "n"])

    summed = docs.select("text").mapInArrow(count, "kind int, cell int, n long").groupBy("kind", "cell").agg(F.sum("n").alias("n"))
    counts = np.zeros((2, STATES * STATES))
    for row in summed.collect():  # at most 2 * STATES ** 2 rows
        counts[row.kind, row.cell] = row.n
    seeded = transitions(random_strings())
    # what the patterns found weighs no more than the seeded sample
    counts[0] = seeded + counts[0] * min(1.0, seeded.sum() / max(counts[0].sum(), 1))
    tables = (counts + alpha).reshape(2, STATES, STATES)
    logs = np.log(tables / tables.sum(axis=2, keepdims=True))
    ratio = logs[0] - logs[1]
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(2 * int(MOST_SCORE / STEP) + 2, dtype=np.int64)
        for batch in batches:
            for text in batch["text"].to_pylist():
                words, _ = ordinary_words(text)
                for first in range(0, len(words), COMPOUND_WORDS):
                    part = words[first : first + COMPOUND_WORDS]
                    strings = [w for w in compounds(part, held_out=True) if len(w) >= LEAST_LENGTH]
                    held += np.bincount(bins(scores(strings, shared.value)) + int(MOST_SCORE / STEP), minlength=len(held))
        cells = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(cells - int(MOST_SCORE / STEP), pa.int32()), pa.array(held[cells], pa.int64())], ["bin", "n"])

    # as many rows as bins
    ordinary = {r.bin: r.n for r in docs.select("text").mapInArrow(calibrate, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    return MarkovPair(ratio, bound_of(ordinary, scores(random_strings(seed=8), ratio)))


def scan(docs: DataFrame, model: MarkovPair) -> DataFrame:
    """doc_id, counts and digest of the base spans, all spans, and the number that the method added."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch["text"].to_pylist():
                base, spans = shared.value.scan(text)
                rows.append((*(sum(s[0] == k for s in base) for k in KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(apply, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long")


def redact(docs: DataFrame, model: MarkovPair, mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with every span of their text replaced by ``mark``; a column n_chars follows the new text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text in batch["text"].to_pylist():
                out, at = [], 0
                for _, start, end in shared.value.scan(text)[1]:
                    if start >= at:
                        out += [text[at:start], mark]
                    at = max(at, end)
                texts.append(text if not out else "".join([*out, text[at:]]))
            k = batch.schema.get_field_index("text")
            yield batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))

    out = docs.mapInArrow(apply, docs.schema)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))) if "n_chars" in docs.columns else out


def run(docs: DataFrame) -> DataFrame:
    return scan(docs, train(docs))
