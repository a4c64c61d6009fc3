"""Language identification: multinomial naive Bayes over hashed character n-grams.

The counts of every training text meet in one matrix of classes x buckets whose
size does not depend on the corpus; more than ``MAX_LANGUAGES`` languages raise an error. Its log-probabilities are broadcast, and
batches of texts are scored with numpy gathers and segment sums.

Defined results: a null text, an empty one and one without any letter get
``und`` and score 0. Rows whose language is null teach nothing. With no
training rows at all every text gets ``und``. Equal posteriors go to the language first
in sorted order. Repeated rows are scored alike, columns besides ``doc_id``, ``text`` and
``lang`` are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, pack, salt, segment_sums, slices, sum_arrays, unpack

#: n-gram lengths, and log2 of the number of hash buckets.
ORDERS, BITS = (1, 2, 3), 16
UNDETERMINED = "und"
#: Classes that the matrix may have: 256 x 65,536 log-probabilities are 64 MB.
MAX_LANGUAGES = 256


@functools.cache
def _letters() -> np.ndarray:
    """Code point to itself for letters, to a space for all else."""
    points = np.arange(0x110000, dtype=np.uint32)
    points[~np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)] = 32
    return points


def _gram_buckets(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """For each order the bucket of the n-gram that starts at each code point of all texts in a row; bounds; which texts have a letter."""
    coded = [t.lower().encode("utf-32-le", "surrogatepass") for t in texts]
    ends = np.cumsum([len(c) // 4 for c in coded], dtype=np.int64)
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    points = _letters()[np.frombuffer(b"".join(coded), dtype="<u4")]
    has_letter = segment_sums((points != 32).astype(np.uint8), starts, ends) > 0
    out, held = [], points * np.uint32(0x9E3779B1)
    for order in ORDERS:
        if order > 1:
            held = (held[:-1] * np.uint32(0x85EBCA6B)) ^ (points[order - 1 :] * np.uint32(0xC2B2AE35)) if len(held) > 1 else held[:0]
        mixed = held ^ (held >> np.uint32(15))
        out.append(((mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)).astype(np.int64))
    return out, starts, ends, has_letter


def _windows(starts: np.ndarray, ends: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the n-grams that lie inside one text."""
    return starts, np.maximum(starts, ends - (order - 1))


@dataclass
class LanguageModel:
    languages: list[str]
    #: languages x buckets, float32
    log_p: np.ndarray
    log_prior: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and posterior for each text."""
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        grams, starts, ends, has_letter = _gram_buckets(texts)
        logs = np.tile(self.log_prior, (len(texts), 1))
        for order, buckets in zip(ORDERS, grams, strict=True):
            a, b = _windows(starts, ends, order)
            for k, row in enumerate(self.log_p):
                logs[:, k] += segment_sums(row[buckets], a, b)
        best = logs.argmax(axis=1)
        posterior = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.languages[k] if ok else UNDETERMINED for k, ok in zip(best, has_letter, strict=True)], np.where(has_letter, posterior, 0.0)


def train(docs: DataFrame, alpha: float = 0.1) -> LanguageModel:
    """Learn from every row of ``docs`` (text, lang) with both values."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch["lang"].to_pylist()
            for first, texts in slices(batch["text"].to_pylist()):
                grams, starts, ends, _ = _gram_buckets(texts)
                own = np.array(langs[first : first + len(texts)], dtype=object)
                for lang in set(own):
                    mine = own == lang
                    held = counts.setdefault(lang, np.zeros((1 << BITS) + 1, np.int64))
                    held[-1] += int(mine.sum())
                    for order, buckets in zip(ORDERS, grams, strict=True):
                        a, b = _windows(starts, ends, order)
                        picked = [buckets[x:y] for x, y in zip(a[mine], b[mine], strict=True)]
                        held[:-1] += np.bincount(np.concatenate(picked), minlength=1 << BITS)
        for lang, held in counts.items():
            yield pa.RecordBatch.from_pydict({"key": [lang], "salt": pa.array([salt()], pa.int32()), "payload": [pack(held)]})

    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    if known.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    rows = sum_arrays(known.mapInArrow(count, "key string, salt int, payload binary"), "int64").orderBy("key").collect()
    counts = np.array([unpack(r.payload, "int64") for r in rows], dtype=np.float64).reshape(len(rows), (1 << BITS) + 1)
    grams = counts[:, :-1] + alpha
    log_p = np.log(grams / grams.sum(axis=1, keepdims=True)).astype(np.float32) if len(rows) else np.zeros((0, 1 << BITS), np.float32)
    prior = np.log((counts[:, -1] + 1) / (counts[:, -1] + 1).sum()) if len(rows) else np.zeros(0)
    return LanguageModel([r.key for r in rows], log_p, prior)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for _, texts in slices(batch["text"].to_pylist()):
                got, posterior = shared.value.predict(texts)
                langs += got
                scores.append(posterior)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", 4) == 2).alias("held_out"), "text")
    return given.mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double")


def run(docs: DataFrame) -> DataFrame:
    """Learn from the training fold, then predict every row."""
    return identify(docs, train(docs.where(fold("doc_id", 4) != 2)))
