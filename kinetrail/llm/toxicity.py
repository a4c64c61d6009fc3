"""Toxicity by compression distance with zstandard dictionaries trained on either class.

Texts are read in windows of ``WINDOW`` words, half a window apart, over their whole length.
zstandard trains three dictionaries: a base on ordinary windows, one on toxic windows, and one of
the same size on other ordinary windows. A window is compressed with base and
toxic dictionary, and with base and ordinary dictionary; its gain is the
difference of the two lengths. What any text gains by more material is the same
on both sides, so the gains of ordinary windows scatter around zero.

Toxic texts hold mostly ordinary words, so both dictionaries are trained twice: first on all
windows of half of each class's texts, then on those windows of the other halves that
compress unusually well with the first dictionary of their side (beyond the 99 % of ordinary
windows). Chance matches do not repeat in texts that the first dictionary has not seen; toxic
phrases do.

A logistic curve over a document's histogram of gains, fitted on a fold that no
dictionary has seen, turns gains into a score; ``THRESHOLD`` is the contract's.

The dictionaries learn from at most ``max_rows`` labelled rows of each class,
those with the smallest id hash, from each distinct text among them once, and from at most
``MAX_WINDOWS`` windows of each part, those with the smallest hash; scores are given to every row.

Defined results: null and empty texts have no window and get the score of a
text without gains. Without texts of both classes in the training and the calibrating folds every score is 0.
Several labels of a document count as toxic if one is. Repeated rows are scored alike.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, slices, stage

#: Labelled rows of either class that are learnt from, at most, and windows of each part of them.
MAX_ROWS, MAX_WINDOWS = 20_000, 250_000
#: Words of a window, and between the beginnings of two.
WINDOW, STRIDE = 8, 4
#: Bytes of the base dictionary, and of the toxic and the ordinary one beside it.
BASE_BYTES, OWN_BYTES = 131_072, 4096
#: Parts of the ordinary texts: some for the base, the last two for the dictionary beside it.
ORDINARY_PARTS = 4
#: Windows compress unusually well beyond this share of the ordinary ones.
USUAL = 0.99
#: Gains are counted between these bounds.
LEAST_GAIN, MOST_GAIN = -8, 16
#: Scores from here on are toxic.
THRESHOLD = 0.3


def windows(text: str | None) -> list[bytes]:
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    return [b" " + b" ".join(words[k : k + WINDOW]) + b" " for k in range(0, max(1, len(words) - WINDOW + STRIDE), STRIDE)] if words else []


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary that zstandard trains on the samples; the samples themselves where they are too few for it."""
    held = [s for s in samples if len(s) >= 8]
    total = sum(map(len, held))
    if total > 4 * 1024 and len(held) >= 16:
        try:
            return zstandard.train_dictionary(max(512, min(size, total // 4)), held, k=16, d=6, level=3, dict_id=1).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(held)[-size:]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    log = max(13, (len(content) + 1024).bit_length())
    options = zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, strategy=zstandard.STRATEGY_GREEDY, min_match=4, window_log=log, hash_log=log + 2, chain_log=log + 1, search_log=3,
        write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=options)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=options)


def _lengths(content: bytes, samples: list[bytes]) -> np.ndarray:
    compress = compressor(content).compress
    return np.fromiter((len(compress(s)) for s in samples), np.int64, len(samples))


@dataclass
class ToxicityModel:
    base: bytes
    ordinary: bytes
    toxic: bytes
    #: Logistic weights of the features.
    weights: list[float] = field(default_factory=list)

    def __post_init__(self) -> None:
        self._ready = None

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("base", "ordinary", "toxic", "weights")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, _ready=None)

    def lengths(self, window: bytes) -> tuple[int, int]:
        """Compressed length with the ordinary dictionary, and with the toxic one."""
        if self._ready is None:
            # the last bytes of a dictionary are the cheapest to refer to, so the shared base is last
            self._ready = tuple(compressor(own + self.base) for own in (self.ordinary, self.toxic))
        ordinary, toxic = self._ready
        return len(ordinary.compress(window)), len(toxic.compress(window))

    def histogram(self, text: str | None) -> np.ndarray:
        """Number of windows by gain."""
        out = np.zeros(MOST_GAIN - LEAST_GAIN + 1, dtype=np.int64)
        if not self.toxic:
            return out
        pairs = (self.lengths(w) for w in windows(text))
        for gain, n in Counter(a - b for a, b in pairs).items():
            out[min(max(gain, LEAST_GAIN), MOST_GAIN) - LEAST_GAIN] += n
        return out

    @staticmethod
    def features(histogram: np.ndarray) -> np.ndarray:
        """Of rows of histograms: a constant, size, mean, how many gains reach some bounds and their shares."""
        h = np.atleast_2d(histogram).astype(float)
        gains = np.arange(LEAST_GAIN, MOST_GAIN + 1)
        n = np.maximum(h.sum(axis=1), 1)
        reached = [h[:, gains >= k].sum(axis=1) for k in (1, 2, 3, 4, 5, 6, 8, 10)]
        lost = [h[:, gains <= -k].sum(axis=1) for k in (1, 2, 4)]
        most = np.where(h > 0, gains, LEAST_GAIN).max(axis=1)
        return np.stack([np.ones(len(h)), np.log1p(h.sum(axis=1)) / 4, h @ gains / n, np.maximum(most, 0) / 8, *(np.log1p(r) for r in (*reached, *lost)), *(10 * r / n for r in (*reached, *lost))], axis=1)

    def score(self, text: str | None) -> float:
        if not self.weights:
            return 0.0
        z = float((self.features(self.histogram(text)) @ np.array(self.weights))[0])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton's method; the constant is not drawn to 0."""
    w, penalty = np.zeros(x.shape[1]), ridge * np.ones(x.shape[1])
    penalty[0] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def dictionaries(base: list[bytes], ordinary: tuple[list[bytes], list[bytes]], toxic: tuple[list[bytes], list[bytes]]) -> ToxicityModel:
    """The three dictionaries, from windows of ordinary texts for the base and of both halves of either side."""
    shared = dictionary(base, BASE_BYTES)
    found: tuple[list[bytes], list[bytes]] = [], []
    for one, other in ((0, 1), (1, 0)):
        plain, marked = dictionary(ordinary[one], OWN_BYTES) + shared, dictionary(toxic[one], OWN_BYTES) + shared
        own, others = (_lengths(plain, w) - _lengths(marked, w) for w in (ordinary[other], toxic[other]))
        high = max(1.0, float(np.quantile(own, USUAL))) if len(own) else 1.0
        low = float(np.quantile(own, 1 - USUAL)) if len(own) else 0.0
        found[0].extend(w for w, g in zip(ordinary[other], own, strict=True) if g <= low)
        found[1].extend(w for w, g in zip(toxic[other], others, strict=True) if g >= high)
    return ToxicityModel(shared, dictionary(found[0], OWN_BYTES), dictionary(found[1] or [*toxic[0], *toxic[1]], OWN_BYTES))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> ToxicityModel:
    """Dictionaries from folds 0 and 1 of the labelled rows, the curve from fold 3; fold 2 is held out."""
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(fold("doc_id", 4) != 2).withColumn("order", F.xxhash64("doc_id"))
    ids = None
    for kind in (0, 1):
        some = known.where(F.col("toxic") == kind).orderBy("order", "doc_id").limit(max_rows)
        ids = some if ids is None else ids.unionByName(some)
    # at most 2 * max_rows ids
    picked = docs.select("doc_id", "text").join(F.broadcast(ids.select("doc_id", "toxic")), "doc_id")
    # a text in several rows counts once, as toxic if one label says so
    picked = picked.groupBy("text", (fold("doc_id", 4) == 3).alias("calibrating")).agg(F.max("toxic").alias("toxic"))
    picked = stage(picked, "toxicity-labelled")
    sizes = {(r.calibrating, r.toxic): r.n for r in picked.groupBy("calibrating", "toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 4:
        return ToxicityModel(b"", b"", b"")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch["toxic"].to_pylist()
            for first, texts in slices(batch["text"].to_pylist()):
                parts, orders, held = [], [], []
                for text, toxic in zip(texts, marks[first:], strict=False):
                    h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
                    part = 10 + h % 2 if toxic else h % ORDINARY_PARTS
                    for k, window in enumerate(windows(text)):
                        parts.append(part)
                        orders.append(xxhash.xxh3_64_intdigest(window, seed=(h + k) & 0xFFFFFFFF) >> 1)
                        held.append(window)
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(orders, pa.int64()), pa.array(held, pa.binary())], ["part", "order", "window"])

    every = stage(picked.where("NOT calibrating").select("text", "toxic").mapInArrow(cut, "part int, order long, window binary"), "toxicity-windows")

    def sample(of: tuple[int, ...]) -> list[bytes]:
        some = every.where(F.col("part").isin(list(of))).orderBy("order", "window").limit(MAX_WINDOWS).select("window").toArrow()
        return some["window"].to_pylist()

    last = ORDINARY_PARTS - 1
    model = dictionaries(sample(tuple(range(last - 1))), (sample((last - 1,)), sample((last,))), (sample((10,)), sample((11,))))
    shared = spark.sparkContext.broadcast(model)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [shared.value.histogram(text).tolist() for text in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array(rows, pa.list_(pa.int64()))], ["toxic", "gains"])

    # at most max_rows small rows of either class
    seen = picked.where("calibrating").select("text", "toxic").mapInArrow(profile, "toxic int, gains array<long>").orderBy("toxic", "gains").collect()
    model.weights = fit(model.features(np.array([r.gains for r in seen])), np.array([r.toxic for r in seen], dtype=float)).tolist()
    return model


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(text) for text in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", 4) == 2).alias("held_out"), "text")
    return given.mapInArrow(apply, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not predicted toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([shared.value.score(text) < THRESHOLD for text in batch["text"].to_pylist()], pa.bool_()))

    return docs.mapInArrow(apply, docs.schema)


def run(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
