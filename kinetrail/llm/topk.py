"""Exact top-k search with a bit-sliced index.

Every component is quantised to floor(scale * x) and stored, less the block's
smallest value of that attribute, as bit slices: bitmaps over the rows of a
block. For a query the slices of all attributes are added with bitmap
arithmetic, a slice counting 2^bit times each set bit of the query's component
(negative components take the complement), by carry-save adders that turn three bitmaps
of a weight into one of that weight and one of the next. The sum is itself bit-sliced: the
top rows are picked from its most significant slice downward, and where more
rows tie at the boundary than are left to pick, the smallest ids are taken. The
scores of picked rows are read back from the sum's slices and are exact.

Queries and rows are both dealt in blocks; each pair of blocks is one row of an
equi-join on the query block, yields at most k rows a query, and those meet in
a window by query. The rows of a block are in id order, so a smaller id is a
smaller position.

Defined results: a vector that is null or holds a null or non-finite component takes
no part, nor does a row with a null id. Of vectors of different lengths the shorter
one counts as padded with zeros; an empty one takes part and scores 0. Repeated ids are separate rows; a
query's own id is never its candidate. Queries that repeat an id are answered once for
each distinct vector row. With fewer than k candidates all are returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pack as packed
from .common import stage, unpack

#: Rows of an index block, queries of a query block.
ROW_BLOCK, QUERY_BLOCK = 16_384, 512
SCALE, K, QUERY_MODULUS = 64, 20, 20


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, q array<int> of the rows that take part."""
    sound = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: F.coalesce((~F.isnan(x)) & (F.abs(x) != float("inf")), F.lit(False)))
    return vectors.where(F.col("vec_id").isNotNull() & sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("q"))


def _matrix(arrays: list) -> np.ndarray:
    width = max((len(a) for a in arrays), default=0)
    out = np.zeros((len(arrays), width), dtype=np.int64)
    for k, a in enumerate(arrays):
        out[k, : len(a)] = a
    return out


class Block:
    """Bit slices of a block of rows in id order."""

    def __init__(self, ids: np.ndarray, values: np.ndarray) -> None:
        self.ids, self.low = ids, values.min(axis=0)
        self.words = (len(ids) + 63) // 64
        above = values - self.low
        self.depths = [int(x).bit_length() for x in above.max(axis=0)]
        padded = np.zeros((self.words * 64, values.shape[1]), dtype=np.int64)
        padded[: len(ids)] = above
        slices = [np.packbits(((padded[:, d] >> b) & 1).astype(np.uint8), bitorder="little").view("<u8") for d, depth in enumerate(self.depths) for b in range(depth)]
        self.slices = np.array(slices, dtype=np.uint64).reshape(len(slices), self.words)
        self.places = np.array([(d, b) for d, depth in enumerate(self.depths) for b in range(depth)], dtype=np.int64).reshape(-1, 2)
        self.all = np.packbits(np.arange(self.words * 64) < len(ids), bitorder="little").view("<u8")

    def sums(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """The bit-sliced sum of query times rows, lowest slice first, and what must be added to it."""
        width = len(self.low)
        q = np.zeros(width, dtype=np.int64)
        q[: min(width, len(query))] = query[:width]
        constant = int(q @ self.low)
        negative = q < 0
        # -x is the complement of x in its slices, less 2 ** depth - 1
        constant -= sum(int(-q[d]) * ((1 << self.depths[d]) - 1) for d in np.flatnonzero(negative))
        weights: dict[int, list[np.ndarray]] = {}
        size = np.abs(q)
        d, b = self.places[:, 0], self.places[:, 1]
        own = size[d]
        for bit in range(int(size.max(initial=0)).bit_length()):
            for level in range(int(b.max(initial=-1)) + 1):
                pick = np.flatnonzero(((own >> bit) & 1 == 1) & (b == level))
                if len(pick):
                    part = self.slices[pick]
                    flip = negative[d[pick]]
                    if flip.any():
                        part[flip] ^= self.all
                    weights.setdefault(bit + level, []).append(part)
        out, level = [], 0
        while weights:
            parts = weights.pop(level, None)
            if parts is None:
                out.append(np.zeros(self.words, dtype=np.uint64))
                level += 1
                continue
            held = np.concatenate(parts) if len(parts) > 1 else parts[0]
            carries = []
            while len(held) >= 3:
                n = len(held) // 3
                x, y, z = held[:n], held[n : 2 * n], held[2 * n : 3 * n]
                half = x ^ y
                carries.append((x & y) | (half & z))
                held = np.concatenate((half ^ z, held[3 * n :]))
            if len(held) == 2:
                carries.append((held[0] & held[1])[None])
                held = (held[0] ^ held[1])[None]
            out.append(held[0])
            if carries:
                weights.setdefault(level + 1, []).extend(carries)
            level += 1
        return out, constant

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows, without the query's own id; ties at the boundary to smaller ids."""
        total, constant = self.sums(query)
        sure, open_ = np.zeros(self.words, dtype=np.uint64), self.all.copy()
        at = np.searchsorted(self.ids, own)
        while at < len(self.ids) and self.ids[at] == own:
            open_[at // 64] &= ~(np.uint64(1) << np.uint64(at % 64))
            at += 1
        found = 0
        for piece in reversed(total):
            ones = open_ & piece
            n = int(np.bitwise_count(ones).sum())
            if found + n <= k:
                sure |= ones
                found += n
                open_ &= ~piece
            else:
                open_ = ones
            if found == k:
                break
        picked = _positions(sure)
        if found < k:
            picked = np.concatenate((picked, _positions(open_)[: k - found]))
        scores = np.full(len(picked), constant, dtype=np.int64)
        for bit, piece in enumerate(total):
            scores += ((piece[picked // 64] >> (picked % 64).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << bit
        return self.ids[picked], scores


def _positions(bitmap: np.ndarray) -> np.ndarray:
    words = np.flatnonzero(bitmap)
    if not len(words):
        return np.zeros(0, dtype=np.int64)
    bits = np.unpackbits(bitmap[words].view(np.uint8).reshape(len(words), 8), axis=1, bitorder="little")
    row, bit = np.nonzero(bits)
    return words[row] * 64 + bit


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """block, ids, width, values: at most ``size`` rows in id order, packed; dealt by hash to blocks whose number follows that of the rows."""
    # an even deal fills blocks to nine tenths
    dealt = max(1, math.ceil(rows.count() / (0.9 * size)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_ids: list[int] = []
        held: list = []
        last = None

        def out() -> pa.RecordBatch:
            values = _matrix(held)
            got = pa.RecordBatch.from_pydict({"ids": [packed(np.array(held_ids, dtype=np.int64))], "width": pa.array([values.shape[1]], pa.int32()), "values": [packed(values)]})
            held_ids.clear()
            held.clear()
            return got

        for batch in batches:
            for part, vec_id, q in zip(batch["part"].to_pylist(), batch["vec_id"].to_pylist(), batch["q"].to_numpy(zero_copy_only=False), strict=True):
                if held and (part != last or len(held) >= size):
                    yield out()
                last = part
                held_ids.append(vec_id)
                held.append(q)
        if held:
            yield out()

    placed = rows.withColumn("part", F.pmod(F.xxhash64("vec_id", "q"), F.lit(dealt)))
    sent = placed.repartition("part").sortWithinPartitions("part", "vec_id", "q")
    return stage(sent.mapInArrow(cut, "ids binary, width int, values binary"), name).withColumn("block", F.monotonically_increasing_id())


def search(vectors: DataFrame, k: int = K, modulus: int = QUERY_MODULUS, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row whose id is divisible by ``modulus``."""
    rows = quantised(vectors, scale)
    index = _blocks(rows, ROW_BLOCK, "topk-index").withColumnsRenamed({"ids": "row_ids", "width": "row_width", "values": "row_values", "block": "row_block"})
    queries = stage(_blocks(rows.where(F.col("vec_id") % modulus == 0), QUERY_BLOCK, "topk-queries"), "topk-query-blocks")
    numbers = [r.block for r in queries.select("block").collect()]  # one number for QUERY_BLOCK queries
    if not numbers:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                row_ids = unpack(r["row_ids"], "int64")
                block = Block(row_ids, unpack(r["row_values"], "int64").reshape(len(row_ids), r["row_width"]))
                ids = unpack(r["ids"], "int64")
                values = unpack(r["values"], "int64").reshape(len(ids), r["width"])
                got = [(q, n, *block.top(v, int(q), k)) for n, (q, v) in enumerate(zip(ids, values, strict=True))]
                lengths = [len(x[2]) for x in got]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, lengths)), pa.array(np.repeat(np.arange(len(ids)) + (r["block"] << 12), lengths)), pa.array(np.concatenate([x[2] for x in got])), pa.array(np.concatenate([x[3] for x in got]))],
                    ["query_id", "query", "vec_id", "score"],
                )

    # each index block goes to each query block once: blocks against blocks on an equal key
    pairs = index.withColumn("block", F.explode(F.lit(numbers).cast("array<long>"))).join(queries, "block").repartition(F.col("block"), F.col("row_block"))
    found = pairs.mapInArrow(compare, "query_id long, query long, vec_id long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(frame: pd.DataFrame, k: int = K, modulus: int = QUERY_MODULUS, scale: int = SCALE) -> pd.DataFrame:
    """The same by a full product; for tests."""
    sound = [v is not None and all(x is not None and np.isfinite(x) for x in v) for v in frame.embedding]
    frame = frame[sound]
    q = np.floor(np.array(frame.embedding.tolist(), dtype=np.float32).astype(np.float64) * scale).astype(np.int64)
    ids, out = frame.vec_id.to_numpy(), []
    for i in np.flatnonzero(ids % modulus == 0):
        scores = q @ q[i]
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != ids[i]][:k]
        out += [(ids[i], r, ids[j], scores[j]) for r, j in enumerate(order, 1)]
    return pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])


def run(vectors: DataFrame) -> DataFrame:
    return search(vectors)
