"""Helpers that the operators of this subpackage share.

Intermediate results that are read more than once are written as Parquet into
the folder the cluster names in ``spark.checkpoint.dir``; a lost executor then
costs a re-read and never a recomputation of what came before.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts of a record batch are worked on in slices of about so many characters, which bounds a worker's memory.
SLICE_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, modulus: int) -> Column:
    """crc32 of an id's text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder; a temporary folder only where none is set, as in local tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext.getCheckpointDir()
        if not held:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            held = tempfile.mkdtemp(prefix="kinetrail-")
            spark.sparkContext.setCheckpointDir(held)
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back, which cuts its lineage."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(texts: Iterable[str | None], chars: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Consecutive runs of texts (null: empty) of at least one text and about ``chars``, each with its first position."""
    first, held, size = 0, [], 0
    for k, text in enumerate(texts):
        held.append(text or "")
        size += len(held[-1])
        if size >= chars:
            yield first, held
            first, held, size = k + 1, [], 0
    if held:
        yield first, held


def column_slices(column: pa.Array, chars: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """The same slices of a text column, of which only a part is ever turned into strings."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for k, size in enumerate(sizes.tolist()):
        held += size
        if held >= chars or k + 1 == len(sizes):
            yield first, [t or "" for t in column.slice(first, k + 1 - first).to_pylist()]
            first, held = k + 1, 0


def segment_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of values[start:end] for ascending disjoint segments, 0 for empty ones."""
    out = np.zeros(len(starts), dtype=np.float64)
    full = ends > starts
    if full.any():
        at = np.empty(2 * int(full.sum()), dtype=np.int64)
        at[::2], at[1::2] = starts[full], ends[full]
        padded = np.append(values, values.dtype.type(0))
        out[full] = np.add.reduceat(padded, at, dtype=np.float64)[::2]
    return out


def pack(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(array).tobytes())


def unpack(payload: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), dtype=dtype)


def salt(of: int = 32) -> int:
    """Spreads the partial arrays of a key over several first-level sums."""
    context = TaskContext.get()
    return (context.partitionId() if context else 0) % of


def sum_arrays(parts: DataFrame, dtype: str) -> DataFrame:
    """Sum packed arrays by key in two levels, (key, salt) and key.

    ``parts`` has key string, salt int, payload binary. Each task adds arrays as
    they stream past and holds one array a key, however many partitions sent one.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for key, payload in zip(batch["key"].to_pylist(), batch["payload"].to_pylist(), strict=True):
                got = unpack(payload, dtype)
                if key in sums:
                    sums[key] += got
                else:
                    sums[key] = got.copy()
        for key, total in sums.items():
            yield pa.RecordBatch.from_pydict({"key": [key], "salt": pa.array([0], pa.int32()), "payload": [pack(total)]})

    schema = "key string, salt int, payload binary"
    first = parts.repartition("key", "salt").mapInArrow(add, schema)
    return first.repartition("key").mapInArrow(add, schema).select("key", "payload")
