"""Media columns over content-addressed payloads in tar shards.

A text's UTF-8 bytes, padded with zeros to a positive multiple of 64, become
the samples of an 8-bit greyscale PNG, 64 wide. Each distinct image is stored
once, named by its payload's digest, as a member of a tar shard in the shared
folder. Rows carry digest, shard, offset and length. Metadata columns (width, height, bit depth) come
from ranged reads of the images' headers alone; the payload's columns come from
ranged reads of whole members.

Payloads are not shuffled unless their text is repeated. A first pass counts
digests and marks those of several rows in a bitmap of fixed size; a second one
writes the images of all others straight from its tasks, and sends marked ones,
each once a task, to be written by digest. A bit that several digests share only sends an
image the longer way. A shard's name holds its task attempt, and only shards
of attempts that committed are in the index, so a lost executor leaves unused
files at most.

The folder's file system is the one that Spark's configuration names for it (local, HDFS or an object
store); other schemes raise an error before any job starts.

Defined results: null and empty texts are 64 zero bytes. Equal texts get equal
values and one stored image. Repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, stage

WIDTH = 64
#: Bytes of the shards, about, and of digests that a task remembers before its shuffle.
SHARD_BYTES, REMEMBERED = 64 << 20, 200_000
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
#: Bytes from a PNG's start to the end of its header chunk.
HEADER_BYTES = 33
_BLOCK = 512
#: log2 of the bits that mark repeated digests, taken from a digest's first bytes.
MARK_BITS = 24


def payload(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(samples: bytes) -> bytes:
    """An 8-bit greyscale PNG whose rows are unfiltered."""
    rows = np.frombuffer(samples, dtype=np.uint8).reshape(-1, WIDTH)
    filtered = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)
    filtered[:, 1:] = rows
    return PNG_MAGIC + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(filtered.tobytes(), 1)) + _chunk(b"IEND", b"")


def header(start: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from an image's first HEADER_BYTES bytes."""
    if start[:8] != PNG_MAGIC or start[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", start[16:25])


def decode(image: bytes) -> bytes:
    """The samples of an image that ``encode`` made; checksums are verified."""
    at, held, size = 8, [], header(image)
    while at < len(image):
        n = struct.unpack(">I", image[at : at + 4])[0]
        kind, data = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged PNG")
        if kind == b"IDAT":
            held.append(data)
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(held)), dtype=np.uint8).reshape(size[1], size[0] + 1)[:, 1:].tobytes()


def tar_header(name: str, size: int) -> bytes:
    """A ustar header of a regular file."""
    held = bytearray(_BLOCK)
    for at, value in ((0, name.encode()), (100, b"0000644\0"), (108, b"0000000\0"), (116, b"0000000\0"), (124, b"%011o\0" % size), (136, b"00000000000\0"), (148, b" " * 8), (156, b"0"), (257, b"ustar\x0000")):
        held[at : at + len(value)] = value
    held[148:156] = b"%06o\0 " % sum(held)
    return bytes(held)


#: Schemes of Spark's paths that this module can read and write, and their names in pyarrow.
SCHEMES = {"file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs"}


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that Spark's own configuration gives it, so that shards and index lie in one file system; an error for schemes without a driver."""
    jvm = spark._jvm  # noqa: SLF001
    held = jvm.org.apache.hadoop.fs.Path(path)
    # of a scheme that Hadoop cannot open either this raises
    uri = held.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(held).toUri()  # noqa: SLF001
    if uri.getScheme() not in SCHEMES:
        raise ValueError(f"media shards cannot be written to a path of scheme {uri.getScheme()!r}: {path}")
    return uri.toString()


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a qualified path, and the path in it."""
    scheme, _, rest = uri.partition(":")
    if scheme not in SCHEMES:
        raise ValueError(f"not a qualified path: {uri}")
    return (pafs.LocalFileSystem(), "/" + rest.lstrip("/")) if scheme == "file" else pafs.FileSystem.from_uri(f"{SCHEMES[scheme]}:{rest}")


class _Shards:
    """Writes images into tar shards of a folder, and keeps their index rows."""

    def __init__(self, folder: str, kind: str) -> None:
        self.fs, self.folder = filesystem(folder)
        context = TaskContext.get()
        self.name = f"{kind}-{context.partitionId():06d}-{context.taskAttemptId()}"
        self.out, self.at, self.n, self.rows = None, 0, 0, []

    def add(self, digest: bytes, image: bytes) -> None:
        if self.out is None:
            self.fs.create_dir(self.folder, recursive=True)
            self.shard = f"{self.folder}/{self.name}-{self.n:04d}.tar"
            self.out, self.at, self.n = self.fs.open_output_stream(self.shard), 0, self.n + 1
        self.out.write(tar_header(f"{digest.hex()}.png", len(image)))
        self.out.write(image)
        self.out.write(bytes(-len(image) % _BLOCK))
        self.rows.append((digest, self.shard, self.at + _BLOCK, len(image), None))
        self.at += _BLOCK + len(image) + -len(image) % _BLOCK
        if self.at >= SHARD_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(2 * _BLOCK))
            self.out.close()
            self.out = None

    def take(self) -> list[tuple]:
        held, self.rows = self.rows, []
        return held


MEMBERS = "digest binary, shard string, offset long, length long, image binary"


def _members(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 5, kinds, strict=True)], ["digest", "shard", "offset", "length", "image"])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, digest of each row's payload."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array([hashlib.sha256(payload(t)).digest() for t in texts], pa.binary())], ["doc_id", "n_bytes", "digest"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(apply, "doc_id long, n_bytes long, digest binary")


def repeated(rows: DataFrame) -> bytes:
    """A bitmap of 2 ** MARK_BITS bits with those of the digests of several rows."""
    several = rows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    place = F.conv(F.hex(F.substring("digest", 1, MARK_BITS // 8)), 16, 10).cast("long") + 1  # Spark counts positions and buckets from 1
    parts = several.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = bytearray((1 << MARK_BITS) // 8)
    size = 4096  # bytes of each part
    for r in parts.collect():
        out[(r.bucket - 1) * size : r.bucket * size] = r.bits[:size]
    return bytes(out)


def store(docs: DataFrame, folder: str | None = None, rows: DataFrame | None = None) -> DataFrame:
    """Write each distinct text's image into tar shards; the index: digest, shard, offset, length. ``rows`` are the documents' digests, if at hand."""
    target = qualified(docs.sparkSession, folder or scratch(docs.sparkSession, "media-shards"))
    marks = docs.sparkSession.sparkContext.broadcast(repeated(digests(docs.withColumn("doc_id", F.lit(0))) if rows is None else rows))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, seen = _Shards(target, "one"), set()
        for batch in batches:
            sent, size = [], 0
            for text in batch["text"].to_pylist():
                samples = payload(text)
                digest = hashlib.sha256(samples).digest()
                place = int.from_bytes(digest[: MARK_BITS // 8], "big")
                if not marks.value[place >> 3] >> (place & 7) & 1:
                    shards.add(digest, encode(samples))
                elif digest not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(digest)
                    sent.append((digest, None, None, None, encode(samples)))
                    size += len(sent[-1][4])
                if size > 8 << 20:
                    yield _members(sent)
                    sent, size = [], 0
            yield _members(sent + shards.take())
        shards.close()

    def write_repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, last = _Shards(target, "many"), None
        for batch in batches:
            for digest, image in zip(batch["digest"].to_pylist(), batch["image"].to_pylist(), strict=True):
                if digest != last:  # rows are in digest order
                    shards.add(digest, image)
                last = digest
            yield _members(shards.take())
        shards.close()

    found = stage(docs.select("text").mapInArrow(write, MEMBERS), "media-members")
    sent = found.where(F.col("image").isNotNull()).select("digest", "image").repartition("digest").sortWithinPartitions("digest")
    index = found.where(F.col("image").isNull()).unionByName(stage(sent.mapInArrow(write_repeated, MEMBERS), "media-repeated"))
    return index.drop("image")


def _ranges(batch: pa.RecordBatch, fs_root: str) -> Iterator[tuple[pa.NativeFile, int, int]]:
    """An open shard, offset and length for each row; one shard is open at a time."""
    fs, _ = filesystem(fs_root)
    name, held = None, None
    for shard, offset, length in zip(batch["shard"].to_pylist(), batch["offset"].to_pylist(), batch["length"].to_pylist(), strict=True):
        if shard != name:
            if held is not None:
                held.close()
            name, held = shard, fs.open_input_file(shard)
        yield held, offset, length
    if held is not None:
        held.close()


def describe(index: DataFrame, root: str) -> DataFrame:
    """Width, height and bit depth of each member, from its header's bytes alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [header(f.read_at(HEADER_BYTES, offset)) for f, offset, _ in _ranges(batch, root)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([g[k] for g in got], pa.int32()) for k in range(3))], [*batch.schema.names, "width", "height", "bit_depth"])

    return index.mapInArrow(read, "digest binary, shard string, offset long, length long, width int, height int, bit_depth int")


def features(index: DataFrame, root: str) -> DataFrame:
    """Each member read back: size and digest of image and samples, checksum of the last samples, and a feature line."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                rows = []
                for f, offset, length in _ranges(batch, root):
                    image = f.read_at(length, offset)
                    samples = decode(image)
                    values = np.frombuffer(samples, dtype=np.uint8)
                    counts = np.bincount(values, minlength=256)
                    mean = float(counts @ np.arange(256)) / len(values)
                    share = counts[counts > 0] / len(values)
                    feature = f"mean={mean:.4f};distinct={len(share)};entropy={max(0.0, float(-(share * np.log2(share)).sum())):.4f}"
                    rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-WIDTH:]), len(image), hashlib.sha256(image).hexdigest(), feature))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], [*batch.schema.names, *names])

    return index.mapInArrow(read, index.schema.simpleString()[7:-1].replace(":", " ") + ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def run(docs: DataFrame) -> DataFrame:
    """Store, describe and read back; a row for each row of ``docs`` with the columns of its media."""
    root = qualified(docs.sparkSession, scratch(docs.sparkSession, "media-shards"))
    rows = stage(digests(docs), "media-digests")
    # the members of a shard are read in their order by one task
    index = store(docs, root, rows).repartition("shard").sortWithinPartitions("shard", "offset")
    members = features(describe(index, root), root)
    return rows.join(members, "digest").select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bit_depth", F.element_at(F.split("shard", "/"), -1).alias("shard"), "offset", "length"
    )
