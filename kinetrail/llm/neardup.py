"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A document is its set of shingles, five consecutive words (lower case, cut at white
space), each with weight (1 + ln tf) * idf. The idf saturates: 1.25 for shingles in
less than a tenth of all documents, falling to 1 for those in all. Document
frequencies of all documents are held in 2 ** 20 hashed slots, so both texts of a pair
see the same weights and the table does not grow; since only frequencies near a tenth of
the corpus matter, what shares a slot with a frequent shingle is off by very
little.

Consistent weighted samples (Ioffe 2010), 24 bands of 5, collide for a pair of
similarity 0.8 with probability 0.9999. Equal texts become one node first. In each
bucket of a band the smallest node is the leader, and only (member, leader)
pairs are verified by their weighted Jaccard similarity, which links a hot bucket
with as many pairs as it has members. What a leader does not decide is searched
afterwards. Members x and y can only be linked if |d(x, leader) - d(y, leader)| <= 0.2
for the distance d = 1 - similarity, a metric; if their total weights are within the
similarity; and if a sketch, a byte of each of the 120 samples, agrees in at least 75
(at 0.8 it agrees in 96 on average, in fewer than 75 with a probability of about 1e-6).
A first round verifies each member's best such partner in a bucket. The second one
takes all such pairs that still lie in different components, compares and verifies them inside
blocks of a bucket's members, where only those outside the bucket's largest
component meet all blocks, each pair in the first band it shares, and returns links alone: no list of pairs grows with the square of a group, and no link is
given up for a bucket's size. Connected components of the links are the classes.

Defined results: equal texts share a class, even empty ones. A null text is a
class of its own. A text of one to four words is one shingle. The class id is
the smallest doc_id of the class, null if all its ids are null. Repeated rows
are rows of the same class. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_slices, pack, salt, stage, sum_arrays, unpack

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
SAMPLES = BANDS * ROWS
SLOT_BITS, BLOCK_BITS, POOL_BITS = 20, 16, 16
#: Samples of the sketch that must agree; members of a block; pairs of a leader that one group verifies.
LEAST_AGREEING, BLOCK_MEMBERS, FAN = 75, 1024, 1000
#: Shingles of the profiles that a block's comparison keeps at hand.
HELD_SHINGLES = 4_000_000
#: Words and texts that a task remembers.
REMEMBERED_WORDS, REMEMBERED_TEXTS = 200_000, 100_000
IDF_RANGE = 0.25


class _Ids(dict):
    """Hashes of words."""

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, ids: _Ids) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of a text, and how often each occurs."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    w = np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))
    n = min(WORDS, len(w))
    h = w[: len(w) - n + 1].copy()
    for k in range(1, n):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += w[k : len(w) - n + 1 + k]
    return np.unique(_mix(h), return_counts=True)


def slot_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def idf_table(frequency: np.ndarray, documents: int) -> np.ndarray:
    return (1 + IDF_RANGE * np.clip(np.log((documents + 1) / (np.minimum(frequency, documents) + 1)) / np.log(10), 0, 1)).astype(np.float64)


def weights(h: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1 + np.log(tf)) * idf[slot_of(h)]


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    (ha, wa), (hb, wb) = a, b
    if not len(ha) or not len(hb):
        return 0.0
    at = np.minimum(np.searchsorted(ha, hb), len(ha) - 1)
    both = ha[at] == hb
    shared = np.minimum(wa[at[both]], wb[both]).sum()
    return float(shared / (wa.sum() + wb.sum() - shared))


def apart(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the corpus: joined by sorting, so that it is never collected on the driver to be broadcast."""
    return df.hint("merge")


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """The idf of each slot, from all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, documents = _Ids(), np.zeros(1 << SLOT_BITS, np.int64), 0
        for batch in batches:
            for _, texts in column_slices(batch["text"]):
                parts = [shingles(t, ids)[0] for t in texts]
                documents += sum(len(p) > 0 for p in parts)
                held += np.bincount(np.concatenate([slot_of(p) for p in parts]), minlength=1 << SLOT_BITS)
        rows = [("n", np.array([documents]))] + [(str(k), held[k << BLOCK_BITS : (k + 1) << BLOCK_BITS]) for k in range(1 << (SLOT_BITS - BLOCK_BITS))]
        for key, part in rows:
            if part.any():
                yield pa.RecordBatch.from_pydict({"key": [key], "salt": pa.array([salt()], pa.int32()), "payload": [pack(part)]})

    frequency, documents = np.zeros(1 << SLOT_BITS, np.int64), 0
    for row in sum_arrays(docs.select("text").mapInArrow(count, "key string, salt int, payload binary"), "int64").collect():  # 17 rows at most
        got = unpack(row.payload, "int64")
        if row.key == "n":
            documents = int(got[0])
        else:
            frequency[int(row.key) << BLOCK_BITS : (int(row.key) + 1) << BLOCK_BITS] = got
    return idf_table(frequency, documents)


def _ordered(x: np.ndarray) -> np.ndarray:
    """float32 values as unsigned integers of the same order, in the upper half of 64 bits."""
    raw = np.ascontiguousarray(x, dtype=np.float32).view(np.uint32)
    return np.where(raw >> np.uint32(31), ~raw, raw | np.uint32(0x80000000)).astype(np.uint64) << np.uint64(32)


class Sampler:
    """Improved consistent weighted samples with random values from a seeded pool, indexed by shingle and sample."""

    def __init__(self, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        size = 1 << POOL_BITS
        self.r, self.log_c, self.beta = rng.gamma(2, 1, size), np.log(rng.gamma(2, 1, size)), rng.random(size)
        self.factors = rng.integers(1 << 62, size=SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.common = 1 + IDF_RANGE
        self.pool = _ordered(self.log_a(np.arange(size), np.log(self.common)))

    def log_a(self, at: np.ndarray, log_weight: np.ndarray | float) -> np.ndarray:
        t = np.floor(log_weight / self.r[at] + self.beta[at])
        return self.log_c[at] - self.r[at] * (t + 1 - self.beta[at])

    def signatures(self, h: np.ndarray, w: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Band hashes (documents x BANDS) and sketches (documents x SAMPLES bytes) of consecutive nonempty documents."""
        low = _mix(h) & np.uint64(0xFFFFFFFF)
        other = np.flatnonzero(np.abs(w - self.common) > 1e-9)
        log_w, h_other, low_other = np.log(w[other]), h[other], low[other]
        held, key = np.empty_like(h), np.empty_like(h)
        bands = np.zeros((len(starts), BANDS), np.uint64)
        sketch = np.zeros((len(starts), SAMPLES), np.uint8)
        shift = np.uint64(64 - POOL_BITS)
        for j, factor in enumerate(self.factors):
            np.multiply(h, factor, out=held)
            np.right_shift(held, shift, out=held)
            np.take(self.pool, held.view(np.int64), out=key, mode="clip")
            np.bitwise_or(key, low, out=key)
            if len(other):
                key[other] = _ordered(self.log_a(((h_other * factor) >> shift).astype(np.int64), log_w)) | low_other
            best = _mix(np.minimum.reduceat(key, starts))
            band = j // ROWS
            bands[:, band] = (bands[:, band] ^ best) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band + 1)
            sketch[:, j] = best >> np.uint64(56)
        return bands, sketch


def _digest(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()


def sign(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """doc_id, tid of each row with a text; bands, sketch and total weight too where a text with shingles is a task's first."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, ids, seen = Sampler(), _Ids(), set()
        for batch in batches:
            doc_ids = batch["doc_id"].to_pylist()
            for first, texts in column_slices(batch["text"]):
                tids = [_digest(t) for t in texts]
                fresh, parts = [], []
                for k, (tid, text) in enumerate(zip(tids, texts, strict=True)):
                    if tid in seen:
                        continue
                    if len(seen) >= REMEMBERED_TEXTS:
                        seen.clear()
                    seen.add(tid)
                    h, tf = shingles(text, ids)
                    if len(h):
                        fresh.append(k)
                        parts.append((h, weights(h, tf, shared.value)))
                bands: list = [None] * len(texts)
                sketches: list = [None] * len(texts)
                totals: list = [None] * len(texts)
                if fresh:
                    starts = np.concatenate(([0], np.cumsum([len(h) for h, _ in parts])[:-1])).astype(np.int64)
                    got, sketch = sampler.signatures(np.concatenate([h for h, _ in parts]), np.concatenate([w for _, w in parts]), starts)
                    for n, (k, b) in enumerate(zip(fresh, got.view(np.int64).tolist(), strict=True)):
                        bands[k], sketches[k], totals[k] = b, sketch[n].tobytes(), float(parts[n][1].sum())
                columns = (doc_ids[first : first + len(texts)], pa.int64()), (tids, pa.binary()), (bands, pa.list_(pa.int64())), (sketches, pa.binary()), (totals, pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], ["doc_id", "tid", "bands", "sketch", "total"])

    return docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "text").mapInArrow(apply, "doc_id long, tid binary, bands array<long>, sketch binary, total double")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """nid, text of the nodes in ``wanted`` (tid, nid)."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            texts = batch["text"].to_pylist()
            tids, keep = [_digest(t) for t in texts], []
            for tid in tids:
                keep.append(tid not in seen)
                if len(seen) >= REMEMBERED_TEXTS:
                    seen.clear()
                seen.add(tid)
            yield pa.RecordBatch.from_arrays([pa.array(tids, pa.binary()), batch["text"]], ["tid", "text"]).filter(pa.array(keep))

    held = docs.where(F.col("text").isNotNull()).select("text").mapInArrow(first, "tid binary, text string")
    return held.join(apart(wanted), "tid").groupBy("tid", "nid").agg(F.first("text").alias("text")).select("nid", "text")


def verify(pairs: DataFrame, texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """a, b, sim for each pair (a, b); the pairs of a node a are dealt to groups of about FAN, each with a copy of its text."""
    shared = pairs.sparkSession.sparkContext.broadcast(idf)
    fans = pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).cast("int").alias("fan"))
    members = pairs.join(apart(fans), "a").select("a", F.pmod(F.xxhash64("b"), F.col("fan")).cast("int").alias("part"), "b").join(apart(texts.withColumnRenamed("nid", "b")), "b")
    leads = fans.join(apart(texts.withColumnRenamed("nid", "a")), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, lead = _Ids(), None, None

        def profile(text: str) -> tuple[np.ndarray, np.ndarray]:
            h, tf = shingles(text, ids)
            return h, weights(h, tf, shared.value)

        for batch in batches:
            rows = []
            for a, part, b, text in zip(*(batch[c].to_pylist() for c in ("a", "part", "b", "text")), strict=True):
                if b is None:
                    held, lead = (a, part), profile(text)
                elif held == (a, part):
                    rows.append((a, b, weighted_jaccard(lead, profile(text))))
                else:
                    raise ValueError("a pair's text is missing")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 3, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["a", "b", "sim"])

    both = leads.unionByName(members.select("a", "part", "b", "text")).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
    return both.mapInArrow(compare, "a long, b long, sim double")


ROW = ("key", "block", "probe", "nid", "d", "comp", "total", "sketch", "main")


def _in_blocks(rows: DataFrame, *more: str) -> DataFrame:
    """Bucket rows dealt to blocks of their bucket, members first: each row is a member of one block, and a probe of all unless it is of the bucket's largest component."""
    rows = rows.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK_MEMBERS)).cast("int"))
    own = rows.withColumn("block", F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int")).withColumn("probe", F.lit(0))
    probes = rows.where(F.col("comp") != F.col("main")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("probe", F.lit(1))
    both = own.unionByName(probes).select(*ROW, *more)
    return both.repartition("key", "block").sortWithinPartitions("key", "block", "probe", "nid")


FAR = 1 - SIMILARITY + 1e-9


class _Block:
    """Members of a block, and which of them a probe may be linked with."""

    def __init__(self, members: list[tuple]) -> None:
        self.ids, self.comps, main = (np.array([m[k] for m in members], np.int64) for k in (3, 5, 8))
        self.probes = self.comps != main
        self.ds, self.totals = (np.array([m[k] for m in members], np.float64) for k in (4, 6))
        self.sketch = np.frombuffer(b"".join(m[7] for m in members), np.uint8).reshape(-1, SAMPLES)

    def partners(self, nid: int, d: float, comp: int, total: float, sketch: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Places of the members that may be linked with a probe, and in how many samples they agree; pairs of probes once."""
        close = (self.comps != comp) & (np.abs(self.ds - d) <= FAR) & (np.minimum(self.totals, total) >= (SIMILARITY - 1e-9) * np.maximum(self.totals, total))
        found = np.flatnonzero(close & (~self.probes | (self.ids > nid)))
        agree = (self.sketch[found] == np.frombuffer(sketch, np.uint8)).sum(axis=1)
        enough = agree >= LEAST_AGREEING
        return found[enough], agree[enough]


def _blocks_of(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[list[tuple], Iterator[tuple]]]:
    """The members of each block in turn, with an iterator over its probes."""
    rows = (row for batch in batches for row in zip(*(batch[c].to_pylist() for c in names), strict=True))
    for _, part in groupby(rows, key=lambda r: r[:2]):
        members: list[tuple] = []
        head = None
        for row in part:
            if row[2]:
                head = row
                break
            members.append(row)
        if head is not None:
            yield members, chain([head], part)


def best_partners(rows: DataFrame) -> DataFrame:
    """Pairs (a, b): each probe with the member of a block that agrees with it most."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for members, probes in _blocks_of(batches, ROW):
            block, out = _Block(members), []
            for row in probes:
                found, agree = block.partners(*row[3:8])
                if len(found):
                    y = int(block.ids[found[agree.argmax()]])
                    out.append((min(row[3], y), max(row[3], y)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return _in_blocks(rows).mapInArrow(compare, "a long, b long").distinct()


def partnered(rows: DataFrame) -> DataFrame:
    """key, nid of the rows that have a possible partner in another component."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for members, probes in _blocks_of(batches, ROW):
            block, key, out = _Block(members), members[0][0] if members else None, set()
            for row in probes:
                found, _ = block.partners(*row[3:8])
                if len(found):
                    out.add(row[3])
                    out.update(block.ids[found].tolist())
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(out), pa.int64()), pa.array(sorted(out), pa.int64())], ["key", "nid"])

    return _in_blocks(rows).mapInArrow(compare, "key long, nid long").distinct()


def resolve(rows: DataFrame, idf: np.ndarray) -> DataFrame:
    """Links (a, b) among bucket rows that also have text, band and bands: all pairs in different components are verified in place, unless links found before join them."""
    shared = rows.sparkSession.sparkContext.broadcast(idf)
    names = (*ROW, "text", "band", "bands")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, profiles, size = _Ids(), {}, 0

        def profile(nid: int, text: str) -> tuple[np.ndarray, np.ndarray]:
            nonlocal size
            held = profiles.get(nid)
            if held is None:
                h, tf = shingles(text, ids)
                held = h, weights(h, tf, shared.value)
                if size > HELD_SHINGLES:
                    profiles.clear()
                    size = 0
                profiles[nid] = held
                size += len(h)
            return held

        for members, probes in _blocks_of(batches, names):
            block, links = _Block(members), []
            bands = np.array([m[11] for m in members], np.int64)
            parent: dict[int, int] = {}

            def find(x: int, parent: dict[int, int] = parent) -> int:
                while parent.get(x, x) != x:
                    x = parent[x]
                return x

            for row in probes:
                found, agree = block.partners(*row[3:8])
                # each pair once, in the first band that it shares
                here = (bands[found] == np.array(row[11], np.int64)).argmax(axis=1) == row[10]
                for k in found[here][np.argsort(-agree[here], kind="stable")]:
                    one, two = find(row[5]), find(int(block.comps[k]))
                    if one != two and weighted_jaccard(profile(row[3], row[9]), profile(members[k][3], members[k][9])) >= SIMILARITY:
                        parent[max(one, two)] = min(one, two)
                        links.append((row[3], members[k][3]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return _in_blocks(rows, "text", "band", "bands").mapInArrow(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """nid, comp (the smallest node reached) of every node of ``edges`` (a, b); labels spread to neighbours and jump to their label's label."""
    both = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "neardup-edges")
    labels = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("nid"), F.least("a", "m").alias("comp")), "neardup-labels")
    while True:
        near = both.join(apart(labels.withColumnsRenamed({"nid": "b", "comp": "c"})), "b").groupBy(F.col("a").alias("nid")).agg(F.min("c").alias("c"))
        spread = labels.join(apart(near), "nid").select("nid", "comp", F.least("comp", "c").alias("c"))
        jump = labels.select(F.col("nid").alias("c"), F.col("comp").alias("j"))
        moved = stage(spread.join(apart(jump), "c").select("nid", F.col("comp").alias("old"), F.least("c", "j").alias("comp")), "neardup-labels")
        labels = moved.select("nid", "comp")
        if moved.where("comp <> old").isEmpty():
            return labels


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, tid, class_id for every row of ``docs``; tid is the digest of its text."""
    idf = document_frequencies(docs)
    signed = stage(sign(docs, idf), "neardup-signed")
    grouped = signed.groupBy("tid").agg(F.min("doc_id").alias("rep"), *(F.first(c, ignorenulls=True).alias(c) for c in ("bands", "sketch", "total")))
    nodes = stage(grouped.withColumn("nid", F.monotonically_increasing_id()), "neardup-nodes")
    member = nodes.where(F.col("bands").isNotNull()).select("nid", F.posexplode("bands").alias("band", "key"))
    buckets = member.groupBy("key").agg(F.min("nid").alias("leader"), F.count("*").alias("n")).where("n > 1")
    rows = stage(member.join(apart(buckets), "key").where("nid <> leader"), "neardup-buckets")
    pairs = stage(rows.select(F.col("leader").alias("a"), F.col("nid").alias("b")).distinct(), "neardup-pairs")
    # all members of buckets, so every later pair's texts are among these
    wanted = pairs.select(F.col("a").alias("nid")).unionByName(pairs.select(F.col("b").alias("nid"))).distinct().join(apart(nodes.select("nid", "tid")), "nid")
    texts = stage(_texts(docs, wanted), "neardup-texts")
    scored = stage(verify(pairs, texts, idf), "neardup-scored")
    links = scored.where(F.col("sim") >= SIMILARITY).select("a", "b")
    comps = components(links)

    measured = rows.join(apart(scored.withColumnsRenamed({"a": "leader", "b": "nid"})), ["leader", "nid"]).withColumn("d", 1 - F.col("sim"))
    open_keys = measured.where(F.col("sim") < SIMILARITY).select("key").distinct()
    # a bucket whose only other member is far from its leader is decided
    left = measured.where("n > 2").join(apart(open_keys), "key", "left_semi").join(apart(nodes.select("nid", "sketch", "total")), "nid")
    left = stage(left.select("key", "band", "nid", "d", "n", "sketch", "total"), "neardup-left")

    def with_components() -> DataFrame:
        held = left.join(apart(comps), "nid", "left").withColumn("comp", F.coalesce("comp", "nid"))
        largest = held.groupBy("key", "comp").agg(F.count("*").alias("size")).groupBy("key").agg(F.max(F.struct("size", "comp"))["comp"].alias("main"))
        return held.join(apart(largest), "key")

    best = stage(best_partners(with_components()), "neardup-best")
    if not best.isEmpty():
        links = stage(links.unionByName(verify(best, texts, idf).where(F.col("sim") >= SIMILARITY).select("a", "b")), "neardup-links")
        comps = components(links)
        still = stage(partnered(with_components()), "neardup-still")
        if not still.isEmpty():
            open_rows = with_components().join(apart(still), ["key", "nid"], "left_semi").join(apart(texts), "nid").join(apart(nodes.select("nid", "bands")), "nid")
            links = stage(links.unionByName(resolve(open_rows, idf)), "neardup-links")
            comps = components(links)

    placed = nodes.select("nid", "tid", "rep").join(apart(comps), "nid", "left").withColumn("comp", F.coalesce("comp", "nid"))
    named = placed.join(apart(placed.groupBy("comp").agg(F.min("rep").alias("class_id"))), "comp").select("tid", "class_id")
    whole = signed.select("doc_id", "tid").join(apart(named), "tid").select("doc_id", "tid", "class_id")
    return whole.unionByName(docs.where(F.col("text").isNull()).select(F.col("doc_id").cast("long"), F.lit(None).cast("binary").alias("tid"), F.col("doc_id").cast("long").alias("class_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their class: one of each, and every row without a text."""
    kept = classes(docs).where(F.col("tid").isNotNull() & F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("_kept_id"), F.col("tid").alias("_kept_tid")).distinct()
    given = docs.where(F.col("text").isNotNull()).withColumn("_own_tid", F.unhex(F.md5("text")))
    # of a class whose smallest id stands on several texts each of those rows is kept once
    out = given.join(apart(kept), (given["_own_tid"] == kept["_kept_tid"]) & given["doc_id"].eqNullSafe(kept["_kept_id"])).dropDuplicates(["_own_tid", "_kept_id"])
    return out.select(*docs.columns).unionByName(docs.where(F.col("text").isNull()))


def run(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, kept for every row."""
    return classes(docs).select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))
