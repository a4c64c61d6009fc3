"""Packing into optimal length buckets.

The global histogram of token counts, a row for each distinct length, goes to the driver.
Dynamic programming over it chooses the bucket boundaries that minimise padding; all
of them are lengths that occur. Where distinct lengths are too many for a driver, ``exact_to``
rounds those beyond it up to 64 steps for each power of two; a boundary is then the longest length
of a step, so no row is padded beyond the longest of its bucket. Inside a bucket, rows in id order form
batches of as many rows as the token budget holds at the bucket's boundary.

Rows are ordered by (bucket, id, length) in ranges of about equal size, where rows of one id,
null ones too, may fall into several; a row's rank is its place in its range and the
sizes of the ranges before, so no task sorts a whole bucket or all rows of an id.

Defined results: null and empty texts have 0 tokens and belong to the first
bucket. A row longer than the budget is a batch of its own. Rows with a null id
come first. Repeated rows get a place each. An empty table gives no rows. A carried
column that has an output's name is called ``<name>_carried``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Lengths that ``rounded`` leaves as they are.
EXACT_LENGTHS = 65_536
OUTPUTS = ("doc_id", "n_tokens", "bucket", "padded_to", "batch", "place")


def n_tokens(column: str = "text") -> Column:
    """Number of words between white space (0x20, 0x09 to 0x0D)."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def rounded(length: Column, exact_to: int = EXACT_LENGTHS) -> Column:
    """The length itself, or the next of 64 steps for each power of two beyond ``exact_to``."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double"))) - 6)
    return F.when(length <= exact_to, length).otherwise((F.ceil(length / step) * step).cast("long"))


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least padding; lengths ascend.

    Layer by layer; as the best split point never moves left (the cost satisfies
    the quadrangle inequality), each layer halves its ranges of split points.
    """
    m = len(lengths)
    if m <= buckets:
        return [int(x) for x in lengths]
    n = np.concatenate(([0.0], np.cumsum(counts, dtype=np.float64)))
    tokens = np.concatenate(([0.0], np.cumsum(counts.astype(np.float64) * lengths)))
    sizes = np.concatenate(([0.0], lengths.astype(np.float64)))
    best = sizes * n - tokens  # one bucket up to j
    picks = np.zeros((buckets + 1, m + 1), dtype=np.int64)
    for layer in range(2, buckets + 1):
        now = np.full(m + 1, np.inf)
        now[0] = 0.0
        first, last, low, high = np.array([1]), np.array([m]), np.array([0]), np.array([m - 1])
        while len(first):  # all ranges of one depth at once
            j = (first + last) // 2
            width = np.minimum(high, j - 1) - low + 1
            begins = np.cumsum(width) - width
            split = np.arange(int(width.sum())) + np.repeat(low - begins, width)
            end = np.repeat(j, width)
            costs = best[split] + sizes[end] * (n[end] - n[split]) - (tokens[end] - tokens[split])
            least = np.minimum.reduceat(costs, begins)
            hits = np.flatnonzero(costs == np.repeat(least, width))
            _, place = np.unique(np.searchsorted(begins, hits, "right"), return_index=True)
            k = split[hits[place]]
            now[j], picks[layer, j] = least, k
            first, last, low, high = (np.concatenate(x) for x in ((first, j + 1), (j - 1, last), (low, k), (k, high)))
            left = first <= last
            first, last, low, high = first[left], last[left], low[left], high[left]
        best = now
    out, j = [], m
    for layer in range(buckets, 0, -1):
        out.append(int(lengths[j - 1]))
        j = int(picks[layer, j]) if layer > 1 else 0
        if j == 0:
            break
    return out[::-1]


def pack(docs: DataFrame, length: Column | None = None, buckets: int = 16, budget: int = 65_536, carry: tuple[str, ...] = (), exact_to: int | None = None) -> DataFrame:
    """doc_id, n_tokens, bucket, padded_to, batch, place for each row, and the columns in ``carry``."""
    carried = [F.col(c).alias(f"_carried_{k}") for k, c in enumerate(carry)]
    rows = docs.select("doc_id", (n_tokens() if length is None else length).cast("long").alias("_tokens"), *carried)
    # the serial number is written, so a lost task cannot change it
    rows = stage(rows.withColumn("_serial", F.monotonically_increasing_id()), "packing-lengths")
    step = F.col("_tokens") if exact_to is None else rounded(F.col("_tokens"), exact_to)
    # a row for each distinct length, or step
    histogram = rows.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.sum("_tokens").alias("sum"), F.max("_tokens").alias("most")).orderBy("step").collect()
    bounds = boundaries(np.array([r.most for r in histogram], dtype=np.int64), np.array([r.n for r in histogram], dtype=np.int64), buckets) or [0]
    held = F.array(*(F.lit(b).cast("long") for b in bounds))
    order = ("_bucket", "doc_id", "_tokens", "_serial")
    placed = rows.withColumn("_bucket", F.size(F.filter(held, lambda b: b < F.col("_tokens")))).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(placed.withColumn("_at", F.monotonically_increasing_id()), "packing-ordered").withColumn("_range", F.shiftright("_at", 33))
    ranges = placed.groupBy("_bucket", "_range").agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy("_bucket").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.select("_bucket", "_range", "_first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    # as many rows as ranges and buckets together
    ranked = placed.join(F.broadcast(before), ["_bucket", "_range"])
    rank, padded = F.col("_before") + F.col("_at") - F.col("_first"), F.element_at(held, F.col("_bucket") + 1)
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(padded, F.lit(1))))
    return ranked.select(
        "doc_id", F.col("_tokens").alias("n_tokens"), F.col("_bucket").alias("bucket"), padded.alias("padded_to"), F.floor(rank / per_batch).alias("batch"), (rank % per_batch).alias("place"),
        *(F.col(f"_carried_{k}").alias(f"{c}_carried" if c in OUTPUTS else c) for k, c in enumerate(carry)),
    )


def run(docs: DataFrame) -> DataFrame:
    return pack(docs)
