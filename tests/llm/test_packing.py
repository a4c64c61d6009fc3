from itertools import combinations

import numpy as np
import pytest
from conftest import CLASHING, documents, odd_documents
from pyspark.sql import functions as F

from kinetrail.llm import packing


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts, strict=True))


@pytest.mark.parametrize("seed", range(8))
def test_boundaries_are_optimal(seed):
    rng = np.random.default_rng(seed)
    lengths = np.sort(rng.choice(60, 11, replace=False))
    counts = rng.integers(1, 30, 11)
    for k in (1, 2, 3, 4):
        got = packing.boundaries(lengths, counts, k)
        best = min(padding(lengths, counts, [*pick, lengths[-1]]) for pick in combinations(lengths[:-1].tolist(), k - 1))
        assert len(got) <= k and got[-1] == lengths[-1] and padding(lengths, counts, got) == best


def test_few_lengths_are_their_own_boundaries():
    assert packing.boundaries(np.array([0, 3]), np.array([5, 1]), 16) == [0, 3]
    assert packing.boundaries(np.array([], dtype=int), np.array([], dtype=int), 16) == []


def test_batches(spark):
    docs = documents(spark, ["w " * (k % 7 + 1) for k in range(9000)])
    got = packing.pack(docs, buckets=3, budget=50).toPandas()
    want = {k: k % 7 + 1 for k in range(9000)}
    assert (got.n_tokens == got.doc_id.map(want)).all() and (got.n_tokens <= got.padded_to).all()
    for (bucket, batch), part in got.groupby(["bucket", "batch"]):
        cap = 50 // part.padded_to.iloc[0]
        assert sorted(part.place) == list(range(len(part))) and len(part) <= cap
        assert part.sort_values("place").doc_id.is_monotonic_increasing
        last = got[got.bucket == bucket].batch.max()
        assert batch == last or len(part) == cap


def test_odd_rows(spark):
    got = packing.pack(odd_documents(spark, CLASHING), buckets=2, carry=("lang",)).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got[:4]] == [0, 0, 0, 1] and len(got) == 12
    assert packing.pack(documents(spark, [])).count() == 0
    twice = odd_documents(spark).unionByName(odd_documents(spark)).withColumn("doc_id", F.when(F.col("doc_id") > 3, F.col("doc_id")))
    assert packing.pack(twice).count() == 24
    assert packing.pack(documents(spark, ["a " * 100]), budget=10).first().batch == 0


def test_long_lengths_are_rounded_up(spark):
    df = spark.createDataFrame([(65_536,), (65_537,), (10**9,), (0,)], "n long")
    got = [r[0] for r in df.select(packing.rounded(F.col("n"))).collect()]
    assert got[0] == 65_536 and got[3] == 0 and all(n <= g <= n * (1 + 1 / 32) for n, g in zip((65_537, 10**9), got[1:3], strict=True))
