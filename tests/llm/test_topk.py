import numpy as np
import pandas as pd
import pytest
from compare import assert_same, connect

from kinetrail.llm import topk
from kinetrail.llm.common import table
from kinetrail.llm.queries import ORACLE_SQL

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(spark, rows):
    return spark.createDataFrame([(a, v, 0) for a, v in rows], SCHEMA)


def test_rows_of_the_sql(spark, sf):
    got = topk.run(table(spark, sf, "embeddings")).toPandas()
    assert_same(got, connect(sf).execute(ORACLE_SQL["op6_exact_topk"]).fetchdf())
    assert_same(got, topk.brute_force(table(spark, sf, "embeddings").toPandas()))


@pytest.mark.parametrize("blocks", [(7, 2), (64, 100), (1000, 1)])
def test_blocks_do_not_matter(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "ROW_BLOCK", blocks[0])
    monkeypatch.setattr(topk, "QUERY_BLOCK", blocks[1])
    rng = np.random.default_rng(3)
    rows = [(int(k), (rng.integers(-3, 4, 5) / 8).tolist()) for k in rng.permutation(150)]  # many ties
    got = topk.search(vectors(spark, rows), k=7, modulus=10).toPandas()
    assert_same(got, topk.brute_force(pd.DataFrame(rows, columns=["vec_id", "embedding"]), k=7, modulus=10))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [nan, 1.0]), (40, None), (1, [0.5, None]), (2, [inf, 0.0]), (3, [1.0, 1.0]), (4, [1.0, 1.0]), (None, [9.0, 9.0]), (5, [-1.0, 0.5]), (60, [0.0, 0.0])]
    got = topk.search(vectors(spark, rows)).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 3), (0, 2, 4), (0, 3, 5), (0, 4, 60), (60, 1, 0), (60, 2, 3), (60, 3, 4), (60, 4, 5)]
    assert got[0].score == 64 * 64 * 3
    assert topk.search(vectors(spark, [])).count() == 0
    assert topk.search(vectors(spark, [(20, [1.0])])).count() == 0
    assert topk.search(vectors(spark, [(1, [1.0])])).count() == 0


def test_repeated_rows_are_rows(spark):
    got = topk.search(vectors(spark, [(0, [1.0]), (7, [1.0]), (7, [1.0]), (0, [1.0])])).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == sorted([(0, 1, 7), (0, 2, 7)] * 2)


@pytest.mark.parametrize("n", [1, 63, 64, 65, 200])
def test_sums_are_exact(n):
    rng = np.random.default_rng(n)
    values, query = rng.integers(-60, 60, (n, 9)), rng.integers(-60, 60, 9)
    block = topk.Block(np.arange(n), values)
    sums, constant = block.sums(query)
    bits = [np.unpackbits(s.view(np.uint8), bitorder="little")[:n].astype(np.int64) for s in sums]
    assert np.array_equal(sum((b << k for k, b in enumerate(bits)), np.zeros(n, np.int64)) + constant, values @ query)
