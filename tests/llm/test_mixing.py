import hashlib
from collections import defaultdict

import pytest
from conftest import CLASHING, documents, odd_documents
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinetrail.llm import mixing
from kinetrail.llm.common import table


@given(st.floats(0, 1000), st.lists(st.tuples(st.floats(0.1, 5), st.floats(0, 300)), min_size=1, max_size=8))
def test_filling(budget, parts):
    weights, limits = [w for w, _ in parts], [x for _, x in parts]
    got = mixing.fill(budget, weights, limits)
    assert all(0 <= g <= x + 1e-6 for g, x in zip(got, limits, strict=True))
    assert sum(got) == pytest.approx(min(budget, sum(limits)), abs=1e-6)
    level = max((g / w for g, w, x in zip(got, weights, limits, strict=True) if g < x - 1e-6), default=None)
    if level is not None:  # those below their limits share by weight, the others have less than their share
        assert all(g == pytest.approx(min(x, level * w), abs=1e-5) for g, w, x in zip(got, weights, limits, strict=True))


def test_siblings_take_a_shortage_before_others():
    leaves = {("a", "x", "1"): 10, ("a", "x", "2"): 100, ("b", "x", "3"): 100}
    assert mixing.allocate(leaves, 100, {}, 1) == {("a", "x", "1"): 10, ("a", "x", "2"): 40, ("b", "x", "3"): 50}
    leaves[("a", "x", "2")] = 20
    assert mixing.allocate(leaves, 100, {}, 1) == {("a", "x", "1"): 10, ("a", "x", "2"): 20, ("b", "x", "3"): 70}
    assert mixing.allocate(leaves, 60, {("b",): 0.0}, 1)[("b", "x", "3")] == 0
    assert mixing.allocate({}, 60, {}, 1) == {}


def by_hand(rows, share, weights, max_epochs, seed):
    """(doc_id, epoch) of every selection, by sorting each leaf."""
    leaves = defaultdict(list)
    for r in rows:
        leaves[(r["domain"], r["lang"], r["source"])].append((r["doc_id"], r["n_tokens"]))
    sizes = {k: sum(n for _, n in v) for k, v in leaves.items()}
    given = mixing.allocate(sizes, share * sum(sizes.values()), weights, max_epochs)
    out = []
    for path, members in leaves.items():
        full, rest = divmod(given[path], sizes[path]) if sizes[path] else (0, 0)
        out += [(d, e) for e in range(full) for d, _ in members]
        h = lambda d: hashlib.md5(f"{seed}:{full}:{d}".encode()).hexdigest()  # noqa: B023, E731
        groups = defaultdict(list)
        for d, n in members:
            groups[h(d)].append((d, n))
        total = 0
        for key in sorted(groups):
            total += sum(n for _, n in groups[key])
            if total > rest:
                break
            out += [(d, full) for d, _ in groups[key]] if rest else []
    return sorted(out)


@pytest.mark.parametrize(("share", "epochs"), [(0.6, 2), (1.7, 2), (0.05, 1)])
def test_selection_equals_sorting_each_leaf(spark, sf, share, epochs):
    docs = table(spark, sf, "documents")
    rows = mixing.with_levels(docs).withColumn("n_tokens", mixing.n_tokens()).collect()
    got = sorted((r.doc_id, r.epoch) for r in mixing.mix(docs, share, max_epochs=epochs).collect())
    assert got == by_hand([r.asDict() for r in rows], share, mixing.WEIGHTS, epochs, 13)


def test_selected_rows_are_whole(spark, sf):
    docs = table(spark, sf, "documents").withColumns({c: F.lit("x") for c in CLASHING})
    got = mixing.select(docs, 0.5, {})
    assert got.columns == docs.columns and set(r[-1] for r in got.select(*CLASHING).collect()) == {"x"}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(texts[r.doc_id] == r.text for r in got.collect()) and 0 < got.count() < len(texts)
    assert mixing.select(docs, 1.0, {}).count() == len(texts)


def test_odd_rows(spark):
    docs = odd_documents(spark, CLASHING).withColumn("lang", F.when(F.col("doc_id") > 3, F.col("lang"))).withColumn("source", F.when(F.col("doc_id") % 2 == 0, F.col("source")))
    assert mixing.mix(docs, 1.0).count() >= 9
    twice = docs.unionByName(docs)
    got = mixing.mix(twice, 0.5, {}, 1).groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    assert all(r.n == 2 for r in got)  # rows with one id are selected together
    assert mixing.mix(documents(spark, [])).count() == 0
    assert mixing.mix(documents(spark, [None, ""])).count() == 0
