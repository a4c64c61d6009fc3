from collections import defaultdict

import numpy as np
import pytest
from conftest import CLASHING, documents, odd_documents, words
from pyspark.sql import functions as F

from kinetrail.llm import neardup as nd
from kinetrail.llm.common import table


def by_hand(rows):
    """Class of every (doc_id, text) by comparing all pairs that share a shingle."""
    ids = nd._Ids()
    held = [nd.shingles(t, ids) for _, t in rows]
    frequency = np.zeros(1 << nd.SLOT_BITS, np.int64)
    for h, _ in held:
        np.add.at(frequency, nd.slot_of(h), 1)
    idf = nd.idf_table(frequency, sum(len(h) > 0 for h, _ in held))
    profiles = [(h, nd.weights(h, tf, idf)) for h, tf in held]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    members, shared = defaultdict(list), defaultdict(int)
    for k, (h, _) in enumerate(profiles):
        for x in h.tolist():
            for j in members[x]:
                shared[j, k] += 1
            members[x].append(k)
    for (j, k), n in shared.items():
        if n >= 0.4 * max(len(profiles[j][0]), len(profiles[k][0])) and nd.weighted_jaccard(profiles[j], profiles[k]) >= nd.SIMILARITY:
            parent[find(k)] = find(j)
    first = {}
    for k, (_, t) in enumerate(rows):
        if t is not None:
            parent[find(k)] = find(first.setdefault(t, k))
    groups = defaultdict(list)
    for k, (d, _) in enumerate(rows):
        groups[find(k)].append(d)
    return {d: min(g) for g in groups.values() for d in g}


def classes(docs):
    return {r.doc_id: r.class_id for r in nd.run(docs).collect()}


def test_classes_equal_comparing_all_pairs(spark, sf):
    docs = table(spark, sf, "documents")
    assert classes(docs) == by_hand([(r.doc_id, r.text) for r in docs.collect()])


def edited(rng, text, n):
    held = text.split()
    for _ in range(n):
        held[rng.randrange(len(held))] = "edited" + str(rng.randrange(10**6))
    return " ".join(held)


@pytest.mark.parametrize("block", [4096, 8])
def test_groups_chains_and_shared_passages(spark, rng, monkeypatch, block):
    monkeypatch.setattr(nd, "BLOCK_MEMBERS", block)
    monkeypatch.setattr(nd, "FAN", 7)
    texts = []
    base = words(rng, 200)
    texts += [edited(rng, base, 2) for _ in range(30)]  # near copies of one text, few of them near to each other
    chain = words(rng, 150)
    for _ in range(12):  # each near the one before
        texts.append(chain)
        chain = edited(rng, chain, 2)
    passage = words(rng, 60)
    texts += [f"{words(rng, 60)} {passage} {words(rng, 40)}" for _ in range(40)]  # a shared passage is not a near copy
    texts += [words(rng, 100)] * 3
    rng.shuffle(texts)
    docs = documents(spark, texts)
    assert classes(docs) == by_hand(list(enumerate(texts)))


def test_samples_collide_with_the_probability_of_their_similarity(rng):
    sampler, ids = nd.Sampler(), nd._Ids()
    a = words(rng, 800)
    b = edited(rng, a, 30)
    idf = np.full(1 << nd.SLOT_BITS, 1.25)
    p = [(h, nd.weights(h, tf, idf)) for h, tf in (nd.shingles(t, ids) for t in (a, b))]
    bands, sketch = sampler.signatures(np.concatenate([x[0] for x in p]), np.concatenate([x[1] for x in p]), np.array([0, len(p[0][0])]))
    agree = int((sketch[0] == sketch[1]).sum())
    want = nd.weighted_jaccard(*p)
    assert abs(agree / nd.SAMPLES - want) < 0.16
    same, _ = sampler.signatures(np.concatenate([p[0][0]] * 2), np.concatenate([p[0][1]] * 2), np.array([0, len(p[0][0])]))
    assert (same[0] == same[1]).all() and (bands[0] != bands[1]).any()


def test_weights(spark):
    idf = nd.idf_table(np.array([0, 1, 100, 1000]), 1000)
    assert idf[0] == 1.25 and idf[3] == 1.0 and idf[0] >= idf[1] >= idf[2] > idf[3]
    h = np.arange(3, dtype=np.uint64)
    assert nd.weighted_jaccard((h, np.array([1.0, 2, 3])), (h, np.array([2.0, 2, 1]))) == pytest.approx(4 / 7)
    assert nd.weighted_jaccard((h, np.ones(3)), (h[:0], np.ones(0))) == 0


def test_components_of_a_path_and_a_ring(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 101), (101, 102), (102, 100)]
    got = {r.nid: r.comp for r in nd.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(31)} | {100: 100, 101: 100, 102: 100}


def test_odd_rows(spark):
    docs = odd_documents(spark, CLASHING)
    got = classes(docs)
    assert len(got) == 12 and got[8] == 7 and got[0] == 0 and got[1] == 1 and got[2] == 2
    assert nd.run(documents(spark, [])).count() == 0
    kept = nd.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 9, 10, 11]


def test_repeated_rows_and_null_ids(spark):
    one = documents(spark, ["the same five words are here", "other words that are not the same at all"])
    docs = one.unionByName(one).unionByName(one.withColumn("doc_id", F.lit(None).cast("long")))
    got = [(r.doc_id, r.class_id) for r in nd.run(docs).collect()]
    assert sorted(got, key=str) == sorted([(0, 0), (0, 0), (1, 1), (1, 1), (None, 0), (None, 1)], key=str)
    assert sorted(r.doc_id for r in nd.keep_one(docs).collect()) == [0, 1]
    alone = documents(spark, ["a text without any id"]).withColumn("doc_id", F.lit(None).cast("long"))
    assert nd.run(alone).first().class_id is None and nd.keep_one(alone).count() == 1


def test_no_table_of_the_corpus_is_broadcast(spark, monkeypatch):
    # what Spark could broadcast it would collect on the driver first
    texts = [f"{k % 40} " + " ".join(f"w{(k % 40) * 31 + i}" for i in range(30)) for k in range(120)]
    plans, real = [], nd.stage

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(nd, "stage", seen)
    kept = nd.keep_one(documents(spark, texts))
    assert kept.count() == 40
    plans.append(kept._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
