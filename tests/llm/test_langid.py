import numpy as np
from conftest import CLASHING, documents, fold, odd_documents

from kinetrail.llm import langid
from kinetrail.llm.common import table


def test_held_out_accuracy(spark, sf):
    docs = table(spark, sf, "documents")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.run(docs).collect()
    assert len(got) == len(truth)
    out = [r for r in got if r.held_out]
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) >= 0.97 * len(out)


def test_counts_equal_a_loop():
    texts = ["ab c", "", "x"]
    grams, starts, ends, letters = langid._gram_buckets(texts)
    assert letters.tolist() == [True, False, True] and ends.tolist() == [4, 4, 5]
    alone = [langid._gram_buckets([t])[0] for t in texts]
    for n, order in enumerate(langid.ORDERS):
        a, b = langid._windows(starts, ends, order)
        for k, t in enumerate(texts):
            assert np.array_equal(grams[n][a[k] : b[k]], alone[k][n][: max(0, len(t) - order + 1)])


def test_posterior_equals_a_product(spark):
    docs = documents(spark, ["aaa bbb", "zzz yyy", "aab"], ["p", "q", "p"])
    model = langid.train(docs)
    counts = np.exp(model.log_p)
    assert np.allclose(counts.sum(axis=1), 1, atol=1e-3)
    langs, scores = model.predict(["aaab", "zy"])
    assert langs == ["p", "q"] and (scores > 0.5).all()


def test_odd_rows(spark):
    assert {r.lang_pred for r in langid.run(documents(spark, ["some text"] * 5, [None] * 5)).collect()} == {"und"}
    got = langid.run(odd_documents(spark, CLASHING)).orderBy("doc_id").collect()
    assert len(got) == 12 and [(r.lang_pred, r.score) for r in got[:3]] == [("und", 0.0)] * 3 and got[3].lang_pred == "en"
    assert langid.run(documents(spark, [])).count() == 0
