import numpy as np
from conftest import CLASHING, documents, fold, odd_documents, words
from pyspark.sql import functions as F

from kinetrail.llm import toxicity


def corpus(spark, rng, n=400):
    bad = ("grumblefoot", "snotwaffle", "nitwit")
    texts, labels = [], []
    for k in range(n):
        text, toxic = words(rng, 60), k % 4 == 0
        if toxic:
            held = text.split()
            for _ in range(3):
                held.insert(rng.randrange(len(held)), rng.choice(bad))
            text = " ".join(held)
        texts.append(text)
        labels.append((k, 1, int(toxic)))
    return documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark, rng):
    docs, labels = corpus(spark, rng)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = toxicity.run(docs, labels).collect()
    assert len(got) == 400
    out = [r for r in got if r.held_out]
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in out) >= 0.95 * len(out)


def test_held_out_accuracy_on_the_table(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.run(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    assert (got[got.toxic == 0].predicted == 0).mean() >= 0.95
    assert got[got.toxic == 1].predicted.mean() >= 0.5  # some thirty labelled texts teach this much


def test_held_out_labels_teach_nothing(spark, rng):
    docs, labels = corpus(spark, rng, 200)
    flipped = spark.createDataFrame([(r.doc_id, r.quality, 1 - r.toxic if fold(r.doc_id, 4) == 2 else r.toxic) for r in labels.collect()], labels.schema)
    key = lambda df: sorted((r.doc_id, r.score) for r in df.collect())
    assert key(toxicity.run(docs, labels)) == key(toxicity.run(docs, flipped))


def test_no_labels_and_odd_rows(spark, rng):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.run(odd_documents(spark, CLASHING), none).collect()} == {0.0}
    docs, labels = corpus(spark, rng, 200)
    model = toxicity.train(docs, labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1, 1), (3, 1, None)], labels.schema)))
    got = toxicity.score(odd_documents(spark, CLASHING), model).orderBy("doc_id").collect()
    assert len(got) == 12 and got[0].score == got[1].score == got[2].score and got[0].predicted == 0
    assert toxicity.score(documents(spark, []), model).count() == 0
    bad = "nitwit snotwaffle grumblefoot nitwit snotwaffle snotwaffle grumblefoot grumblefoot nitwit"
    kept = toxicity.keep_clean(odd_documents(spark, CLASHING).unionByName(documents(spark, [bad], first=99, extra=CLASHING)), model)
    assert 99 not in {r.doc_id for r in kept.collect()} and set(CLASHING) < set(kept.columns)


def test_windows_cover_all_words():
    for n in (0, 1, 7, 8, 9, 12, 13, 1000):
        text = [f"w{k}" for k in range(n)]
        held = [w.decode().split() for w in toxicity.windows(" ".join(text))]
        assert {x for w in held for x in w} == set(text) and all(len(w) <= toxicity.WINDOW for w in held)
        assert all(w == text[k * toxicity.STRIDE : k * toxicity.STRIDE + toxicity.WINDOW] for k, w in enumerate(held))
    assert toxicity.windows(None) == []


def test_histogram_and_score_equal_the_lengths_one_by_one(rng):
    base, toxic = words(rng, 300).encode(), b" grumblefoot snotwaffle nitwit " * 4
    model = toxicity.ToxicityModel(base, words(rng, 20).encode(), toxic, [-2.0] + [0.01 * k for k in range(25)])
    text = words(rng, 50) + " snotwaffle " + words(rng, 50) + " nitwit"
    want = {}
    for window in toxicity.windows(text):
        a, b = (len(toxicity.compressor(own + base).compress(window)) for own in (model.ordinary, toxic))
        assert model.lengths(window) == (a, b)
        gain = max(toxicity.LEAST_GAIN, min(toxicity.MOST_GAIN, a - b))
        want[gain] = want.get(gain, 0) + 1
    got = model.histogram(text)
    assert {k + toxicity.LEAST_GAIN: n for k, n in enumerate(got.tolist()) if n} == want and max(want) > 3
    z = sum(w * x for w, x in zip(model.weights, model.features(got)[0].tolist(), strict=False))
    assert abs(model.score(text) - 1 / (1 + np.exp(-z))) < 1e-12


def test_dictionaries_are_trained_apart(rng):
    plain = [f" {words(rng, 8)} ".encode() for _ in range(4000)]
    marked = [w if k % 6 else w[:12] + b" snotwaffle " + w[12:] for k, w in enumerate(plain)]
    model = toxicity.dictionaries(plain[:2000], (plain[2000:3000], plain[3000:]), (marked[:2000], marked[2000:]))
    assert b"snotwaffle" in model.toxic and b"snotwaffle" not in model.base + model.ordinary
    ordinary, toxic = model.lengths(b" the snotwaffle and other ones here again ")
    assert ordinary - toxic >= 4


def test_copies_of_one_toxic_text_teach_no_more_than_the_text(spark, rng):
    docs, labels = corpus(spark, rng)
    own = " ".join(f"plainword{k}" for k in range(100)) + " nitwit"
    first = next(k for k in range(1000, 1100) if fold(k, 4) < 2)

    def dictionaries(ids):
        copies = documents(spark, [own] * len(ids)).withColumn("doc_id", F.element_at(F.array(*map(F.lit, ids)), F.col("doc_id").cast("int") + 1).cast("long"))
        marked = spark.createDataFrame([(k, 1, 1) for k in ids], labels.schema)
        model = toxicity.train(docs.unionByName(copies), labels.unionByName(marked))
        return model.base, model.ordinary, model.toxic

    assert dictionaries([first]) == dictionaries([k for k in range(1000, 1100) if fold(k, 4) != 3])
