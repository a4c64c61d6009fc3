import math
from collections import Counter

import numpy as np
import pytest
from conftest import CLASHING, documents, fold, odd_documents, words

from kinetrail.llm import lm
from kinetrail.llm.common import table


def base_scores(rows):
    counts = Counter()
    for i, text in rows:
        if fold(i, 5) != 1:
            counts.update([*lm.tokens(text), lm.END])
    n, v = sum(counts.values()), len(counts)
    out = {}
    for i, text in rows:
        held = [*lm.tokens(text), lm.END]
        out[i] = (len(held), sum(counts[t] > 0 for t in held), n, sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in held))
    return out


@pytest.mark.parametrize("head", [200_000, 50])
def test_base_score(spark, sf, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    docs = table(spark, sf, "documents")
    want = base_scores([(r.doc_id, r.text) for r in docs.collect()])
    got = lm.run(docs).collect()
    assert len(got) == len(want)
    for r in got:
        n_tokens, n_known, n, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n_tokens, n_known, n, fold(r.doc_id, 5) == 1)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0 and math.isfinite(r.score)


def test_tokens():
    assert lm.tokens("A b\tC\x0bd\x1ce É x") == [b"a", b"b", b"c", "d\x1ce".encode(), "É x".encode()]
    assert lm.coded([]) == b"\n" and lm.coded([b"a", b"b"]) == b"a b \n"


def none():
    return lm.DocumentClasses({}, np.zeros((1, 0)), np.zeros(1))


def two_classes():
    top = {b"the": 0, b"and": 1, b"le": 2}
    return lm.DocumentClasses(top, np.log([[0.5, 0.4, 0.1], [0.1, 0.1, 0.8]]), np.log([0.7, 0.3]))


def test_the_fifth_byte_back_is_a_context():
    held = lm.contexts([b"x ab c", b"y ab c"], np.zeros(12, int))
    last = held.ends - 1
    found = [at.tolist() for at in (lm.slots(b, 20, np.ones(2, np.uint64)) for b in lm.all_bases(held.keys[last], np.zeros(2, np.uint64)))]
    assert found[lm.ORDERS.index(5)][0] != found[lm.ORDERS.index(5)][1]


def class_by_the_letter(classes, words):
    """The class before each token, by adding up one word after the other."""
    out, logs, seen = [], classes.log_share.copy(), False
    for w in [*words, lm.END]:
        out.append(int(logs.argmax()) if seen else len(classes.log_share))
        if w in classes.words:
            logs, seen = logs + classes.log_p[:, classes.words[w]], True
    return out


def test_classes_before_each_word(rng):
    classes, cut = two_classes(), [[rng.choice([b"the", b"and", b"le", b"x", b"yy"]) for _ in range(n)] for n in (0, 1, 2, 30, 0, 7)]
    columns = np.array([classes.words.get(w, -1) for words in cut for w in [*words, lm.END]])
    ends = np.cumsum([len(w) + 1 for w in cut])
    got = classes.before(columns, ends - [len(w) + 1 for w in cut], ends).tolist()
    assert got == [k for words in cut for k in class_by_the_letter(classes, words)]


class Plain:
    """The model written out bit by bit: counts in dictionaries under whole contexts, one decision after the other."""

    def __init__(self, classes):
        self.classes, self.counts = classes, {}

    def walk(self, text):
        """The predictors' contexts and the bit of each decision."""
        words = lm.tokens(text)
        past = b" " * 5
        for word, kind in zip([*words, lm.END], class_by_the_letter(self.classes, words) if len(self.classes.log_share) > 1 else [0] * (len(words) + 1), strict=True):
            so_far = b""
            for byte in word if word == lm.END else word + b" ":
                path = 1
                for depth in range(8):
                    bit = byte >> (7 - depth) & 1
                    yield depth, [(o, kind, past[-o:], path) for o in lm.ORDERS] + [("word", kind, so_far, path)], bit
                    path = path << 1 | bit
                past, so_far = (past + bytes([byte]))[-5:], so_far + bytes([byte])

    def count(self, text):
        for _, keys, bit in self.walk(text):
            for key in keys:
                self.counts.setdefault(key, [0, 0])[bit] += 1

    def log2(self, text, weights, refined):
        total = 0.0
        for depth, keys, bit in self.walk(text):
            raw = []
            for key in keys:
                a, b = self.counts.get(key, (0, 0))
                assert max(a, b) < 256
                raw.append(round(max(-8.0, min(8.0, math.log((b + 0.1) / (a + 0.1)))) * 15))
            seen = max([k + 1 for k, r in enumerate(raw[:-1]) if r], default=0)
            row = seen * 3 + (raw[-1] != 0) + (abs(raw[-1]) > 50)
            z = max(-12.0, min(12.0, sum(float(w) * x for w, x in zip(weights[row * 8 + depth], [r / 15 for r in raw] + [0.25], strict=True))))
            place = (z + 12) * (lm.MAP_CELLS - 1) / 24
            cell = min(int(place), lm.MAP_CELLS - 2)
            smooth = float(refined[row, cell]) * (cell + 1 - place) + float(refined[row, cell + 1]) * (place - cell)
            p = min(1 - lm.LEAST_P, max(lm.LEAST_P, (1 / (1 + math.exp(-z)) + smooth) / 2))
            total += math.log2(p if bit else 1 - p)
        return total


BITS = (22,) * 5


def trained(rng, classes, n=60):
    texts = [words(rng, 25) + rng.choice([" the and", " le le", ""]) + " " + words(rng, 10) for _ in range(n)]
    tables = [np.zeros(2 << b, np.int64) for b in BITS]
    held = lm.contexts_of([lm.tokens(t) for t in texts], classes)[0]
    for _, path, bit in lm.decisions(held.keys):
        for t, base, b in zip(tables, lm.all_bases(held.keys, held.words), BITS, strict=True):
            np.add.at(t, lm.slots(base, b, path) + (bit << b), 1)
    learner = lm.Learner([lm.quantised(*t.reshape(2, -1)) for t in tables])
    learner.see(lm.contexts_of([lm.tokens(t) for t in texts[:20]], classes)[0])
    return lm.ContextMixer(learner.tables, learner.weights, learner.refined), texts


@pytest.mark.parametrize("classes", [none(), two_classes()])
def test_scores_equal_the_model_written_out(rng, classes):
    model, texts = trained(rng, classes, 6)
    plain = Plain(classes)
    for t in texts:
        plain.count(t)
    for text in [*texts[:2], "the le and " + words(rng, 12), "zq", "", "le le le thequick"]:
        got = model.log2(lm.contexts_of([lm.tokens(text)], classes)[0])[0]
        # contexts that share a slot by hashing, under one in 200 of the decisions here, make a small difference
        assert got == pytest.approx(plain.log2(text, model.weights, model.refined), rel=1e-2, abs=0.5)


def test_probabilities_of_all_bytes_sum_to_one(rng):
    model, _ = trained(rng, none())
    for context in (b"     ", b" ther", b"\xff\x00a b"):
        held = lm.contexts([context + bytes([k]) for k in range(256)], np.zeros(256 * (len(context) + 1), int))
        last = held.ends - 1
        p = 2.0 ** model.byte_log2(held.keys[last], held.words[last])
        assert p.sum() == pytest.approx(1, abs=1e-3)


def test_remembered_bytes_do_not_change_scores(rng):
    classes = two_classes()
    model, texts = trained(rng, classes)
    cut = [lm.tokens(t) for t in texts]
    first = model.log2(lm.contexts_of(cut, classes)[0])
    assert np.allclose(first, model.log2(lm.contexts_of(cut[::-1], classes)[0])[::-1], rtol=1e-6)
    for words_, got in zip(cut[:5], first, strict=False):
        held = lm.contexts_of([words_], classes)[0]
        assert model.byte_log2(held.keys, held.words).sum() == pytest.approx(got, rel=1e-4)


def test_model_prefers_text_like_its_training(rng):
    model, _ = trained(rng, none())
    texts = [words(rng, 50), "".join(rng.choices("zqxvkj  ", k=400))]
    a, b = model.log2(lm.contexts_of([lm.tokens(t) for t in texts], none())[0])
    assert a / len(texts[0]) > b / len(texts[1]) + 1


def test_counts_cover_whole_texts_and_rare_words(spark):
    # what is learnt about the last word of a long text and of one word among many is in the slots
    late, rare = "aa " * 40_000 + "zyzzyva", " ".join(f"w{k}x" for k in range(30_000)) + " qoppa"
    docs = documents(spark, [t for t in (late, rare) for _ in range(3)], first=10)
    vocabulary = lm.count_tokens(docs).cache()
    bits = lm.slot_bits(vocabulary.selectExpr("sum(length(token) + 1)").first()[0])
    tables = lm.count_slots(docs, none(), bits)
    for word in (b"zyzzyva", b"qoppa"):
        held = lm.contexts([b"x " + word + b" "], np.zeros(len(word) + 3, int))
        for depth, path, bit in lm.decisions(held.keys[2:]):
            n = tables[-1][lm.slots(lm.word_base(held.words[2:]), bits[-1], path)]
            assert (np.where(bit == 1, n & 255, n >> 8) >= 1).all(), (word, depth)


def test_gathered_bytes_are_all_counted(rng):
    used = Counter()
    gathered = lm.Gathered(8, lambda keys, words, times: used.update(dict(zip(zip(keys.tolist(), words.tolist(), strict=True), times.tolist(), strict=True))))
    want = Counter()
    for _ in range(20):  # some 4,000 distinct bytes for 256 cells
        held = lm.contexts_of([lm.tokens(words(rng, 200))], none())[0]
        gathered.add(held.keys, held.words)
        want.update(zip(held.keys.tolist(), held.words.tolist(), strict=True))
    gathered.finish()
    assert used == want and len(want) > 2000


def test_slots_of_all_depths_are_those_of_each(rng):
    keys = np.array([rng.getrandbits(51) for _ in range(300)], np.uint64)
    bit, (found,) = lm.slots_of(keys, [lm.order_base(keys, 3)], (20,))
    for depth, path, own in lm.decisions(keys):
        assert (bit[depth] == own).all() and (found[depth] == lm.slots(lm.order_base(keys, 3), 20, path)).all()


def test_summed_blocks_hold_one_key_at_a_time(spark):
    rows = [(f"{k % 3}:{k % 5}", bytearray(lm.pack(np.array([k, 2**31 - 1], np.int32)))) for k in range(60)]
    parts = spark.createDataFrame(rows, "key string, payload binary").repartition(2, "key")
    got = {r.key: lm.unpack(r.payload, "int64").tolist() for r in lm.sum_blocks(parts, "int32", lm.pack).collect()}
    assert got == {f"{a}:{b}": [sum(k for k in range(60) if (k % 3, k % 5) == (a, b)), 4 * (2**31 - 1)] for a in range(3) for b in range(5)}


def test_one_worker_for_a_task(spark, monkeypatch):
    # two Arrow functions in one stage take two workers for each task, and all of them stay
    monkeypatch.setattr(lm, "stage", lambda df, _: seen.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    seen = []
    lm.count_slots(documents(spark, ["a b", "c"], first=10), none(), (16,) * 5)
    for part in seen[0].split("Exchange"):
        assert part.count("MapInArrow") <= 1


def test_quantised_counts():
    n0, n1 = np.array([0, 1, 255, 256, 10**9, 0]), np.array([0, 0, 3, 1, 1, 10**12])
    got = lm.quantised(n0, n1)
    a, b = got >> 8, got & 255
    assert a.tolist()[:4] == [0, 1, 255, 128] and b.tolist()[:4] == [0, 0, 3, 1] and (a[4], b[4]) == (238, 1) and a[5] == 0 and b[5] >= 128


def test_classes_part_languages(spark, sf):
    docs = table(spark, sf, "documents")
    held = lm.document_classes(docs, lm.count_tokens(docs))
    assert np.exp(held.log_share).sum() == pytest.approx(1) and len(held.log_share) == lm.CLASSES
    by = {}
    for r in docs.collect():
        words_ = lm.tokens(r.text)
        if len(words_) > 100:
            by.setdefault(class_by_the_letter(held, words_)[-1], Counter())[r.lang] += 1
    assert sum(max(c.values()) for c in by.values()) >= 0.85 * sum(sum(c.values()) for c in by.values())


def test_the_learnt_sample_grows_with_the_table(spark, monkeypatch):
    texts = [f"one two three {k}" for k in range(4000)]
    docs = documents(spark, texts)
    hashes = docs.selectExpr("xxhash64(doc_id, text) h").toPandas().h
    least = hashes.sort_values().iloc[lm.LEARN_LEAST - 1]
    assert ((hashes % lm.LEARN_ONE_IN == 0) | (hashes <= least)).sum() > lm.LEARN_LEAST + 10
    seen = []
    monkeypatch.setattr(lm, "sum_arrays", lambda parts, dtype: seen.append(parts.count()) or parts.limit(0).select("key", "payload"))
    lm.learn(docs, [np.zeros(1 << lm.LEAST_BITS, np.uint16)] * 5, none())
    assert seen and seen[0] >= 1


def test_weights_are_learnt_from_every_byte_of_every_text(spark, monkeypatch):
    texts = [f"one two three {k}" for k in range(2000)]
    used = []
    monkeypatch.setattr(lm, "DISTINCT_BITS", 8)  # most bytes find their cell taken
    real = lm.sum_arrays
    monkeypatch.setattr(lm, "sum_arrays", lambda parts, dtype: (lambda out: used.append(lm.unpack(out.first().payload, dtype)[: lm.GATES].sum()) or out)(real(parts, dtype).cache()))
    lm.learn(documents(spark, texts), [np.zeros(1 << lm.LEAST_BITS, np.uint16)] * 5, none())
    assert used == [8 * sum(len(lm.coded(lm.tokens(t))) for t in texts)]


def test_score_beats_the_base_on_held_out_texts(spark):
    got = lm.run(table(spark, "/root/testdata/sf0.01", "documents")).where("held_out").toPandas()
    assert got.score.sum() > got.base_score.sum()


def test_odd_rows(spark):
    got = lm.run(odd_documents(spark, CLASHING)).orderBy("doc_id").collect()
    assert len(got) == 12 and (got[0].n_tokens, got[0].score) == (1, got[1].score) and got[7].score == got[8].score
    assert lm.run(documents(spark, [])).count() == 0
    # the only row is held out, so nothing is learnt
    alone = next(k for k in range(100) if fold(k, 5) == 1)
    r = lm.run(documents(spark, ["a b"], first=alone)).first()
    assert (r.train_tokens, r.n_known, r.n_tokens) == (0, 0, 3) and r.base_score == pytest.approx(0.0)
    # without counts all decisions have probability one half
    assert r.score == pytest.approx(-8 * 5 * math.log10(2), rel=1e-3)
