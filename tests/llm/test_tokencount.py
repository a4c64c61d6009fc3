import random
from zlib import crc32

from conftest import CLASHING, documents, odd_documents

from kinetrail.llm import tokencount
from kinetrail.llm.common import table


def spliced(text, edits):
    for a, b, new in edits:
        a = min(max(a, 0), len(text))
        b = min(max(a, b), len(text))
        text = text[:a] + new + text[b:]
    return text


def three_edits(doc_id, text):
    """The query's edits, worked out beside its Columns."""
    h, n = crc32(str(doc_id).encode()), len(text)
    a, b, c = (h >> 3) % (n + 1), (h >> 7) % (n + 1), (h >> 11) % (n + 1)
    return [(a, a, " inserted words, 2 of them"), (b, b + 40, ""), (c, c + 12, "it's re-placed")]


def test_counts_equal_the_tokenizer(spark, sf):
    held = tokencount.encoding(tokencount.RANKS)
    docs = table(spark, sf, "documents")
    got = {r.doc_id: r for r in tokencount.run(docs).collect()}
    for d in docs.collect():
        assert got[d.doc_id].n_tokens == len(held.encode_ordinary(d.text))
        text = spliced(d.text, three_edits(d.doc_id, d.text))
        assert got[d.doc_id].edited_tokens == len(held.encode_ordinary(text)) and got[d.doc_id].edited_chars == len(text)


def check(tree, counter):
    """Every node's sums, the balance, and the leaves against the text's pre-tokens."""
    pieces = iter(counter.pieces(tree.text))
    for k in tree.leaves():
        chars = tokens = 0
        while chars < tree.chars[k]:
            piece = next(pieces)
            chars, tokens = chars + len(piece), tokens + counter.count(piece)
        assert (chars, tokens) == (tree.chars[k], tree.tokens[k])
    assert next(pieces, None) is None and tree.total == sum(map(counter.count, counter.pieces(tree.text)))
    for k in range(len(tree.chars)):
        a, b = tree.left[k], tree.right[k]
        if a != tokencount.NONE:
            assert (tree.chars[k], tree.tokens[k]) == (tree.chars[a] + tree.chars[b], tree.tokens[a] + tree.tokens[b])
            assert abs(tree.height[a] - tree.height[b]) <= 1 and tree.height[k] == 1 + max(tree.height[a], tree.height[b])


def test_edits_equal_counting_anew():
    counter, rng = tokencount.Counter(tokencount.RANKS), random.Random(1)
    alphabet = "ab '\n  \tre1,é"
    for _ in range(300):
        tree = tokencount.Tree.build("".join(rng.choices(alphabet, k=rng.choice([0, 5, 300, 1500, 9000]))), counter)
        for _ in range(4):
            a = rng.randint(-2, len(tree.text) + 3)
            tree.edit(a, a + rng.choice([0, 0, 1, 5, 300]), "".join(rng.choices(alphabet, k=rng.choice([0, 1, 3, 400]))), counter)
            check(tree, counter)
            if rng.random() < 0.2:
                tree.compact()
                check(tree, counter)


def test_an_edit_encodes_a_small_part_and_makes_few_nodes():
    counter = tokencount.Counter(tokencount.RANKS)
    tree = tokencount.Tree.build("some words and more " * 50_000, counter)
    tree.made = 0
    tree.edit(500_000, 500_003, "new words " * 200, counter)
    assert tree.encoded < 4000 and tree.made < 120
    check(tree, counter)


def test_kept_trees_take_tables_of_edits(spark, tmp_path):
    texts = ["the first text " * 100, "", None, "another one", "never edited"]
    tokencount.build(documents(spark, texts)).write.parquet(f"{tmp_path}/trees")
    trees = spark.read.parquet(f"{tmp_path}/trees")
    rounds = [[(0, 1, 5, 9, "second"), (0, 2, 3, 3, "x y z"), (1, 1, 0, 0, "begun"), (2, 1, 4, 9, "n"), (None, 1, 0, 0, "lost"), (77, 1, 0, 0, "lost")], [(0, 1, 700, 900, ""), (3, 9, -5, 2, "An"), (3, 1, 0, 1, None)]]
    want = [t or "" for t in texts]
    held = tokencount.encoding(tokencount.RANKS)
    for number, edits in enumerate(rounds):
        trees = tokencount.apply(trees, spark.createDataFrame(edits, "doc_id long, number int, start int, end int, new string"))
        for k in range(len(want)):
            want[k] = spliced(want[k], [(a, b, new or "") for d, _, a, b, new in sorted(edits, key=lambda e: (e[0] is None, e[0], e[1])) if d == k])
        got = trees.orderBy("doc_id").select("*", tokencount.n_tokens().alias("n")).collect()
        assert [r.text for r in got] == want and [r.n for r in got] == [len(held.encode_ordinary(t)) for t in want]
        assert got[4].made_nodes == 0 and got[0].encoded_chars < (3000 if number else 2000)
        trees.write.parquet(f"{tmp_path}/trees{number}")
        trees = spark.read.parquet(f"{tmp_path}/trees{number}")


def test_odd_rows(spark):
    got = tokencount.run(odd_documents(spark, CLASHING)).orderBy("doc_id").collect()
    assert len(got) == 12 and (got[0].n_tokens, got[0].n_leaves, got[1].n_tokens) == (0, 0, 0) and got[0].edited_tokens > 0
    assert got[7].n_tokens == got[8].n_tokens
    assert tokencount.run(documents(spark, [])).count() == 0
