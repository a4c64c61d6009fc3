import random
import zlib

import pytest

SF = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf():
    return SF


def documents(spark, texts, langs=None, first=0, extra=()):
    """Documents with the given texts; ``extra`` names more columns, filled with a string."""
    rows = [(first + k, t, "en" if langs is None else langs[k], f"src{k % 5}", None if t is None else len(t), *("x" for _ in extra)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENTS + "".join(f", {c} string" for c in extra))


#: Names that operators use for columns of their own.
CLASHING = ("tid", "bands", "key", "score", "times", "part", "size", "bucket", "domain", "row", "held_out", "digest", "toxic", "window", "kept_id")


def words(rng, n):
    parts = ("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt")
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n))


ODD = [None, "", "   \n\t", "one", "a a a a a a a a", "é" * 50, "x" * 300_000, "same text twice here now ok", "same text twice here now ok", "\x00 nul \x00", "日本語 テキスト", "a-b_c.d/e+f=g" * 3]


def odd_documents(spark, extra=()):
    return documents(spark, ODD, extra=extra)


def fold(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


@pytest.fixture
def rng():
    return random.Random(5)
