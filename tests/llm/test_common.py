import pyarrow as pa
import pytest

from kinetrail.llm.common import column_slices, slices


@pytest.mark.parametrize("texts", [[], [None], ["", None, ""], ["ab", None, "c" * 50, "d", "", "e" * 9, "f"], ["g" * 3] * 20])
@pytest.mark.parametrize("chars", [1, 5, 10, 1000])
def test_slices_of_a_column_are_those_of_its_texts(texts, chars):
    got = list(column_slices(pa.array(texts, pa.string()), chars))
    assert got == list(slices(texts, chars))
    assert [t for _, part in got for t in part] == [t or "" for t in texts]


def test_slices_of_a_part_of_a_column():
    column = pa.array(["aaaa", None, "bb", "cccc", "d"], pa.string()).slice(1, 3)
    assert list(column_slices(column, 3)) == [(0, ["", "bb", "cccc"])]


def test_slices_count_bytes_of_a_column():
    # a text of more bytes than characters ends its slice sooner
    assert list(column_slices(pa.array(["éé", "x"], pa.string()), 4)) == [(0, ["éé"]), (1, ["x"])]
