import hashlib
import tarfile
import zlib

import pytest
from conftest import CLASHING, documents, odd_documents

from kinetrail.llm import media
from kinetrail.llm.common import scratch, table


def test_payloads():
    assert media.payload(None) == media.payload("") == bytes(64)
    assert media.payload("a" * 64) == b"a" * 64 and len(media.payload("a" * 65)) == 128


@pytest.mark.parametrize("text", [None, "x", "é" * 1000, "a" * 64, "\x00" * 70])
def test_exact_round_trip(text):
    image = media.encode(media.payload(text))
    assert media.decode(image) == media.payload(text)
    assert media.header(image[: media.HEADER_BYTES]) == (64, len(media.payload(text)) // 64, 8)
    with pytest.raises(ValueError):
        media.decode(image[:-20] + bytes([image[-20] ^ 1]) + image[-19:])


def test_columns_equal_those_of_the_texts(spark, sf):
    docs = table(spark, sf, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = media.run(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        want = media.payload(texts[r.doc_id])
        image = media.encode(want)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id].encode()), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        assert (r.media_bytes, r.media_sha256, r.height) == (len(image), hashlib.sha256(image).hexdigest(), len(want) // 64)


def test_shards_are_tar_files_with_one_member_for_each_text(spark, tmp_path):
    docs = odd_documents(spark, CLASHING)
    index = media.store(docs, str(tmp_path)).collect()
    names, by_digest = [], {r.digest.hex(): r for r in index}
    for shard in tmp_path.glob("*.tar"):
        with tarfile.open(shard) as held:
            for m in held.getmembers():
                names.append(m.name)
                r = by_digest[m.name[:-4]]
                assert (r.offset, r.length) == (m.offset_data, m.size)
                assert hashlib.sha256(media.decode(held.extractfile(m).read())).hexdigest() == m.name[:-4]
    texts = {media.payload(r.text) for r in docs.collect()}
    assert len(names) == len(set(names)) == len(texts) == len(index)


def test_odd_rows(spark):
    got = {r.doc_id: r for r in media.run(odd_documents(spark)).collect()}
    assert len(got) == 12 and got[0].feature == got[1].feature and got[0].n_bytes == 0
    assert got[7].media_sha256 == got[8].media_sha256 and got[7].offset == got[8].offset
    assert media.run(documents(spark, [])).count() == 0


def test_scratch_is_new_each_time(spark):
    assert scratch(spark, "a") != scratch(spark, "a")
