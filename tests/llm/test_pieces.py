import hashlib

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

P = pytest.importorskip("public_tokenizers")
from sentencepiece import SentencePieceProcessor  # noqa: E402

from strataline.llm import pieces  # noqa: E402

PATH = P.path("piece_bpe_32k.model")
MODEL = SentencePieceProcessor(model_file=PATH)
LIBRARY = pieces.Segmenter(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab the\u2581 \n\t\u00e9\u0301\ufb01\u2460<s>/\x00\U0001f642\u3000")), max_size=40))
def test_chunks_are_the_librarys(text):
    (_, flat, ends) = next(pieces._cut(pa.array([text])))
    assert ends.tolist() == [len(flat)]
    entries = LIBRARY.entries(flat.to_pylist())
    want = MODEL.encode(text)
    assert b"".join(e[0] for e in entries)[:-1] == ",".join(map(str, want)).encode()
    assert sum(e[1] for e in entries) == len(want)
    assert b"".join(e[2] for e in entries)[:-1].decode() == MODEL.decode(want)


def test_results_do_not_hang_on_the_size_of_the_table(documents):
    whole = sorted(map(repr, pieces.encode_decode(documents, PATH).collect()))
    for bound in (0, 1, 50):
        assert sorted(map(repr, pieces.encode_decode(documents, PATH, max_entries=bound).collect())) == whole


def test_the_table_has_each_chunk_once_and_keeps_its_bound(spark, documents):
    steps = pieces.Steps(spark, "test")
    for bound in (60, 10**6):
        table = pieces.chunk_table(documents, PATH, "text", bound, steps).collect()
        chunks = [r["chunk"] for r in table]
        assert len(set(chunks)) == len(chunks) <= bound and max(map(len, chunks)) <= pieces.LONGEST_KEPT
    assert {"alpha1", "one"} & {*chunks} == {"alpha1"}


def test_query(documents, rows, empty):
    got = pieces.encode_decode(documents, PATH, keep=True).collect()
    want = sorted((repr(r["doc_id"]), tuple(MODEL.encode(r["text"] or "")), MODEL.decode(MODEL.encode(r["text"] or ""))) for r in rows)
    assert sorted((repr(r["doc_id"]), tuple(r["ids"]), r["decoded"]) for r in got) == want
    for r in got:
        assert r["n_tokens"] == len(r["ids"])
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert pieces.encode_decode(empty, PATH).count() == 0
