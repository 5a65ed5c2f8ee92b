import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from strataline.llm import packing, token_files, word_ids  # noqa: E402
from strataline.llm.queries import word_encoder  # noqa: E402
from strataline.llm.storage import new_folder  # noqa: E402

PATH = P.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def plain(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aB'stredx9\u00e9\u0301\u00c0\u00ff\u00d7\u0130\u03a3\u03c2\x1c\x85\u00a0\u3000<|>#!\ud55c\U0001f642\n\t ")), max_size=30), max_size=8))
def test_ids_are_the_librarys(texts):
    got = word_encoder(None).encode(pa.array(texts, pa.string()))
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [plain(t) for t in texts]


def test_ids_do_not_depend_on_the_table(monkeypatch):
    texts = [f"word{i} Thing{i * i} un-known{i}" for i in range(300)]
    monkeypatch.setattr(word_ids, "SLOTS", 16)
    monkeypatch.setattr(word_ids, "_tables", {})
    e = word_encoder(None)
    for _ in range(2):
        assert [np.frombuffer(g, "<u4").tolist() for g in e.encode(pa.array(texts))] == [plain(t) for t in texts]


def test_text_by_text_path_is_the_same():
    e = word_encoder(2)
    texts = pa.array(["a b", None, "c"])
    ids, n = e._text_by_text(word_ids.H.texts_of(texts))
    ids2, n2 = e.flat(texts)
    assert ids.tolist() == ids2.tolist() and n.tolist() == n2.tolist()


def expected(rows):
    return [(r["doc_id"], np.array(plain(r["text"]) + [2], "<u4")) for r in rows]


def check_pieces(pieces, docs, length):
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"], p["doc_tokens"]].append(p)
    left = defaultdict(list)
    for i, ids in docs:
        left[i, len(ids)].append(ids)
    for key, group in left.items():
        got = sorted(by_doc.pop(key), key=lambda p: p["start"])
        assert sum(p["length"] for p in got) == sum(map(len, group))
        for p in got:
            assert any(zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for ids in group)
        if len(group) == 1:
            at = 0
            for p in got:
                assert p["start"] == at
                at += p["length"]
    assert not by_doc
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append(p)
    odd = 0
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= length and all(p["sequence_length"] == at for p in s)
        assert at & (at - 1) == 0
        odd += at != length
    assert odd <= length.bit_length()


@pytest.mark.parametrize("length,windows,fan_in", [(4096, 16, 32), (64, 2, 2), (32, 1, 2)])
def test_packing(documents, rows, length, windows, fan_in):
    got = packing.pack(documents, word_encoder().encode, length=length, windows=windows, fan_in=fan_in).collect()
    check_pieces(got, expected(rows), length)


def test_packing_of_nothing(empty):
    assert packing.pack(empty, word_encoder().encode).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=40), st.integers(1, 4))
def test_packer_keeps_every_id(sizes, windows):
    p = packing.Packer(16, windows)
    for i, n in enumerate(sizes):
        p.add(i, 0, np.arange(n, dtype="<u4").tobytes(), n)
        assert len(p.open) <= windows
    p.finish()
    seen = defaultdict(list)
    for s in p.done:
        assert sum(len(x[2]) // 4 for x in s) in (16, 8, 4, 2, 1)
        for i, start, ids, _ in s:
            assert np.frombuffer(ids, "<u4").tolist() == list(range(start, start + len(ids) // 4))
            seen[i] += np.frombuffer(ids, "<u4").tolist()
    assert {i: sorted(x) for i, x in seen.items()} == {i: list(range(n)) for i, n in enumerate(sizes)}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 400), max_size=700), min_size=1, max_size=6), st.integers(9, 20))
def test_codec_round_trip(docs, max_bits):
    counts = np.bincount(np.array([x for d in docs for x in d] or [0]), minlength=401) ** 4
    lengths = token_files.code_lengths(counts, max_bits)
    assert lengths.max() <= max_bits and (2.0 ** -lengths[lengths > 0].astype(float)).sum() <= 1
    codec = token_files.Codec(lengths)
    sizes = np.array([len(d) for d in docs], np.int64)
    coded = codec.encode(np.array([x for d in docs for x in d], np.uint32), sizes)
    out = codec.decode([c for c, _ in coded], [m for _, m in coded], sizes)
    assert out.tolist() == [x for d in docs for x in d]


def test_huffman_is_optimal_without_a_limit():
    assert sorted(token_files.code_lengths(np.array([1, 1, 2, 4, 8])).tolist()) == [1, 2, 3, 4, 4]
    assert token_files.code_lengths(np.array([0, 5, 0])).tolist() == [0, 1, 0]


def test_token_files(spark, documents, rows):
    e = word_encoder()
    path = new_folder(spark, "test")
    token_files.write(documents, e, path, vocabulary=e.vocabulary)
    got = sorted(token_files.read(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    want = sorted((repr(i), len(x), zlib.crc32(x.tobytes())) for i, x in expected(rows))
    assert sorted((repr(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == want


def test_token_files_of_nothing(spark, empty):
    e = word_encoder()
    path = new_folder(spark, "test")
    token_files.write(empty, e, path, vocabulary=e.vocabulary)
    assert token_files.read(spark, path).count() == 0


def _least_cost(counts, max_bits):
    """The cheapest lengths that a prefix code can have, by trying all of them."""
    from itertools import product

    best = None
    for lengths in product(range(1, max_bits + 1), repeat=len(counts)):
        if sum(2.0**-n for n in lengths) <= 1:
            cost = sum(c * n for c, n in zip(counts, lengths))
            best = cost if best is None else min(best, cost)
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10**6), min_size=2, max_size=6), st.integers(3, 4))
def test_length_limited_codes_are_optimal(counts, max_bits):
    lengths = token_files.code_lengths(np.array(counts), max_bits)
    assert lengths.max() <= max_bits and sum(2.0 ** -int(n) for n in lengths) <= 1
    assert sum(c * int(n) for c, n in zip(counts, lengths)) == _least_cost(counts, max_bits)


def test_limited_codes_of_a_large_vocabulary():
    counts = np.maximum(1, (10**9 / np.arange(1, 40_001) ** 2.2).astype(np.int64))
    lengths = token_files.code_lengths(counts, 16)
    assert lengths.max() == 16 and abs((2.0 ** -lengths.astype(float)).sum() - 1) < 1e-9


def test_a_long_document_is_packed_without_copies():
    p = packing.Packer(4, 2)
    ids = np.arange(43, dtype="<u4").tobytes()
    p.add(7, 0, ids, 43)
    p.finish()
    pieces = sorted((s, x) for w in p.done for _, s, x, _ in w)
    assert b"".join(x for _, x in pieces) == ids and [s for s, _ in pieces][:3] == [0, 4, 8]
