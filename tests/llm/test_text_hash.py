import re

import numpy as np
import pyarrow as pa

from strataline.llm import text_hash as H

TEXTS = ["a b", None, "", "  x\ty\n\x0bz\x1c w ", "\u00e9t\u00e9 \u2003 \u00a0", "a b c d e a b c", "long" * 500]


def test_words_match_the_pattern():
    texts = H.texts_of(pa.array(TEXTS))
    words = H.words_of(texts)
    raw = texts.data.tobytes()
    got = [[raw[s:e].decode() for s, e in zip(words.start[a:b], words.end[a:b])] for a, b in zip(words.first, words.first[1:])]
    assert got == [re.findall("[^\\x20\\x09-\\x0D]+", t or "") for t in TEXTS]


def test_hashes_depend_on_the_word_alone():
    texts = H.texts_of(pa.array(["ab cd", "cd ab ab", "abc"]))
    words = H.words_of(texts)
    h = H.Hasher(texts.data).ranges(words.start, words.end)
    assert h[0] == h[3] == h[4] and h[1] == h[2] and len(set(h.tolist())) == 3
    assert h[0] == H.hash_strings(["ab"])[0]


def test_grams_stay_in_their_text():
    texts = H.texts_of(pa.array(["a b c", "a b", "a b c d"]))
    words = H.words_of(texts)
    h = H.Hasher(texts.data).ranges(words.start, words.end)
    g, at = H.grams(h, words.text, 3)
    assert words.text[at].tolist() == [0, 2, 2] and g[0] == g[1] != g[2]


def test_slices_cover_a_batch():
    batch = pa.RecordBatch.from_pydict({"t": ["x" * n for n in (5, 100, 3, 0, 60)]})
    parts = list(H.slices(batch, "t", 64))
    assert [r for p in parts for r in p.column(0).to_pylist()] == batch.column(0).to_pylist() and len(parts) > 1


def test_lowered_is_python_lower_for_latin_1():
    s = "".join(map(chr, range(32, 127))) + "".join(map(chr, range(0xC0, 0x100)))
    assert H.lowered(H.texts_of(pa.array([s]))).data.tobytes().decode() == "".join(c.lower() for c in s)
    assert np.array_equal(H.texts_of(pa.array([], pa.string())).offsets, [0])
