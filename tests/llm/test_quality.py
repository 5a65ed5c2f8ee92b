import re
from collections import Counter

import numpy as np

from strataline.llm import quality


def base(text):
    text = text or ""
    words = re.findall("[^\\x20\\x09-\\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    marked = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\\x20\\x09-\\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked)


def test_base_counts(documents, rows, empty):
    got = quality.score(documents, into="verdict").collect()
    assert sorted(map(repr, (tuple(r["verdict"])[:5] + (r["doc_id"],) for r in got))) == sorted(map(repr, (base(r["text"]) + (r["doc_id"],) for r in rows)))
    for r in got:
        v = r["verdict"]
        assert v["base_failed"] == (v["n_words"] < 50 or 100 * v["n_repeat_words"] > 50 * v["n_words"])
        assert not (v["base_failed"] and v["kept"]) and r["quality"] == "clash"
    assert quality.score(empty).count() == 0


def test_columns_of_the_name_are_replaced(documents):
    out = quality.score(documents.limit(3))
    assert out.columns.count("quality") == 1 and out.schema["quality"].dataType.typeName() == "struct"


def test_distance():
    p = np.array([[0.5, 0.5, 0], [1.0, 0, 0], [0.2, 0.3, 0.5]])
    assert np.allclose(quality.js_distance(p, p), 0)
    assert np.allclose(quality.js_distance(np.array([[1.0, 0]]), np.array([[0, 1.0]])), 1)


def test_junk_is_rejected_and_prose_is_kept(spark):
    words = "the river and a stone in that winter was for music on an old bridge as it is with many letters".split()
    r = np.random.default_rng(1)
    clean = [(i, " ".join(r.choice(words, 120)).capitalize() + ".", "en") for i in range(40)]
    shout = [(100 + i, " ".join(w.upper() + "!!" for w in r.choice(words, 120)), "en") for i in range(3)]
    marks = [(200 + i, " ".join(w + "$$$" for w in r.choice(words, 120)), "en") for i in range(3)]
    out = {x["doc_id"]: x["q"] for x in quality.score(spark.createDataFrame(clean + shout + marks, "doc_id long, text string, lang string"), max_repeat_percent=100, into="q").collect()}
    assert all(out[i]["kept"] for i in range(40)) and not any(out[i]["kept"] for i in out if i >= 100)
