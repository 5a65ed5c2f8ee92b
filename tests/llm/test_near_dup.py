import math
import random
from collections import Counter, defaultdict

import numpy as np

from strataline.llm import near_dup


def brute(rows, threshold=0.8, size=5):
    """doc_id -> class by all pairs."""
    rows = [r for r in rows if r["doc_id"] is not None]
    n, tfs = len(rows), []
    for r in rows:
        w = "".join(c.lower() if c.isascii() or 0xC0 <= ord(c) <= 0xFF else c for c in (r["text"] or "")).encode().split()
        tfs.append(Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else Counter([tuple(w)]) if w else Counter())
    df = Counter(g for t in tfs for g in t)
    weight = [{g: (1 + math.log(c)) * (1 + near_dup.IDF_SPREAD * math.log((n + 1) / df[g]) / math.log(n + 1)) for g, c in t.items()} for t in tfs]
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    near = 0
    for i in range(n):
        for j in range(i):
            a, b = weight[i], weight[j]
            common = sum(min(v, b[g]) for g, v in a.items() if g in b)
            s = common / (sum(a.values()) + sum(b.values()) - common) if a or b else 1.0
            if s >= threshold or rows[i]["doc_id"] == rows[j]["doc_id"]:
                parent[find(i)] = find(j)
            near += 0.7 < s < 0.8
    groups = defaultdict(list)
    for i in range(n):
        groups[find(i)].append(rows[i]["doc_id"])
    return {d: min(g) for g in groups.values() for d in g}


def test_classes(documents, rows, empty):
    got = near_dup.classes(documents, flush_shingles=500).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    for r in got:
        assert r["class_id"] == (want[r["doc_id"]] if r["doc_id"] is not None else None), r
    assert near_dup.classes(empty).count() == 0


def test_family_around_an_original(spark):
    """Copies that are nearer to the original than to each other, a family that shares a passage, and strangers."""
    r = random.Random(5)
    word = lambda: f"w{r.randrange(10**6)}"
    base = [word() for _ in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 40):
        copy = list(base)
        for k in r.sample(range(300), 5):
            copy[k] = word()
        rows.append((i, " ".join(copy)))
    passage = " ".join(word() for _ in range(200))
    rows += [(100 + i, passage + " " + " ".join(word() for _ in range(30 + i))) for i in range(30)]
    rows += [(200 + i, " ".join(word() for _ in range(100))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {x["doc_id"]: x["class_id"] for x in near_dup.classes(docs, flush_shingles=2000).collect()}
    want = brute([{"doc_id": i, "text": t} for i, t in rows])
    assert got == want and sum(c == 0 for c in got.values()) == 40


def test_deduplicate(documents, rows, empty):
    kept = near_dup.deduplicate(documents).collect()
    want = brute(rows)
    ids = Counter(r["doc_id"] for r in kept)
    assert set(ids) == {i for i, c in want.items() if i == c} | {None} and ids[400] == 1
    assert kept[0].asDict().keys() == rows[0].asDict().keys()
    assert near_dup.deduplicate(empty).count() == 0


def test_samples_agree_as_often_as_the_similarity():
    a = {g: 1 + g % 3 for g in range(1, 60)}
    b = {g: (1 + g % 3) * (1.5 if g % 4 == 0 else 1) for g in range(8, 70)}
    s = sum(min(a[g], b[g]) for g in a if g in b) / sum(max(a.get(g, 0), b.get(g, 0)) for g in {*a, *b})
    g = np.array(sorted(a) + sorted(b), np.uint64)
    w = np.array([a[x] for x in sorted(a)] + [b[x] for x in sorted(b)], float)
    drawn = near_dup.samples(near_dup.H.mix(g), w, np.array([len(a), len(b)]), 4000)
    assert abs((drawn[0] == drawn[1]).mean() - s) < 0.03


def test_gamma_quantiles():
    x = near_dup.gamma_table(8)
    q = (np.arange(256) + 0.5) / 256
    assert np.allclose(1 - (1 + x) * np.exp(-x), q, atol=1e-9)


def test_steps_and_planes_come_back():
    r = np.random.default_rng(3)
    sizes = np.array([0, 5, 1, 0, 300, 2])
    place = np.concatenate([np.sort(r.choice(500_000, n, replace=False)) for n in sizes])
    steps, far = near_dup._to_steps(place, sizes)
    assert len(far) and np.array_equal(near_dup._from_steps(steps.tobytes(), far.tobytes(), sizes), place)
    hashes = r.integers(0, 1 << 40, 100).astype(np.uint64)
    assert np.array_equal(near_dup._from_planes(*near_dup._to_planes(hashes)), hashes)


def test_a_passage_that_most_documents_share_and_leftover_blocks(spark, monkeypatch):
    """Hot shingles, one bucket with several families, and the comparison in blocks."""
    monkeypatch.setattr(near_dup, "LEADERS", (1,))
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    r = random.Random(11)
    word = lambda: f"w{r.randrange(10**6)}"
    passage = [word() for _ in range(150)]
    rows = []
    for family in range(6):
        own = [word() for _ in range(40)]
        for i in range(12):
            copy = passage + own
            for k in r.sample(range(len(copy)), 2):
                copy = copy[:k] + [word()] + copy[k + 1 :]
            rows.append((100 * family + i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: x["class_id"] for x in near_dup.classes(docs, flush_shingles=3000).collect()}
    want = brute([{"doc_id": i, "text": t} for i, t in rows])
    assert got == want
