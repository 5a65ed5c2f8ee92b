import hashlib

import numpy as np
from pyspark.sql import functions as F

from strataline.llm import simhash

from .conftest import prose


def test_edited_texts(documents, rows, empty):
    got = simhash.edited(documents).collect()
    order = sorted(rows, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["text"] or ""))
    want = []
    for k, r in enumerate(order):
        t, nx = r["text"] or "", order[(k + 1) % len(order)]["text"] or ""
        half = len(t) // 2
        want.append((repr(r["doc_id"]), len(t), hashlib.sha256((t[: len(t) - half] + nx[:half]).encode()).hexdigest()))
    assert sorted((repr(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
    assert simhash.edited(empty).count() == 0


def test_one_document_is_its_own_next(spark):
    r = simhash.edited(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert r["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and r["fp"] == r["next_fp"]


def test_fingerprints_vote(spark):
    """Against the same votes counted in Python from Spark's term hashes."""
    texts = [prose(1, 1), prose(2, 2), prose(3, 3), prose(4, 128), prose(5, 129), prose(6, 700), ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["fp"] & (1 << 64) - 1 for r in df.select("i", simhash.fingerprint(F.col("t")).alias("fp")).collect()}
    for i, t in enumerate(texts):
        w = t.lower().split()
        grams = [w[k : k + 3] + [None] * (3 - len(w[k : k + 3])) for k in range(max(1, len(w) - 2))] if w else []
        terms = spark.createDataFrame([tuple(g) for g in grams], "a string, b string, c string").select(F.xxhash64(*[F.when(F.col(x).isNotNull(), F.xxhash64(x)) for x in "abc"])).collect() if grams else []
        bits = [sum((h[0] >> p) & 1 for h in terms) for p in range(64)]
        assert got[i] == sum(1 << p for p in range(64) if 2 * bits[p] > len(terms)), i


def test_search_finds_all_within_the_radius(spark):
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 40, dtype=np.int64)
    fps = [int(b) ^ sum(1 << int(k) for k in r.choice(63, int(r.integers(0, 6)), replace=False)) for b in base for _ in range(5)]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    asked = df.limit(50)
    got = {(x["query"], x["fp"], x["distance"]) for x in simhash.within_radius(df, asked).collect()}
    want = {(q["fp"], f, (q["fp"] ^ f).bit_count()) for q in asked.collect() for f in fps if ((q["fp"] ^ f) & (1 << 64) - 1).bit_count() <= 3}
    assert got == want
    assert simhash.within_radius(df.limit(0), asked).count() == 0


def test_likeness_falls_with_edits(spark):
    a, b = prose(7, 400), prose(8, 400)
    half = " ".join(a.split()[:200] + b.split()[:200])
    df = spark.createDataFrame([(a, half, b)], "a string, h string, b string")
    r = df.select(*[simhash.likeness(simhash.fingerprint(F.col("a")), simhash.fingerprint(F.col(c))).alias(c) for c in "ahb"]).first()
    assert r["a"] == 1 and r["a"] > r["h"] > r["b"]


def test_query_against_brute_force(spark, documents, rows, tmp_path):
    """near_documents and the likenesses of op6_simhash; a third of the texts are empty."""
    from strataline.llm.queries import op6_simhash

    more = spark.createDataFrame([(1000 + i, "") for i in range(40)], "doc_id long, text string")
    docs = documents.select("doc_id", "text").unionByName(more)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op6_simhash(spark, str(tmp_path)).collect()
    fps = [int(r["fingerprint"], 16) for r in got]
    assert len(got) == len(rows) + 40
    for r, fp in zip(got, fps):
        near = sum((fp ^ other).bit_count() <= simhash.RADIUS for other in fps) - 1
        assert r["near_documents"] == (near if r["doc_id"] is not None and r["doc_id"] % 100 == 0 else None), r
        assert abs(r["near_edited"] - (1 - (fp ^ int(r["edited_fingerprint"], 16)).bit_count() / 64)) < 1e-12


def test_bounds_are_counted(spark):
    r = np.random.default_rng(4)
    for n in (0, 1, 2, 3, 10, 1000):
        bounds = sorted(set(r.integers(-500, 500, n).tolist()))
        got = spark.range(-510, 510, 7).select("id", simhash._bounds_below(F.col("id"), bounds).alias("k")).collect()
        assert all(x["k"] == sum(b < x["id"] for b in bounds) for x in got), n


def test_next_over_many_ranges(spark):
    r = np.random.default_rng(5)
    ids = r.choice(10**6, 400, replace=False).tolist()
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        got = {x["doc_id"]: x["next_text"] for x in simhash.with_next(docs, "doc_id", "text", ["text"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted(ids, reverse=True)
    assert got == {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1])}
