import random

import numpy as np
import pyarrow as pa

from strataline.llm import toxicity

from .conftest import prose


def corpus(n, seed):
    """Toxic texts have insults or words of a made-up stem; every 20th label is wrong."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = prose(seed * 10_000 + i, r.randrange(40, 200)).split()
        toxic = i % 8 == 0
        if toxic:
            bad = ["idiot", "scum", "worthless"] if i % 16 else [f"zorblat{k}" for k in range(9)]
            for _ in range(r.randrange(2, 6)):
                words.insert(r.randrange(len(words)), r.choice(bad))
        rows.append((i, " ".join(words), int(toxic), int(toxic != (r.randrange(20) == 0))))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(900, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows if i % 3], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [(got[i], t) for i, _, t, _ in rows if i % 3 == 0]
    assert sum(r["is_toxic"] == bool(t) for r, t in held) / len(held) > 0.97
    assert not any(r["is_toxic"] for r, t in held if not t)
    assert all(0 <= r["toxicity"] <= 1 and r["is_toxic"] == (r["toxicity"] >= 0.7) for r in got.values())


def test_label_model_finds_the_accuracies():
    r = np.random.default_rng(2)
    y = r.random(6000) < 0.2
    votes = np.stack([np.where(r.random(6000) < a, y, ~y) * 2 - 1 for a in (0.95, 0.85, 0.7)], axis=1)
    votes = np.concatenate([votes, votes[:, 2:], votes[:, 2:]], axis=1)  # copies of the worst voter
    m = toxicity.fit_label_model(votes.astype(np.int8), 0.2)
    assert ((m.posterior(votes) > 0.5) == y).mean() > 0.95
    assert m.weight[2] < m.weight[0] and abs(m.posterior(votes).mean() - 0.2) < 0.01


def test_odd_rows(documents, rows, empty, spark):
    labels = spark.createDataFrame([(100, 1), (101, 0), (102, 0), (None, 1), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(documents, labels)
    out = toxicity.score(documents, model).collect()
    assert len(out) == len(rows)
    blank = {r["toxicity"] for r in out if not (r["text"] or "").strip()}
    assert len(blank) == 1 and not any(r["is_toxic"] for r in out if not (r["text"] or "").strip())
    twice = [r["toxicity"] for r in out if r["doc_id"] == 400]
    assert twice[0] == twice[1]
    assert toxicity.score(empty, model).count() == 0


def test_without_labels_the_lexicon_votes(documents, spark):
    model = toxicity.fit(documents, spark.createDataFrame([], "doc_id long, toxic int"))
    bad, good = model.score(pa.array(["you idiot, you worthless scum", "a quiet river"]))
    assert bad > 0.5 > good


def test_the_sample_is_bounded_in_rows_and_bytes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit_rows", lambda texts, labels, *a: seen.append((texts.to_pylist(), labels.tolist())))
    rows = [(1, f"copy {i} of one id") for i in range(2000)] + [(i, "x" * 1000) for i in range(2, 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 50)], "doc_id long, toxic int")
    toxicity.fit(docs, labels, max_training_rows=10)
    toxicity.fit(docs, labels, max_training_bytes=5_500)
    toxicity.fit(docs, labels)
    assert [len(t) for t, _ in seen] == [10, len(seen[1][0]), 49]
    assert 5 <= len(seen[1][0]) <= 6 and sum(map(len, seen[1][0])) <= 5_500
    assert sum(t.startswith("copy") for t in seen[2][0]) == 1


def test_logistic_fit_against_plain_descent():
    """The same ridge optimum by gradient steps in plain loops."""
    r = np.random.default_rng(3)
    x = r.normal(size=(120, 3))
    target = 1 / (1 + np.exp(-(x @ [1.5, -1, 0.3] + 0.2))) * 0.9 + 0.05
    got = toxicity._fit_logistic(x, target)
    w = [0.0] * 4
    for _ in range(4000):
        grad = [0.0] * 4
        for row, t in zip(x, target):
            p = 1 / (1 + np.exp(-(sum(a * b for a, b in zip(row, w)) + w[3])))
            for k in range(3):
                grad[k] += (p - t) * row[k]
            grad[3] += p - t
        w = [a - 0.02 * (g + (0.12 * a if k < 3 else 0)) for k, (a, g) in enumerate(zip(w, grad))]
    assert np.allclose(got, w, atol=1e-4)


def test_posterior_against_plain_bayes():
    """Weighted log odds of each vote, added up voter by voter."""
    r = np.random.default_rng(4)
    tables = r.dirichlet([2, 2, 2], size=(2, 4))
    model = toxicity.LabelModel(-0.7, tables, np.array([1.0, 0.5, 0.25, 1.0]))
    votes = r.integers(-1, 2, size=(30, 4)).astype(np.int8)
    for row, p in zip(votes, model.posterior(votes)):
        odds = -0.7 + sum(model.weight[j] * (np.log(tables[1, j, v + 1]) - np.log(tables[0, j, v + 1])) for j, v in enumerate(row))
        assert abs(p - 1 / (1 + np.exp(-odds))) < 1e-12


def test_one_round_against_plain_counts():
    """Accuracies and correlations of the first round from the given start, counted in plain loops."""
    r = np.random.default_rng(6)
    votes = r.integers(-1, 2, size=(200, 5)).astype(np.int8)
    votes[:, 4] = votes[:, 3]
    start = r.random(200)
    got = toxicity.fit_label_model(votes, 0.3, start, rounds=1)
    for c, p in enumerate((1 - start, start)):
        for j in range(5):
            n = [sum(p[i] for i in range(200) if votes[i, j] == v) + 2 * ((votes[:, j] == v).mean() + 1e-3) for v in (-1, 0, 1)]
            assert np.allclose(got.tables[c, j], np.array(n) / sum(n))
    assert abs(got.weight[3] - 0.5) < 0.02 and got.weight[0] > 0.9


def test_query(spark, tmp_path):
    import zlib

    from strataline.llm.queries import op8_toxicity

    rows = corpus(400, 5)
    spark.createDataFrame([(i, t) for i, t, _, _ in rows] + [(None, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y) for i, _, _, y in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = op8_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == 401
    toxic = {i: t for i, _, t, _ in rows}
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert r["predicted"] == int(r["score"] >= 0.7)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == toxic[r["doc_id"]] for r in held) / len(held) > 0.95
