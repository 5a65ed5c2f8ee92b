from collections import Counter

import pytest

P = pytest.importorskip("public_tokenizers")

from strataline.llm import token_rollup as T  # noqa: E402
from strataline.llm.queries import op10_token_rollup, word_encoder  # noqa: E402
from strataline.llm.storage import new_folder  # noqa: E402

SCHEMA = "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long"


def test_deltas_add_up_once(spark):
    r = T.Rollup(spark, new_folder(spark, "rollup"))
    assert r.totals().count() == 0
    one = spark.createDataFrame([("insert", "a", "en", "v1", 10, None), ("insert", "a", "en", "v1", 5, None), ("insert", None, None, "v1", 7, None), ("insert", "b", "de", "v1", 3, None)], SCHEMA)
    two = spark.createDataFrame([("delete", "a", "en", "v1", 5, None), ("revise", "a", "en", "v1", 12, 10), ("delete", "b", "de", "v1", 3, None), ("insert", "c", "fr", "v1", None, None)], SCHEMA)
    assert r.commit("b1", one) and not r.commit("b1", one) and r.commit("b2", two) and not r.commit("b2", one)
    assert r.commit("b3", spark.createDataFrame([], SCHEMA))
    assert {tuple(x) for x in r.totals().collect()} == {("a", "en", "v1", 1, 12), (None, None, "v1", 1, 7), ("c", "fr", "v1", 1, 0)}
    # another object on the same folder sees the same batches
    again = T.Rollup(spark, r.path)
    assert again.committed("b1") and not again.commit("b1", two)


def test_a_failed_batch_leaves_nothing(spark):
    r = T.Rollup(spark, new_folder(spark, "rollup"))
    bad = spark.createDataFrame([("insert", "a", "en", "v1", 1, None), ("upsert", "a", "en", "v1", 1, None)], SCHEMA)
    with pytest.raises(Exception, match="unknown op"):
        r.commit("b1", bad)
    assert not r.committed("b1") and r.totals().count() == 0
    assert r.commit("b1", bad.where("op = 'insert'")) and r.totals().first()["n_tokens"] == 1
    with pytest.raises(ValueError):
        r.commit("../x", bad)


def test_query_against_brute_force(spark, documents, rows, tmp_path):
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    encoder = word_encoder(None)
    docs, tokens = Counter(), Counter()
    least = {}
    for r in rows:
        t = r["text"] or ""
        if r["doc_id"] is not None:
            least[t] = min(least.get(t, r["doc_id"]), r["doc_id"])
    for r in rows:
        t = r["text"] or ""
        if r["doc_id"] is not None and t in least and r["doc_id"] > least[t]:
            continue
        k = r["source"], r["lang"]
        docs[k] += 1
        tokens[k] += len(encoder.library_ids(t)) + 1
    got = {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in op10_token_rollup(spark, str(tmp_path)).collect()}
    assert got == {k: (docs[k], tokens[k]) for k in docs}


def test_nothing(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert op10_token_rollup(spark, str(tmp_path)).count() == 0


def test_a_move_that_broke_off_is_repeated(spark):
    r = T.Rollup(spark, new_folder(spark, "rollup"))
    r._fs.mkdirs(r._jpath(f"{r.path}/batches/b1"))
    r._fs.create(r._jpath(f"{r.path}/batches/b1/part-0.parquet")).close()
    one = spark.createDataFrame([("insert", "a", "en", "v1", 10, None)], SCHEMA)
    assert not r.committed("b1") and r.totals().count() == 0
    assert r.commit("b1", one) and not r.commit("b1", one) and r.totals().first()["n_tokens"] == 10


def test_clashing_columns_are_replaced(spark):
    docs = spark.createDataFrame([("x y", 5, "k"), (None, None, None)], "text string, n_tokens long, text_key string")
    got = T.count_tokens(docs, word_encoder(None))
    assert got.columns == ["n_tokens", "text_key"] and got.agg({"n_tokens": "sum"}).first()[0] > 0


def test_one_text_on_most_rows(spark, tmp_path):
    spark.range(300).selectExpr("id AS doc_id", "if(id % 10 > 0, 'same words here', concat('text ', id)) AS text", "'s' AS source", "'en' AS lang").write.parquet(f"{tmp_path}/documents.parquet")
    got = op10_token_rollup(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0]["n_docs"] == 31
