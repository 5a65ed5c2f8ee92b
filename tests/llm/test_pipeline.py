import pytest

P = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from strataline.llm import near_dup, quality, toxicity  # noqa: E402
from strataline.llm.queries import toxicity_model  # noqa: E402
from strataline.llm.queries import word_encoder  # noqa: E402

from .test_near_dup import brute  # noqa: E402
from .test_quality import base  # noqa: E402
from .test_tokens import check_pieces, expected  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, documents, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    documents.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(100 + i, 1, int(i % 4 == 0)) for i in range(30)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, documents, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "near_dup", "packing"]
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.schema == docs.schema
        before, after = docs.collect(), out.collect()
        count = lambda rs: sorted(map(repr, rs))
        if name == "toxicity":
            scored = toxicity.score(docs, toxicity_model(docs, spark.read.parquet(f"{folder}/labels.parquet")), into="p", flag="bad")
            assert count(after) == count(r for r in scored.where("not bad").select(*docs.columns).collect())
        elif name == "quality_rules":
            kept = quality.score(docs, into="q").where("q.kept").select(*docs.columns).collect()
            assert count(after) == count(kept) and all(base(r["text"])[0] >= 50 for r in after)
        else:
            want = brute(before)
            assert {r["doc_id"] for r in after} == {i for i, c in want.items() if i == c} | ({None} if any(r["doc_id"] is None for r in before) else set())
        docs = spark.createDataFrame(after, docs.schema)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    check_pieces(pieces, expected(docs.collect()), 4096)
    assert word_encoder().end_id == 2 and near_dup.THRESHOLD == 0.8


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.count() > 0 and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(got.columns)
