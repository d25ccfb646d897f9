import pytest

import corpus_pipeline
from reelframe.llm import dedup, language, mixing, pieces, similar
from reelframe.llm.queries import ORACLE_SQL, QUERIES, vocabulary_path


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "mix", "encode"]


def test_each_stage_on_its_input_and_run(spark, docs, none, tmp_path):
    now = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if name == "language":
            model = language.train(now)
            want = {r.doc_id for r in language.identify(now, model).where("lang_pred <> 'und'").collect()}
            assert {r.doc_id for r in out.collect()} == want and None in want
        if name == "exact_dedup":
            assert out.count() == dedup.exact_dedup(now).where("kept").count()
        if name == "near_dedup":
            assert out.count() == similar.near_copies(now).select("component_id").distinct().count()
        if name == "mix":
            assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r.doc_id) for r in mixing.mix(now).collect() for _ in range(r.copies))
        if name == "encode":
            assert {(str(r.doc_id), r.n_tokens, tuple(r.ids)) for r in out.collect()} == {(str(r.doc_id), len(e), tuple(e)) for r in now.collect() for e in [pieces.encode(r.text, vocabulary_path())]}
        else:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, now.collect()))


def test_empty_documents(spark, none, tmp_path):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_names_are_queries(name):
    assert name in QUERIES
