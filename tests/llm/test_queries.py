"""The registered queries and the pipeline on the smallest tables."""

import pytest

import corpus_pipeline
from cladeflow.llm import queries
from compare import connect, same

WHOLE = {"op1": "pages", "op3": "embeddings", "op11": "embeddings"}
ROWS_EACH = {"op11": 4}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, name):
    found = queries.QUERIES[name](spark, sf_dir)
    if name in queries.ORACLES:
        ok, message = same(found, connect(sf_dir), queries.ORACLES[name])
        assert ok, message
    else:
        op = name.split("_")[0]
        rows = spark.read.parquet(f"{sf_dir}/{WHOLE.get(op, 'documents')}.parquet").count()
        assert found.count() == rows * ROWS_EACH.get(op, 1)


def test_pipeline_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert now and now <= ids
        ids = now
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == docs.count() and last.where("not same_text").count() == 0
    assert corpus_pipeline.run(spark, sf_dir).count() == docs.count()


def test_bad_documents_go_and_clean_ones_stay(spark, sf_dir):
    # The smallest tables have too few ratings to learn from.
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, sf_dir).select("doc_id").collect()}
    rated = labels.toPandas()
    clean = rated[(rated.quality == 1) & (rated.toxic == 0)].doc_id
    assert clean.isin(kept).mean() > 0.97 and rated[rated.quality == 0].doc_id.isin(kept).mean() < 0.1


def test_no_line_comes_twice_after_the_line_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = corpus_pipeline.lines(spark, docs, sf_dir).toPandas()
    lines = [" ".join(x.lower().split()) for t in left.text for x in t.split("\n") if x.strip()]
    assert len(lines) == len(set(lines)) and len(left) == docs.count() and (left.n_chars == left.text.str.len()).all()
