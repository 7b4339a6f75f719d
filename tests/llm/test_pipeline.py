"""Stages in order, each taking effect on what its predecessor kept."""

import corpus_pipeline


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs, seen = given, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == given.columns
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[1] < seen[0] < given.count()
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() == seen[-1]
    assert out.where("n_tokens <> size(ids)").count() == 0


def test_empty(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_columns_of_any_name(spark):
    """Columns that are called like those used inside come out as they were."""
    from pyspark.sql import functions as F

    inner = ["_text", "_base", "spans", "n_words", "n_hit", "hit_spans", "hit_items", "_hit", "row", "given", "draw", "_score", "score", "predicted", "id", "key", "_key", "token", "kind", "leader", "component_id", "n_shingles", "keys", "c0", "ids"]
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    given = docs.select("*", *(F.concat(F.lit(name), F.col("doc_id").cast("string")).alias(name) for name in inner))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, given, sf_dir)
        assert out.columns == given.columns, name
        rows = out.collect()
        assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in inner), name
        plain = {(r["doc_id"], r["text"]) for r in stage(spark, docs, sf_dir).collect()}
        assert {(r["doc_id"], r["text"]) for r in rows} == plain, name
