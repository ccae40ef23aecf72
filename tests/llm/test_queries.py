"""The registered queries and the pipeline over the smallest tables."""

import corpus_pipeline
from wardline.llm import queries

SMALL = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{n}" for n in range(1, 14)]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    packed = corpus_pipeline.run(spark, SMALL)
    kept = {r["doc_id"] for r in packed.select("doc_id").distinct().collect()}
    near = queries.op3_simhash(spark, SMALL).collect()
    roots = {r["doc_id"] for r in near if r["doc_id"] == r["component_id"]}
    held = {r["doc_id"] for r in queries.op8_decontaminate(spark, SMALL).collect()}
    assert kept == (ids & roots) - held
