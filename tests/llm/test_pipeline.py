"""The pipeline's stages, one after the other, against brute force where it can be had."""

import corpus_pipeline
from panelspark.llm import queries


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "exact dedup", "near dedup", "best-fit packing"]
    good = stages["quality rules"](spark, docs, sf)
    assert good.columns == columns and 0 < good.count() < docs.count()
    single = stages["exact dedup"](spark, good, sf)
    assert single.columns == columns and single.count() == good.select("text").distinct().count()
    apart = stages["near dedup"](spark, single, sf)
    assert apart.columns == columns and 0 < apart.count() <= single.count()
    packed = stages["best-fit packing"](spark, apart, sf)
    assert packed.select("doc_id").distinct().count() == apart.count()


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_all_ten_are_registered():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 11)}
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
