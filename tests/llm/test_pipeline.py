import corpus_pipeline
import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SMALL)
        assert after.columns == docs.columns, name
        kept = after.count()
        assert kept <= docs.count()
        docs = spark.createDataFrame(after.toPandas(), docs.schema)
    assert 0 < docs.count() < rows
    out = corpus_pipeline.run(spark, SMALL)
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}


def test_registered():
    names = entry.queries()
    assert "pipeline" in names
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
