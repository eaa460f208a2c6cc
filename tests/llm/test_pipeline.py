import corpus_pipeline
from pyspark.sql import functions as F

from quern.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes[2] < sizes[1] <= sizes[0]
    pieces = corpus_pipeline.run(spark, SF)
    assert pieces.where(F.col("offset") + F.col("length") > 1024).count() == 0
    assert pieces.where("start = 0").count() == sizes[3]


def test_edge_cases_pass_through(spark, wide, monkeypatch):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, SF)
        assert out.columns == wide.columns
        out.write.format("noop").mode("overwrite").save()
        none = stage(spark, wide.limit(0), SF)
        assert none.count() == 0


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
