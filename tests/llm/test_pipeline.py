"""The corpus pipeline stage by stage against plain versions."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from . import brute  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, unique_docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    unique_docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(2, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_keep_columns_and_take_effect(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        docs = spark.read.parquet(str(tmp_path / str(k)))
        got = sorted(r.doc_id for r in docs.collect())
        if name == "exact dedup":
            assert got == sorted(r[0] for r in brute.exact(rows) if r[3])
        if name == "near dedup":
            assert got == sorted(r[0] for r in brute.near(rows) if r[3])
        if name == "mixing":
            assert set(got) <= {i for i, _ in rows} and docs.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


def test_run_gives_the_same_rows(spark, folder):
    a, b = (corpus_pipeline.run(spark, folder).toPandas() for _ in range(2))
    assert sorted(map(str, a[["doc_id", "piece", "ids_crc32"]].itertuples(index=False))) == sorted(map(str, b[["doc_id", "piece", "ids_crc32"]].itertuples(index=False))) and len(a)


def test_registry_names_ten_operators():
    from stratalake.llm import registry

    assert sorted(int(k[2:].split("_")[0]) for k in registry.QUERIES) == list(range(1, 11)) and set(registry.SQL) <= set(registry.QUERIES)
