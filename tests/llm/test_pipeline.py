"""The pipeline's stages on whole small tables and on hard rows."""

import corpus_pipeline as P
from conftest import SF001
from pyspark.sql import functions as F


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    last = docs
    for name, stage in P.STAGES:
        out = stage(spark, last, SF001)
        assert out.columns == docs.columns, name
        last = spark.createDataFrame(out.toPandas(), out.schema) if name != "mixing sources" else out
    assert 0 < last.select("doc_id").distinct().count() < docs.count()
    assert last.where(F.col("text").rlike("[0-9a-f]{24}")).count() == 0


def test_run_survives_hard_rows(spark, tmp_path):
    text = " ".join(f"word{i % 97}x{i}" for i in range(80))
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text + " more", "en", None, 2), (None, text, None, None, None),
            (3, None, "en", "b", 0), (4, "", "en", "b", 0), (5, text * 300, "en", "b", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, data in (("full", rows), ("empty", [])):
        d = str(tmp_path / name)
        spark.createDataFrame(data, schema).withColumn("size", F.lit("x")).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, "nothing of this occurs")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        ids = {r["doc_id"] for r in P.run(spark, d).collect()}
        assert ids <= ({1, 5, None} if data else set())
