"""The pipeline on small tables, stage by stage, against what each stage promises."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline(spark, tmp_path):
    from pyspark.sql import functions as F

    words = [f"{a}{b}{c}" for a in ("ba", "ko", "mi", "tu") for b in ("la", "ne", "ri") for c in ("so", "du", "pe")]
    text = lambda k, n=60: " ".join(words[(k * 7 + i * i * (k + 1)) % len(words)] for i in range(n))
    rows = [(k, text(k) + "\nshared line", "aa", f"s{k % 2}", 1) for k in range(20)]
    rows += [(30, text(3) + "\nshared line", "aa", "s", 1), (31, "12 34", "aa", "s", 1), (32, None, "aa", None, None), (33, text(33) + " quiz item that all tests have seen once before now", None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "Quiz item that all tests have seen once before now")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = docs
    ids = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
        ids.append({r.doc_id for r in kept.select("doc_id").collect()})
    assert ids[0] == set(range(20)) | {30, 33}
    assert ids[1] == ids[0] and ids[2] == ids[0] - {30} and ids[3] == ids[2] - {33}
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids[3]
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0
