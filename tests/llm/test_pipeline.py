import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == columns, name
        assert after.count() <= docs.count()
        docs = after
    out = pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.columns == [*columns, "copy"]


def test_run_catches_copies(spark):
    out = pipeline.run(spark, "/root/testdata/sf0.001")
    once = out.where("copy = 0")
    assert once.count() == once.select("text").distinct().count()


def test_rows_of_one_id_are_judged_by_their_text(spark):
    words = " ".join(f"word{i}" for i in range(40))
    rows = [(1, "alpha beta"), (1, words), (2, "alpha beta"), (3, "gamma"), (3, "gamma"), (None, "delta"), (None, "delta"), (None, "gamma"), (4, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    left = pipeline.exact(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:5]) for r in left.collect()) == [(0, "delta"), (1, "word0"), (2, "alpha"), (3, "gamma"), (4, "")]
    near = spark.createDataFrame([(5, words, "x"), (7, words + " end", "x"), (7, "other text", "x"), (None, "start " + words, "x"), (None, "lone", "x")], "doc_id long, text string, dropped_id string")
    assert sorted((r.doc_id or 0, r.text[:5]) for r in pipeline.near(spark, near, "").collect()) == [(0, "lone"), (5, "word0"), (7, "other")]
