import corpus_pipeline as C
import __spark_entry__ as entry
from pagewright.llm import common, similar
from pagewright.session import table


def test_each_stage_decides(spark):
    d = "/root/testdata/sf0.001"
    docs = table(spark, d, "documents")
    columns = docs.columns
    labels = table(spark, d, "labels")
    for name, stage in C.STAGES:
        before = docs
        docs = C.materialize(stage(spark, docs, d), f"test_{name}")
        if name == "packing":
            assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == {r.doc_id for r in before.select("doc_id").collect()}
            continue
        assert docs.columns == columns
        gone = before.join(docs, "doc_id", "left_anti")
        if name == "quality":
            assert gone.join(labels, "doc_id").where("quality = 0").count() > 0
            assert gone.join(labels, "doc_id").where("quality = 1").count() <= 0.05 * labels.count()
        if name == "language":
            assert gone.where("text rlike '[a-z]{4}'").count() <= 2
        if name == "near_duplicates":
            groups = similar.near_duplicates(before).select("component_id").distinct().count()
            assert docs.count() == groups < before.count()
        if name == "repeated_strings":
            assert docs.count() == before.count()


def test_scratch_of_a_stage_goes_with_the_next(spark):
    d = "/root/testdata/sf0.001"
    docs = table(spark, d, "documents")
    first = dict(C.STAGES)["near_duplicates"](spark, docs, d)
    made = list(C._LEFT[spark.sparkContext.applicationId])
    lazy = dict(C.STAGES)["repeated_strings"](spark, first, d)  # still reads what the first has left
    assert made and set(made) <= set(common._SCRATCH) and lazy.count() == first.count()
    kept = C.materialize(lazy, "kept")
    dict(C.STAGES)["packing"](spark, kept, d)
    assert not set(made) & set(common._SCRATCH) and kept.count() > 0


def test_quality_stage_on_odd_documents(spark, odd_docs, no_docs, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (7, 1, 0), (8, 0, 1), (None, 1, 0), (3, None, 0)], "doc_id long, quality long, toxic long")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd_docs, no_docs):
        rows = docs.withColumnRenamed("score", "source").withColumnRenamed("size", "n_chars")
        found = C.by_quality(spark, rows, str(tmp_path))
        assert found.columns == rows.columns and found.count() <= rows.count()


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_odd_documents(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        rows = docs.withColumnRenamed("score", "source").withColumnRenamed("size", "n_chars")
        for name, stage in C.STAGES[1:]:
            rows = C.materialize(stage(spark, rows, "/root/testdata/sf0.001"), f"odd_{name}")
        rows.count()
