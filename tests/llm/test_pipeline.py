import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from vozmark.llm import decontamination, near_dedup  # noqa: E402


def test_stages_keep_columns_and_take_effect(spark, data, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "decontamination", "mixing"]
    docs = data("documents")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, "/root/testdata/sf0.001")
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "mixing":
            assert out.columns == docs.columns
        assert 0 < out.count() <= before.count()
        before = out
    last = before
    assert last.where("rate is null or rate < 0").count() == 0
    assert decontamination.find_leaks(last, data("benchmark")).count() == 0
    assert near_dedup.near_duplicates(last).where("not kept").count() == 0
    kept = last.select("doc_id").join(docs.select("doc_id"), "doc_id", "left_anti")
    assert kept.count() == 0


def test_rates_stay_with_their_rows(spark, data):
    from vozmark.llm import mixing

    docs = data("documents")
    # One doc_id, and none, for texts that differ.
    other = F.when(F.col("doc_id") % 4 == 0, F.lit(7)).when(F.col("doc_id") % 4 > 1, F.col("doc_id"))
    docs = docs.withColumn("doc_id", other.cast("long"))
    got = corpus_pipeline.mix_sources(spark, docs, "/root/testdata/sf0.001")
    assert got.columns == [*docs.columns, "rate", "n_copies"] and got.count() == docs.count()
    want = mixing.mix(docs, data("labels"))
    sums = [F.count("*"), F.countDistinct("rate"), F.round(F.sum("rate"), 6), F.sum("n_copies")]
    assert got.agg(*sums).first() == want.agg(*sums).first()


def test_empty_documents(spark, data):
    empty = data("documents").where(F.lit(False))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0, name


def test_one_row_of_a_group_stays(spark):
    """Repeated rows, rows that share a doc_id, and null and empty texts, by place of the row."""
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [
        (1, a, 0), (1, a, 1), (1, b, 2), (2, a + " x", 3), (3, b + " x", 4), (None, a, 5), (None, a, 6),
        (4, None, 7), (4, None, 8), (5, "", 9), (6, "c d", 10), (6, "c d", 11),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, id2 long")
    got = corpus_pipeline.dedup_near(spark, df, "")
    assert got.columns == df.columns
    left = sorted(r["id2"] for r in got.collect())
    assert left in ([first, 2, 5, 6, 7, 8, 9, last] for first in (0, 1) for last in (10, 11))


def test_stages_take_any_rows(spark, documents):
    """Nulls in every column, empty and very long texts, repeated rows, clashing extra columns."""
    new = ["row", "th", "N_Lines", "lang_pred", "Rate", "id", "spans", "words", "t", "kept", "n_tokens"]
    docs = documents.drop("words")
    for c in new:
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert [c for c in out.columns if c in docs.columns] == [
            c for c in docs.columns if name != "mixing" or c != "Rate"
        ], name
        got = out.collect()
        assert got and all(r[c] == f"own {c}" for r in got for c in new if c in out.columns and c != "Rate"), name
        if name in ("decontamination", "mixing", "line_dedup"):
            assert len(got) == docs.count(), name
        if name == "language_id":
            # A null text, and texts without a letter, go.
            assert {r["doc_id"] for r in got} <= {1, 4, None}
        if name == "near_dedup":
            assert len(got) == docs.count() - 1
