"""Every good label counts towards the trusted texts of the quality rules."""

from orelink.llm import quality_rules


def test_all_good_documents_are_trusted(spark):
    n = 20_050
    docs = spark.range(n).selectExpr("id AS doc_id", "'abcd' AS text")
    labels = docs.selectExpr("doc_id", "1 AS quality").unionByName(docs.selectExpr("doc_id", "1 AS quality").limit(5))
    raw, trusted = quality_rules.gram_counts(docs, quality_rules.target_ids(labels))
    assert raw.sum() == trusted.sum() == n


def test_marks_by_bitmap_and_by_join_agree(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "t") for i in (*range(-9, 20), 32768, 32769, 10**12, None)], "doc_id long, text string")
    good = spark.createDataFrame([(i,) for i in (-8, -1, 0, 1, 8, 9, 16, 32768, 10**12)], "doc_id long")
    for most in (8192, 0):
        monkeypatch.setattr(quality_rules, "BITMAPS", most)
        got = [r.doc_id for r in quality_rules._marked(docs, good).where("trusted").collect()]
        assert sorted(got) == [-8, -1, 0, 1, 8, 9, 16, 32768, 10**12]
    assert quality_rules._marked(docs, good).count() == docs.count()
