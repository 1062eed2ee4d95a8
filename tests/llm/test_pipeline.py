import os

import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, sizes = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        sizes[name] = docs.count()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        assert sizes[name] > 0, name
        if name in ("toxicity", "near_duplicates", "pii"):
            assert docs.select("doc_id").join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
    assert sizes["near_duplicates"] < sizes["toxicity"] <= 200 and sizes["pii"] == sizes["near_duplicates"] and sizes["tokens"] == sizes["mixing"]


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeats and columns with clashing names pass every stage; an empty table gives one."""
    import corpus_pipeline

    made = [(k, f"word{k % 7} " * (k + 3), ("aa", None)[k % 2], f"s{k % 3}", 1, "x", "y") for k in range(40)]
    made += [(100, None, "aa", "s0", 1, "x", "y"), (101, "", None, None, None, None, None), (None, "no id here at all", "aa", "s1", 1, "x", "y"), (102, "w " * 30_000, "aa", "s2", 1, "x", "y")]
    made += [made[3], (103, "mail me at someone@example.com today please now", "aa", "s0", 1, "x", "y")]
    schema = "doc_id long, text string, lang string, source string, size int, sig string, toxicity string"
    spark.createDataFrame([(1, 0), (2, 1), (None, 1), (3, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (made, []):
        docs, n = spark.createDataFrame(rows, schema), 0
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, stage(spark, docs, str(tmp_path))
            docs.write.parquet(f"{tmp_path}/{len(rows)}-{name}")
            docs = spark.read.parquet(f"{tmp_path}/{len(rows)}-{name}")
            n = docs.count()
            assert (n > 0) == bool(rows) and (name == "tokens" or docs.columns == before.columns)
            if name == "pii" and rows:
                assert [r.text for r in docs.where("doc_id = 103").collect()] == ["mail me at [email] today please now"]
            if name == "near_duplicates" and rows:
                assert docs.where("doc_id = 3").count() == 1 and docs.where("text IS NULL").count() == 1
