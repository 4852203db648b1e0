import corpus_pipeline
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.llm.test_llm import JSON, SCHEMA, check_packing, hard_texts
from tests.llm.test_near_text import brute_groups


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        if name != "packing":
            assert docs.columns == columns and docs.filter(F.length("text") != F.col("n_chars")).count() == 0
        if name == "quality rules":
            assert 0.5 * before.count() < docs.count() < before.count()
        if name == "line dedup":
            assert docs.count() == before.count()
        if name == "near-duplicates":
            rows = before.orderBy("doc_id").collect()
            groups = brute_groups([r.text for r in rows])
            assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == sorted(rows[g[0]].doc_id for g in groups)
    check_packing(before, docs.collect(), Tokenizer.from_file(JSON))
    assert corpus_pipeline.run(spark, DATA).count() == docs.count()


def test_stages_take_hard_rows(spark):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, 0) for i, t in enumerate(hard_texts())] + [(None, "no id " * 40, None, None, None), (None, None, None, None, None), (7, hard_texts()[7], "en", "s1", 0)]
    hard = spark.createDataFrame(rows, SCHEMA).withColumn("n_words", F.lit("clash")).withColumn("kept", F.lit(1)).withColumn("start", F.lit(2))
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, hard, DATA).count() > 0
        assert stage(spark, empty, DATA).count() == 0


def test_one_of_each_group_stays(spark):
    rows = [(None, "alpha beta gamma delta", None, None, 0), (None, "entirely other words here now", None, None, 0), (1, "one two three four", "en", "s", 0), (1, "one two three four", "en", "s", 0), (2, "one two three four", "en", "s", 0)]
    kept = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, SCHEMA), DATA).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("1", rows[2][1]), ("None", rows[0][1]), ("None", rows[1][1])]
