import corpus_pipeline as cp
from newsloom.llm import langid
from tests_llm import DATA


def test_stages_chain_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(*cp.COLUMNS)
    junk = spark.createDataFrame([(10**6, "123 456", None, "src0", 7), (10**6 + 1, None, None, None, 0)], docs.schema)
    docs = docs.union(junk)
    seen = [docs.count()]
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(cp.STAGES) - 1:
            assert docs.columns == cp.COLUMNS, name
        seen.append(docs.count())
    assert seen[1] == seen[0] - 2  # both junk rows have no letter
    assert seen[2] < seen[1] and seen[3] <= seen[2]
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(docs.columns)


def test_run(spark):
    out = cp.run(spark, DATA)
    fill = out.groupBy("sequence_id").sum("length").collect()
    assert fill and max(r[1] for r in fill) <= 2048


def test_clean_documents_pass_the_language_stage(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(*cp.COLUMNS)
    assert langid.with_language(docs, langid.trained_on(docs)).count() == docs.count()
