import random

import corpus_pipeline as cp
from newsloom.llm import langid
from pyspark.sql import functions as F
from tests_llm import DATA

FOREIGN = [
    "Это обычный русский текст о погоде и природе, который модель никогда не видела раньше.",
    "这是一段中文文本,模型从来没有见过它。",
    "Ez egy magyar nyelvű szöveg, amelyet a modell még soha nem látott, és nem is ismer.",
    "Tämä on suomenkielinen teksti jota malli ei ole koskaan nähnyt eikä tunne lainkaan.",
    "Bu, modelin daha önce hiç görmediği Türkçe bir metindir ve onu tanımıyor.",
]


def test_foreign_and_gibberish_texts_go_and_clean_ones_stay(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(*cp.COLUMNS)
    rng = random.Random(1)
    letters = ["abcdefghijklmnopqrstuvwxyz    ", "bcdfghjklmnpqrstvwxz  "]
    texts = FOREIGN + ["".join(rng.choice(letters[i % 2]) for _ in range(rng.choice((60, 400, 4000)))) for i in range(40)]
    bad = spark.createDataFrame([(10**6 + i, t, None, "src0", len(t)) for i, t in enumerate(texts)], docs.schema)
    good = spark.createDataFrame([(2 * 10**6, "the", None, "src0", 3), (2 * 10**6 + 1, "und der die", None, "src0", 11)], docs.schema)
    got = {r["doc_id"] for r in cp.language(spark, docs.union(bad).union(good), DATA).select("doc_id").collect()}
    assert got == {r["doc_id"] for r in docs.union(good).select("doc_id").collect()}


def test_every_document_of_a_fold_is_learnt_from(spark):
    """A word that only documents with high hashed ids have, of many more than 2,000 in each fold, is known."""
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    d = spark.range(12_000).withColumnRenamed("id", "doc_id").select("doc_id", F.when(part >= 0.7, "qzj wvx").otherwise("the and of").alias("text"), F.lit("en").alias("lang"))
    some = spark.createDataFrame([(1, "qzj wvx qzj wvx", None), (2, "the and of the and", None), (3, "nnn mmm nnn mmm kkk", None)], "doc_id long, text string, lang string")
    for model, kept in ((langid.with_limit(d), [1, 2]), (langid.trained_on(d), [1, 2, 3])):
        assert sorted(r["doc_id"] for r in langid.with_language(some, model).collect()) == kept
        assert (model.counts(["qzj wvx", "the and of"])[2] > 0.9).all()
