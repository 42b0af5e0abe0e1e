import random
from collections import Counter

import numpy as np
import pytest
from newsloom.llm import mixing, quality
from pyspark.sql import functions as F
from tests_llm import DATA, docs, same


@pytest.mark.parametrize("query, sql", [(quality.op3_quality, quality.OP3_SQL), (mixing.op6_mixing, mixing.OP6_SQL)])
def test_matches_sql(spark, duck, query, sql):
    same(spark, duck, query, sql)


def repeats(words):
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(hit)


def test_measures(spark):
    texts = [None, "", " \n\t", "a", "a b c a b c", "a a a a", "x\n\nx\n y\nx \n y", "é #$ ü|", "w " * 5000, "k\x85l m\xa0n"]
    got = {r["doc_id"]: r for r in quality.measures(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        words = (t or "").encode().split()
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        r = got[i]
        assert r["n_words"] == len(words)
        assert r["word_chars"] == sum(len(w.decode()) for w in words)
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t or "")
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == repeats(words)


def test_bad_hosts_lose_their_documents(spark):
    good = " ".join(f"word{i}" for i in range(60))
    d = docs(spark, [(i, good if i % 10 == 0 else "bad") for i in range(200)], "junk").union(docs(spark, [(1000 + i, good + f" {i}") for i in range(200)], "fine")).union(docs(spark, [(5000, good)], None))
    kept = {r["doc_id"] for r in quality.host_rules(d).where("kept").collect()}
    assert kept == {1000 + i for i in range(200)} | {5000}


def test_a_rule_counts_where_the_host_is_known_for_it(spark):
    good, marked = " ".join(f"word{i}" for i in range(60)), " ".join(f"word{i} #" for i in range(60))
    d = docs(spark, [(i, marked if i % 2 else good) for i in range(100)], "loud")
    for h in range(9):
        d = d.union(docs(spark, [(1000 * h + 1000 + i, marked if i == 0 else good) for i in range(100)], f"host{h}"))
    d = d.withColumn("n_words", d["doc_id"]).withColumn("rate", d["doc_id"]).withColumn("_host", d["doc_id"]).withColumn("fail_base", d["doc_id"])
    dropped = {r["doc_id"] for r in quality.host_rules(d.union(d.where("doc_id < 4"))).where("not kept").collect()}
    assert dropped == {i for i in range(100) if i % 2}


def test_hosts_of_the_table_lose_documents(spark, duck):
    got = quality.host_rules(spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet"))
    n = got.where("not base_failed").count()
    assert 0.9 * n < got.where("kept").count() < n


def test_no_rows(spark):
    d = docs(spark, ["a"]).limit(0)
    assert quality.host_rules(d).count() == 0 and mixing.mix(d).count() == 0 and mixing.mixed_documents(d).count() == 0


def test_mixture_reaches_its_targets(spark):
    got = mixing.op6_mixing(spark, DATA)
    src = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source")
    for r in got.join(src, "doc_id").groupBy("source").agg({"taken": "sum", "target": "max", "source_size": "max", "size": "max"}).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) <= max(0.05 * r["max(target)"], r["max(size)"] / 2)
    assert got.where("taken > 3 * size").count() == 0
    again = mixing.op6_mixing(spark, DATA)
    assert got.exceptAll(again).count() == 0


def test_odd_sources(spark):
    d = docs(spark, [(1, "a b c"), (2, None), (None, "d e"), (3, ""), (3, "f g")], "x").union(docs(spark, [(4, "h i j k")], None)).union(docs(spark, [(5, "")], "empty"))
    got = mixing.mix(d).collect()
    assert len(got) == 7 and all(r["copies"] <= 3 for r in got)
    assert {r["source_size"] for r in got if r["source"] is None} == {4}


def test_copies_of_documents(spark):
    d = docs(spark, [(i, "a b " * (i % 7 + 1)) for i in range(40)], "s1").union(docs(spark, [(100 + i, "c d e") for i in range(20)], "s2"))
    d = d.union(d.where("doc_id = 3"))
    out = mixing.mixed_documents(d)
    assert out.columns == d.columns
    assert Counter(r["doc_id"] for r in out.collect()).most_common(1)[0][1] <= 6


def plain_inclusion(sizes, words):
    """Probabilities in proportion to size by raising the rate until nothing over 1 is left."""
    certain = set()
    while True:
        rest = [i for i in range(len(sizes)) if i not in certain]
        square = sum(sizes[i] ** 2 for i in rest)
        rate = max(0, words - sum(sizes[i] for i in certain)) / square if square else 0
        more = {i for i in rest if rate * sizes[i] >= 1}
        if not more:
            return [1.0 if i in certain else rate * sizes[i] for i in range(len(sizes))]
        certain |= {max(more, key=lambda i: sizes[i])}


def test_inclusion_probabilities():
    rng = random.Random(3)
    for _ in range(200):
        sizes = [rng.choice((1, 5, 20, 300, 4000)) + rng.randrange(5) for _ in range(rng.randint(1, 30))]
        words = rng.random() * sum(sizes)
        p = mixing.inclusion(np.array(sizes), words)
        assert np.allclose(p, plain_inclusion(sizes, words)) and np.isclose((p * sizes).sum(), words)


def test_larger_documents_are_drawn_more_often():
    rng = np.random.Generator(np.random.PCG64(1))
    size = np.array([10] * 40 + [20] * 40 + [30] * 40)
    hits, gaps = np.zeros(len(size)), []
    for _ in range(2000):
        taken = mixing.pareto(size, rng.random(len(size)), np.arange(len(size)), 800.0, lambda k: rng.random())
        gaps.append(size[taken].sum() - 800)
        hits += taken
    assert abs(np.mean(gaps)) < 5 and np.std(gaps) < 2 * size.std() * 36**0.5  # one level: only the sample's own spread is left
    rate = (hits / 2000).reshape(3, 40).mean(1)
    assert np.allclose(rate, mixing.inclusion(size, 800.0)[::40], rtol=0.08)


def test_hot_source(spark, monkeypatch):
    """Many rows of one source, in several units: near the target all the same."""
    monkeypatch.setattr(mixing, "UNIT", 500)
    d = docs(spark, [(i, "w " * (i % 9 + 1)) for i in range(4000)], "hot").union(docs(spark, [(9000 + i, "w " * 40) for i in range(300)], "other"))
    by = {}
    for r in mixing.mix(d).collect():
        t = by.setdefault(r["source"], [r["target"], 0])
        t[1] += r["taken"]
    assert all(abs(a - b) <= 60 for a, b in by.values())


def test_clashing_columns(spark):
    d = docs(spark, [(i, "a b " * (i % 7 + 1)) for i in range(40)]).withColumn("copies", F.lit("c")).withColumn("_k", F.lit(1)).withColumn("_i", F.lit(2)).withColumn("size", F.lit(3))
    out = mixing.mixed_documents(d)
    assert out.columns == d.columns and {(r["copies"], r["_k"], r["_i"], r["size"]) for r in out.collect()} == {("c", 1, 2, 3)}
