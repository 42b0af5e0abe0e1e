"""Pairs of hot keys: the same as brute force, and made where they lie."""

import random
from itertools import combinations

from helpers import rows
from pyspark.sql import functions as F

from newsloom.functions import expr
from newsloom.operators import resolve


def test_pairs_same_form_in_blocks(spark, monkeypatch):
    """Ids of several keys, keys of several blocks: each pair once, by its smallest key, and no pair is shuffled."""
    monkeypatch.setattr(resolve, "BLOCK", 3)
    r = random.Random(1)
    data = [(i, r.choice("abcd") + r.choice(("", " .", "-"))) for i in range(40) for _ in range(2)] + [(None, "a"), (7, None), (8, " ")]
    keys = {}
    for i, form in data:
        if i is not None and form and form.strip():
            keys.setdefault(i, set()).add(form[0])
    want = [(a, b, min(keys[a] & keys[b])) for a, b in combinations(sorted(keys), 2) if keys[a] & keys[b]]
    got = resolve.pairs_same_form(spark.createDataFrame(data, "id long, form string"))
    assert rows(got) == sorted(want, key=repr)
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_large_keys_are_sent_to_few_tiles(spark, monkeypatch):
    """Blocks of a large key grow before their number does; the pairs are the same."""
    d = spark.createDataFrame([(n,) for n in (2, 512, 513, 8192, 112_000, 1_000_000)], "n long")
    assert [x[0] for x in d.select(resolve.blocks(F.col("n"))).collect()] == [1, 1, 2, 16, 16, 123]
    monkeypatch.setattr(resolve, "BLOCK", 3)
    got = resolve.pairs_same_form(spark.range(900).select("id", F.when(F.col("id") < 850, "x").otherwise("y").alias("form")))
    n = 850 * 849 // 2 + 50 * 49 // 2
    assert got.where("a < b").distinct().count() == got.count() == n


def test_queue_of_best_pairs(spark):
    """The best pairs that are not queued yet, however many of the best ones are; the pairs are not shuffled."""
    same = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1000).alias("b"))
    similar = spark.createDataFrame([(1000, 0, 0.5), (5, 6, 0.99), (6, 5, 0.98), (7, 8, 0.3)], "a long, b long, score double")
    tasks = same.where("a < 390").select(expr.payload_hash(F.concat_ws(",", "a", "b")).alias("input_hash"), F.lit("pending").alias("status"))
    left = lambda most: [(r.a, r.b, r.score, r.priority) for r in resolve.enqueue_candidates(same, similar, tasks, most).collect()]
    best = [(a, a + 1000, 1.0, 100) for a in range(390, 400)] + [(5, 6, 0.99, 99), (7, 8, 0.3, 30)]
    assert left(3) == best[:3] and left(11) == best[:11] and left(50) == best


def test_first_pairs_are_the_first_of_all(spark):
    """Ids of several keys, keys of all sizes and a condition on the first id, against the sorted list of all pairs."""
    r = random.Random(4)
    data = [(i, r.choice("aaaaabcdefg") + r.choice(("", " .", "-"))) for i in range(60) for _ in range(2)] + [(None, "a"), (7, None), (8, " "), (200, "z"), (300, "y"), (400, "y")]
    forms = spark.createDataFrame(data, "id long, form string")
    every = sorted(tuple(x) for x in resolve.pairs_same_form(forms).collect())
    for most in (1, 5, 70, 400, 10_000):
        for begin, keep in (("true", lambda a: True), ("id % 10 = 0", lambda a: a % 10 == 0)):
            want = [x for x in every if keep(x[0])][:most]
            assert [tuple(x) for x in resolve.first_pairs_same_form(forms, most, begin).collect()] == want
    assert resolve.first_pairs_same_form(forms.where("id > 400"), 5).collect() == []


def test_queue_without_all_pairs(spark):
    """A form of 60,000 ids has 1.8e9 pairs; the best come without the others."""
    forms = spark.range(60_000).select("id", F.lit("x").alias("form"))
    queued = lambda pairs: pairs.where("b < 3000").select("input_hash", F.lit("pending").alias("status"))
    got = resolve.enqueue_candidates(lambda n: resolve.first_pairs_same_form(forms, n), lambda n: resolve.first_pairs_same_form(forms, n, "id > 9").select("a", "b", F.lit(0.5).alias("score")), queued, 1500)
    assert [(x.a, x.b, x.score) for x in got.collect()] == [(0, b, 1.0) for b in range(3000, 4500)]
