"""Star contraction against union-find, on shapes that take label propagation long."""

import random

import pytest

from newsloom.operators.components import components


def union_find(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return {x: top(x) for x in list(up)}


def path(n, seed=1):
    ids = list(range(n))
    random.Random(seed).shuffle(ids)
    return list(zip(ids, ids[1:], strict=False))


SHAPES = {
    "shuffled path of 400": path(400),
    "path in order": [(i, i + 1) for i in range(3000)],
    "shuffled path of 5,000": path(5000),
    "star around the largest": [(i, 9999) for i in range(3000)],
    "two stars and a loop": [(i, 0) for i in range(1, 500)] + [(1000 + i, 2000) for i in range(500)] + [(5000, 5000), (1, 1)],
    "tree": [(i, i // 3) for i in range(1, 3000)],
    "random": [(r.randrange(3000), r.randrange(3000)) for r in [random.Random(4)] for _ in range(2500)],
    "repeated": [(1, 2), (2, 1), (1, 2), (3, 3)],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_against_union_find(spark, shape):
    edges = SHAPES[shape]
    rounds = []
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long"), rounds).collect()}
    assert got == union_find(edges)
    assert len(rounds) <= 14


def test_a_long_shuffled_path_takes_few_rounds(spark):
    n = 100_000
    order = spark.range(n).selectExpr("id as at", "id * 48271 % 100003 as x")  # ids in the order of a multiplicative generator
    edges = order.join(order.selectExpr("at - 1 as at", "x as y"), "at").selectExpr("x as a", "y as b")
    rounds = []
    got = components(edges, rounds)
    assert got.count() == n and got.where("label <> 0").count() == 0
    assert len(rounds) < 20 and rounds[2] < rounds[0] / 3


def test_text_nodes_nulls_and_nothing(spark):
    edges = [("b", "a"), ("c", "b"), (None, "a"), ("d", None), ("é", "ü")]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "é": "é", "ü": "é"}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
