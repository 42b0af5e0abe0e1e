"""Embedding whitening: against numpy and exact fractions, and the input's edges."""

from fractions import Fraction

import numpy as np
import pytest
from newsloom.llm import queries, whitening
from tests_llm import DATA


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, x int, component int")


def test_query_against_numpy(spark):
    got = queries.QUERIES["op13_whitening"](spark, DATA).toPandas().sort_values(["vec_id", "component"])
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.floor(64 * np.array([r["embedding"] for r in rows], np.float64)).astype(np.int64) + 10**6
    n, s = len(x), x.sum(0)
    assert len(got) == 32 * n and (got["n"] == n).all()
    y = n * x - s
    assert (got["deviation"].to_numpy()[::32] == (y * y).sum(1)).all()
    v = (y / n).T @ (y / n) / n
    value, vector = np.linalg.eigh(v)
    assert np.allclose(got["explained"].to_numpy()[:32], value[::-1][:32] / np.trace(v), rtol=1e-9)
    z = got["whitened"].to_numpy().reshape(n, 32)
    want = (y / n) @ vector[:, ::-1][:, :32] / np.sqrt(value[::-1][:32])
    assert np.allclose(np.abs(z), np.abs(want), atol=1e-6)
    assert np.abs(np.cov(z.T, bias=True) - np.eye(32)).max() < 1e-9 and got["identity_error"].max() < 1e-9


@pytest.mark.parametrize("top", [2, 2**20, 2**36, 2**50])
def test_square_sums_are_exact(top):
    v = np.random.default_rng(1).integers(-top, top, (500, 7))
    assert whitening.square_sums(v).tolist() == [sum(int(c) ** 2 for c in v[:, j]) for j in range(7)]
    assert whitening.square_sums(v, 1).tolist() == [sum(int(c) ** 2 for c in r) for r in v]


def test_polarisation_is_exact(spark):
    r = np.random.default_rng(2)
    vectors = [[float(c) for c in r.choice([-3e4, 1e-3, 7.5, 2e9], 5)] for _ in range(40)]
    x = whitening.integers(table(spark, vectors))
    got = [[int(c) for c in row["x"]] for row in x.orderBy("vec_id").collect()]
    w = whitening.fit(x)
    n, s = len(got), [sum(c) for c in zip(*got, strict=True)]
    exact = [[sum((Fraction(a[i]) - Fraction(s[i], n)) * (Fraction(a[j]) - Fraction(s[j], n)) for a in got) / n for j in range(5)] for i in range(5)]
    assert w.s == s and w.trace == pytest.approx(float(sum(exact[i][i] for i in range(5))), rel=1e-14)
    dev = {q["vec_id"]: q["deviation"] for q in whitening.whiten(x, w).collect()}
    for i, a in enumerate(got):
        assert dev[i] == min(sum((n * c - t) ** 2 for c, t in zip(a, s, strict=True)), 2**63 - 1)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    d = table(spark, [[1.0, 2.0], None, [1.0, None], [nan, 1.0], [inf, 1.0], [], [3.0, -1.0], [3.0, -1.0], [1.0, 2.0, 3.0], [0.5, 1e30]])
    x = whitening.integers(d)
    assert {r["vec_id"] for r in x.collect()} == {0, 6, 7, 9}
    w = whitening.fit(x)
    out = whitening.whiten(x, w).collect()
    assert len(out) == 8 and all(r["whitened"] is not None or r["explained"] < 1e-9 for r in out)
    flat = whitening.integers(table(spark, [[1.0, 2.0]] * 3))
    w = whitening.fit(flat)
    assert {(r["whitened"], r["explained"], r["deviation"]) for r in whitening.whiten(flat, w).collect()} == {(None, 0.0, 0)}
    assert whitening.identity_error(flat, w) is None
    none = whitening.integers(d.limit(0))
    assert whitening.fit(none) is None and whitening.whiten(none, None).count() == 0
    one = whitening.integers(table(spark, [[float(k == j) for j in range(40)] for k in range(80)]))
    assert whitening.whiten(one, whitening.fit(one)).count() == 80 * 32


def test_rows_without_an_id_count(spark):
    d = spark.createDataFrame([(None, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    x = whitening.integers(d)
    out = whitening.whiten(x, whitening.fit(x)).collect()
    assert sorted(str(r["vec_id"]) for r in out) == ["1"] * 4 + ["None"] * 2 and {r["n"] for r in out} == {3}
