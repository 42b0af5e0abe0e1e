"""Embedding whitening from exact sums of squares (polarisation).

Vectors become integers, so that every sum is exact: with n rows and sums S, y = n * x - S is an integer
and centred. One pass adds up y_i^2 for every dimension and (y_i + y_j)^2 for every pair of dimensions;
2 * sum(y_i * y_j) is the difference of these. No product of two dimensions is ever formed. The
covariance matrix of d x d numbers goes to eigh on the driver; rows never leave their tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.util import arrow_map, materialize, table

#: Rows that a task squares at once.
ROWS = 8192
EXACT = "decimal(38,0)"
LONG = 2**63 - 1


@dataclass
class Whitening:
    """n rows with sums s; directions as columns with their variances, by falling variance; trace of the covariance."""

    n: int
    s: list[int]
    directions: np.ndarray
    variance: np.ndarray
    trace: float

    @property
    def varies(self) -> np.ndarray:
        """Which directions have a variance at all (more than rounding leaves of zero)."""
        return self.variance > len(self.s) * np.finfo(float).eps * max(self.trace, 0.0)


def integers(rows: DataFrame, scale: float = 64.0, shift: int = 1_000_000) -> DataFrame:
    """(vec_id, x): floor(scale * c) + shift of each component c; those beyond a long become the nearest that fit.

    Vectors that are null, empty or hold a null or non-finite component are left out, as are those of
    another length than most (of equally frequent lengths the larger one counts).
    """
    e = F.col("embedding")
    few = rows.select("vec_id", "embedding").where((F.size(e) > 0) & F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    limit = float(2**61)
    x = few.select("vec_id", F.transform(e, lambda c: F.floor(F.greatest(F.lit(-limit), F.least(F.lit(limit), c.cast("double") * scale))) + shift).alias("x"))
    x = materialize(x, "integers")
    length = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return x.where(F.size("x") == length["d"]) if length else x


def matrix(b: pa.RecordBatch) -> np.ndarray:
    return b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def _bits(a: np.ndarray) -> int:
    return max(int(a.max(initial=0)), -int(a.min(initial=0))).bit_length()


def centred(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n * x - s: in longs where they hold it, else in Python integers."""
    if _bits(x) + n.bit_length() < 62 and max(abs(v) for v in s).bit_length() < 62:
        return n * x - np.array(s, np.int64)
    return n * x.astype(object) - np.array(s, object)


def square_sums(v: np.ndarray, axis: int = 0) -> np.ndarray:
    """Exact sums of squares along an axis, as Python integers."""
    bits, more = _bits(v), v.shape[axis].bit_length()
    if v.dtype == object or bits + more > 60:
        return (v.astype(object) ** 2).sum(axis)
    if 2 * bits + more < 62:
        return (v * v).sum(axis).astype(object)
    half = (bits + 1) // 2
    if 2 * half + more >= 62:
        return (v.astype(object) ** 2).sum(axis)
    hi, lo = v >> half, v & ((1 << half) - 1)
    part = [(a * b).sum(axis).astype(object) for a, b in ((hi, hi), (hi, lo), (lo, lo))]
    return part[0] * (1 << 2 * half) + part[1] * (2 << half) + part[2]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: a row (i, sum of x_i), and the number of rows as i = -1."""
    n, total = 0, None
    for b in batches:
        if b.num_rows:
            n, x = n + b.num_rows, matrix(b)
            part = x.sum(0).astype(object) if _bits(x) + 14 < 62 and b.num_rows < 1 << 14 else x.astype(object).sum(0)
            total = part if total is None else total + part
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total)), pa.int32()), pa.array([Decimal(n), *map(Decimal, total)], pa.decimal128(38, 0))], ["i", "s"])


def _pairs(batches: Iterator[pa.RecordBatch], n: int, s: list[int]) -> Iterator[pa.RecordBatch]:
    """Per task and pair i < j: the sum of (y_i + y_j)^2; of y_i^2 where i = j."""
    d = len(s)
    total = [np.zeros(d - i, object) for i in range(d)]
    seen = False
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            y, seen = centred(matrix(batch.slice(lo, ROWS)), n, s), True
            for i in range(d):
                v = y[:, i:] + y[:, i : i + 1]
                v[:, 0] = y[:, i]
                total[i] = total[i] + square_sums(v)
    if seen:
        for i in range(d):
            q = pa.array([Decimal(int(t)) for t in total[i]], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d - i, i), pa.int32()), pa.array(np.arange(i, d), pa.int32()), q], ["i", "j", "q"])


def covariance(sums: np.ndarray, n: int) -> np.ndarray:
    """The covariance of x from the square sums of y: differences are taken exactly, then rounded once."""
    d = len(sums)
    out = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            twice = 2 * sums[i, i] if i == j else sums[i, j] - sums[i, i] - sums[j, j]
            out[i, j] = out[j, i] = twice / (2 * n**3)  # Python integers: correctly rounded
    return out


def fit(x: DataFrame, components: int = 32) -> Whitening | None:
    """The whitening of all rows of x(vec_id, x); None where there is none. d * (d + 1) / 2 numbers come to the driver."""
    whole = lambda r: {k: int(v) for k, v in r}
    first = whole(arrow_map(x.select("x"), _sums, f"i int, s {EXACT}").groupBy("i").agg(F.sum("s").cast(EXACT).alias("s")).collect())
    if not first:
        return None
    n = first.pop(-1)
    s = [first[i] for i in range(len(first))]
    rows = arrow_map(x.select("x"), partial(_pairs, n=n, s=s), f"i int, j int, q {EXACT}").groupBy("i", "j").agg(F.sum("q").cast(EXACT).alias("q")).collect()
    sums = np.zeros((len(s), len(s)), object)
    for i, j, q in rows:
        sums[i, j] = int(q)
    v = covariance(sums, n)
    value, vector = np.linalg.eigh(v)
    value, vector = value[::-1][:components], vector[:, ::-1][:, :components]
    sign = np.sign(vector[np.abs(vector).argmax(0), np.arange(vector.shape[1])])
    return Whitening(n, s, vector * np.where(sign == 0, 1, sign), value, float(np.trace(v)))


def projected(y: np.ndarray, w: Whitening) -> np.ndarray:
    """Whitened coordinates of centred rows; NaN in directions without variance."""
    scale = np.where(w.varies, 1 / np.sqrt(np.where(w.varies, w.variance, 1.0)), np.nan)
    return (y.astype(np.float64) / w.n) @ w.directions * scale


def _moments(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    w = model.value
    k = len(w.variance)
    one, two, seen = np.zeros(k), np.zeros((k, k)), False
    for b in batches:
        if b.num_rows:
            z, seen = np.nan_to_num(projected(centred(matrix(b), w.n, w.s), w)), True
            one, two = one + z.sum(0), two + z.T @ z
    if seen:
        i, j = np.divmod(np.arange(k * k), k)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.full(k, -1), i], pa.int32()), pa.array(np.r_[np.arange(k), j], pa.int32()), pa.array(np.r_[one, two.ravel()])], ["i", "j", "m"])


def identity_error(x: DataFrame, w: Whitening) -> float | None:
    """The largest entry of |covariance of the whitened rows - identity|, over the directions that vary; None if none does."""
    keep = np.flatnonzero(w.varies)
    if not len(keep):
        return None
    shared = x.sparkSession.sparkContext.broadcast(w)  # components * d numbers
    rows = arrow_map(x.select("x"), partial(_moments, model=shared), "i int, j int, m double").groupBy("i", "j").agg(F.sum("m").alias("m")).collect()
    k = len(w.variance)
    one, two = np.zeros(k), np.zeros((k, k))
    for i, j, m in rows:
        if i < 0:
            one[j] = m
        else:
            two[i, j] = m
    cov = two / w.n - np.outer(one, one) / w.n**2
    return float(np.abs(cov - np.eye(k))[np.ix_(keep, keep)].max())


def _whiten(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    w = model.value
    k = len(w.variance)
    explained = w.variance / w.trace if w.trace > 0 else np.zeros(k)
    for b in batches:
        if not b.num_rows:
            continue
        y = centred(matrix(b), w.n, w.s)
        z = projected(y, w).ravel()
        dev = np.array([min(int(v), LONG) for v in square_sums(y, 1)], np.int64)
        rows = np.repeat(np.arange(b.num_rows), k)
        yield pa.RecordBatch.from_arrays(
            [b.column("vec_id").take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1), b.num_rows), pa.int32()), pa.array(np.full(len(rows), w.n)), pa.array(dev[rows]),
             pa.array(z, mask=np.isnan(z)), pa.array(np.tile(np.maximum(explained, 0.0), b.num_rows))],
            ["vec_id", "component", "n", "deviation", "whitened", "explained"],
        )


def whiten(x: DataFrame, w: Whitening | None) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained): a row per row of x and component.

    whitened is null in directions without variance; a deviation beyond a long is the largest long.
    Repeated rows and rows without an id each count.
    """
    kind = f"vec_id {x.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double"
    if w is None:
        return x.sparkSession.createDataFrame([], kind)
    shared = x.sparkSession.sparkContext.broadcast(w)  # components * d numbers
    return arrow_map(x.select("vec_id", "x"), partial(_whiten, model=shared), kind)


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    x = integers(table(spark, sf_dir, "embeddings"))
    w = fit(x)
    return whiten(x, w).withColumn("identity_error", F.lit(identity_error(x, w) if w else None).cast("double"))
