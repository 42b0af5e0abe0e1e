"""Exact top-k inner-product search by tiled matrix products.

Queries and rows are cut into blocks. Each pair of a query block and a shard is one tile: one matrix
product, a partial selection of every query's best, at most k rows each. Lists are then merged in
rounds of `fan` tiles until one list per query is left.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.llm.util import materialize, ship, table

#: Scores that a task holds at once, and bytes of a block of vectors.
SCORES, BLOCK = 1 << 22, 64 << 20
OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("shard", pa.int64())])


def matrix(t: pa.Table, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """ids and floor(scale * x), rows in order of id."""
    ids = t.column("vec_id").to_numpy()
    rows = t.column("embedding").combine_chunks()
    rows = rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows
    x = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
    order = np.argsort(ids, kind="stable")
    return ids[order], np.floor(scale * x)[order]


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles while every sum is below 2^53, else in Python integers. Those beyond a long become the nearest long."""
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if largest < 2.0**53:
        return (q @ x.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    out = whole(q) @ whole(x).T if q.shape[1] else np.zeros((len(q), len(x)), object)
    return np.clip(out, -(2**63), 2**63 - 1).astype(np.int64)


def best(score: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k highest that aren't its own, ties to the smaller column."""
    low = np.iinfo(np.int64).min
    score = np.where(own, low, score)
    if score.shape[1] > k:
        least = np.partition(score, score.shape[1] - k, axis=1)[:, -k]
        pick = (score >= least[:, None]) & ~own
    else:
        pick = ~own
    r, c = np.nonzero(pick)
    order = np.lexsort((c, -score[r, c], r))
    r, c = r[order], c[order]
    rank = np.arange(len(r)) - np.searchsorted(r, r)
    return r[rank < k], c[rank < k]


def _tile(queries: pa.Table, rows: pa.Table, k: int, scale: float) -> pa.Table:
    if not queries.num_rows or not rows.num_rows:
        return OUT.empty_table()
    qid, q = matrix(queries, scale)
    vid, x = matrix(rows, scale)
    out = []
    step = max(1, SCORES // len(vid))
    for lo in range(0, len(qid), step):
        s = products(q[lo : lo + step], x)
        r, c = best(s, qid[lo : lo + step, None] == vid[None, :], k)
        out.append((qid[lo + r], vid[c], s[r, c]))
    a, b, s = (np.concatenate(z) for z in zip(*out, strict=True))
    shard = rows.column("shard")[0].as_py()
    return pa.table([pa.array(a), pa.array(b), pa.array(s), pa.array(np.full(len(a), shard, np.int64))], schema=OUT)


def top_k(queries: DataFrame, rows: DataFrame, k: int = 10, scale: float = 1024.0, fan: int = 32) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best of rows(vec_id, embedding), all if there are fewer.

    Rows without an id, and vectors that are null, empty or hold a null or a non-finite component, take
    no part. Vectors are compared with vectors of their own length. Rows with the query's own id are
    never among its results; other repeated rows each count. Of query rows that repeat an id, the one with the smallest
    vector (component by component) is used. A score beyond a long is given, and ranked, as the nearest long.
    """
    ship(rows.sparkSession)
    whole = lambda d: d.select(F.col("vec_id").cast("long"), "embedding").where(
        F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ).withColumn("width", F.size("embedding"))
    q = materialize(whole(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("width", F.size("embedding")), "queries")
    x = materialize(whole(rows), "vectors")
    (n, wide), nq = x.agg(F.count("*"), F.max("width")).first(), q.count()
    most = max(1, BLOCK // (8 * (wide or 1)))
    each = min(most, max(512, math.ceil(n / 256)))
    shards, blocks = max(1, math.ceil(n / each)), max(1, math.ceil(nq / most))
    x = x.withColumn("shard", F.pmod(F.xxhash64(F.lit("row"), "vec_id"), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    q = q.withColumn("block", F.pmod(F.xxhash64(F.lit("query"), "vec_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    key = ["width", "block", "shard"]
    lists = q.groupBy(*key).cogroup(x.groupBy(*key)).applyInArrow(partial(_tile, k=k, scale=scale), "query_id long, vec_id long, score long, shard long")
    order = [F.desc("score"), "vec_id"]
    while shards > fan:
        shards = math.ceil(shards / fan)
        lists = lists.withColumn("shard", F.floor(F.col("shard") / fan))
        lists = lists.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "shard").orderBy(*order))).where(F.col("rank") <= k).drop("rank")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(*order))
    return lists.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op4_topk(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows.where("vec_id % 100 = 0"), rows)


OP4_SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * v.e[i]))::BIGINT AS score
      FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 10
"""
