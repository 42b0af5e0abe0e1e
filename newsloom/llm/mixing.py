"""Mixing sources to target weights by Pareto order sampling.

A source's target over its size is the number of times each of its documents is wanted. The whole part is
allocated as certain copies. For the words still wanted, a document's inclusion probability is in proportion to its
size, and 1 at most; those with 1 are certain too. Documents are ranked by random odds over inclusion odds,
(u / (1 - u)) / (p / (1 - p)), and a fixed number of the lowest are taken.

So that words come near the target and not only the number of documents, samples are drawn by levels of size, the
largest documents first: what a level took more or less than wanted is taken off or added to the next one, whose
documents are a quarter as long. A level's number is its sum of probabilities, rounded up or down at random.
A source of more than `UNIT` documents is dealt by random numbers into units with a share of the target each, so that no source is
drawn in one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.llm.quality import split_words
from newsloom.llm.util import materialize, own_names, ship

#: Documents in a unit, about.
UNIT = 50_000
#: Words of a document from which the levels begin, smallest level first; documents without words are in none.
LEVELS = (1, 8, 32, 128, 512, 2048, 8192)


def uniform(key: Column, seed: str) -> Column:
    """52 random bits as a long, the same in every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key)), 1, 13), 16, 10).cast("long")


def in_order(df: DataFrame, name: str, *key: Column) -> DataFrame:
    """df with its rows numbered from 0 in order of key: inside range partitions, with the counts of those before added."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = materialize(df.repartitionByRange(n, *key).withColumn("_p", F.spark_partition_id()), "part")
    before, low = [], 0
    for r in sorted(part.groupBy("_p").count().collect()):  # one row per partition
        before.append((r["_p"], low))
        low += r["count"]
    first = df.sparkSession.createDataFrame(before, "_p int, _low long")
    row = F.row_number().over(W.partitionBy("_p").orderBy(*key))
    return part.withColumn("_n", row).join(first, "_p").withColumn(name, F.col("_low") + F.col("_n") - 1).drop("_p", "_low", "_n")


def targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """(source, source_size, n, target): words shared by weight, at most cap times the source's size, the excess reshared."""
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_r") % len(weights) + 1).cast("int"))
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    by = materialize(in_order(by, "_r", F.col("source").isNull(), F.col("source")).withColumn("_w", weight), "sources")
    total = by.agg(F.sum("source_size")).first()[0] or 0
    level, above = 0.0, -1.0
    while True:  # each round caps one source at least; the level only rises
        full = F.col("_w") * F.lit(level) > cap * F.col("source_size")
        capped, free = by.agg(F.sum(F.when(full, cap * F.col("source_size")).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("_w")))).first()
        if not free:
            break
        above, level = level, (total - capped) / free
        if level == above:
            break
    wanted = F.col("_w") * F.lit(level)
    return by.select("source", "source_size", "n", F.least(wanted, (cap * F.col("source_size")).cast("double")).alias("target"))


def inclusion(size: np.ndarray, words: float) -> np.ndarray:
    """Probabilities in proportion to size, 1 at most, whose expected words are `words` (all of them, if there are no more)."""
    order = np.argsort(-size, kind="stable")
    s = size[order].astype(float)
    before = np.cumsum(s) - s
    rest = np.cumsum((s * s)[::-1])[::-1]
    rate = (words - before) / rest
    part = np.flatnonzero(rate * s < 1)
    out = np.ones(len(s))
    if len(part):
        at = part[0]
        out[order[at:]] = np.maximum(rate[at], 0) * s[at:]
    return out


def pareto(size: np.ndarray, u: np.ndarray, tie: np.ndarray, words: float, toss) -> np.ndarray:
    """Which documents of one unit are drawn, so that their words come near `words`. toss(level): a random number for each level.

    Documents longer than `words` are never drawn.
    """
    taken = np.zeros(len(size), bool)
    fit = np.flatnonzero((size > 0) & (size <= words))
    first = inclusion(size[fit], words) * size[fit]
    level = np.searchsorted(LEVELS, size[fit], "right") - 1
    carry = 0.0
    for k in range(len(LEVELS) - 1, -1, -1):
        here = fit[level == k]
        if not len(here):
            continue
        want = float(np.cumsum(first[level == k])[-1]) + carry
        p = inclusion(size[here], want)
        n = int(np.floor(np.cumsum(p)[-1] + toss(k)))
        with np.errstate(divide="ignore"):
            rank = np.where(p < 1, u[here] / (1 - u[here]) * ((1 - p) / p), 0)
        drawn = here[np.lexsort((tie[here], rank))[:n]]
        taken[drawn] = True
        carry = want - float(size[drawn].sum())
    return taken


def _draw(t: pa.Table, seed: str) -> pa.Table:
    """Extra copies of the documents of some units."""
    source, unit = t.column("source").to_pylist(), t.column("unit").to_numpy()
    number: dict[tuple, int] = {}
    which = np.fromiter((number.setdefault(x, len(number)) for x in zip(source, unit.tolist(), strict=True)), np.int64, len(unit))
    size, u, tie = t.column("size").to_numpy(), (t.column("u").to_numpy() + 0.5) / 2.0**52, t.column("tie").to_numpy()
    need = t.column("need").to_numpy()
    extra = np.zeros(len(unit), np.int32)
    order = np.argsort(which, kind="stable")
    for (name, k), rows in zip(number, np.split(order, np.cumsum(np.bincount(which, minlength=len(number)))[:-1]), strict=True):
        toss = lambda level: (int(hashlib.md5(f"{seed}:{name or ''}:{k}:{level}".encode()).hexdigest()[:13], 16) + 0.5) / 2.0**52  # noqa: B023, E731
        words = need[rows[0]] * float(size[rows].sum())
        extra[rows] = pareto(size[rows], u[rows], tie[rows], words, toss)
    copies = t.column("whole").to_numpy() + extra
    names = ["doc_id", "source", "size", "source_size", "target"]
    return pa.table([*[t.column(n) for n in names], pa.array(copies), pa.array(copies * size)], [*names, "copies", "taken"])


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, copies (int), taken: how often each row is taken.

    Null texts have size 0, a null source is the last source. Each input row is drawn by itself; a
    row's random number follows from its doc_id, or without one from its text. Documents longer than the words
    that the whole copies leave wanted are never drawn for them. An empty table gives an empty result. Other columns are ignored.
    """
    ship(docs.sparkSession)
    n_words = F.size(split_words(F.col("text"))).cast("long")
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("none "), F.md5(F.coalesce("text", F.lit("")))))
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words.alias("size"), uniform(key, seed).alias("u"), F.xxhash64("doc_id", "text").alias("tie"))
    sized = materialize(sized, "sized")
    by = targets(sized, weights, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    by = by.withColumn("whole", whole).withColumn("units", F.ceil(F.col("n") / UNIT))
    by = by.withColumn("need", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") - F.col("whole")).otherwise(0.0)).drop("n")
    by = materialize(by.withColumnRenamed("source", "_s"), "targets")
    all_ = sized.join(by, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("unit", F.col("u") % F.col("units")).drop("units")
    # a hot source's join can be split, as its rows go to a table
    all_ = materialize(all_, "drawn")
    bins = max(1, -(-all_.count() // UNIT))

    def draw(rows: pa.Table) -> pa.Table:
        return _draw(rows, seed)

    kind = "doc_id " + docs.schema["doc_id"].dataType.simpleString() + ", source string, size long, source_size long, target double, copies int, taken long"
    return all_.groupBy(F.pmod(F.xxhash64("source", "unit"), F.lit(bins)).alias("_bin")).applyInArrow(draw, kind)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs, each row as often as the mix takes it; columns unchanged, whatever the names of others than doc_id, text and source."""
    own, name = own_names(docs)
    key = [F.col(name[c]) for c in ("doc_id", "text", "source")]
    marked = own.select("*", F.xxhash64(*key).alias("_k"), F.xxhash64(F.lit("more"), *key).alias("_m"))  # together an identity
    one_id = F.concat_ws(" ", F.coalesce(F.col(name["doc_id"]).cast("string"), F.lit("none")), "_k", "_m")
    found = mix(marked.select(one_id.alias("doc_id"), key[1].alias("text"), key[2].alias("source")), **options)
    part = F.split("doc_id", " ")
    found = found.where("copies > 0").groupBy(part[1].cast("long").alias("_k"), part[2].cast("long").alias("_m")).agg(F.sum("copies").cast("int").alias("_n"))
    one = marked.dropDuplicates(["_k", "_m"])
    out = one.join(found, ["_k", "_m"]).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return out.select(*[F.col(n).alias(c) for c, n in name.items()])


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


def _inclusion_sql(name: str, rows: str, words: str, by: str) -> str:
    """A CTE `name`: rows with p, the inclusion probabilities for `words` in each group `by`."""
    return f"""
{name}_o AS (SELECT *, ({words} - (sum(size) OVER w - size)) / sum(size * size) OVER (PARTITION BY {by} ORDER BY size, doc_id DESC ROWS UNBOUNDED PRECEDING) AS rate, row_number() OVER w AS pos
  FROM {rows} WINDOW w AS (PARTITION BY {by} ORDER BY size DESC, doc_id ROWS UNBOUNDED PRECEDING)),
{name}_f AS (SELECT {by}, min(pos) AS first, arg_min(rate, pos) AS rate FROM {name}_o WHERE rate * size < 1 GROUP BY {by}),
{name} AS (SELECT o.* EXCLUDE (rate, pos), CASE WHEN o.pos < coalesce(f.first, o.pos + 1) THEN 1.0 ELSE greatest(f.rate, 0) * size END AS p
  FROM {name}_o o LEFT JOIN {name}_f f ON o.source IS NOT DISTINCT FROM f.source AND o.unit = f.unit)"""


def _level_sql(k: int) -> str:
    """CTEs that draw level k, given the carry of the level above, c{k + 1}: the words drawn, t{k}, and the carry, c{k}."""
    low, high = LEVELS[k], LEVELS[k + 1] if k + 1 < len(LEVELS) else 2**62
    same = "x.source IS NOT DISTINCT FROM y.source AND x.unit = y.unit"
    return f""",
w{k} AS (SELECT source, unit, sum(p * size) AS share FROM p0 WHERE size >= {low} AND size < {high} GROUP BY source, unit),
v{k} AS (SELECT x.source, x.unit, share + coalesce(y.carry, 0) AS want FROM w{k} x LEFT JOIN c{k + 1} y ON {same}),
l{k} AS (SELECT x.* EXCLUDE (p), y.want FROM p0 x JOIN v{k} y ON {same} WHERE size >= {low} AND size < {high}),{_inclusion_sql(f"p{k + 1}_", f"l{k}", "want", "source, unit")},
n{k} AS (SELECT source, unit, floor(sum(p) + (('0x' || substr(md5('mix:' || coalesce(source, '') || ':' || unit || ':{k}'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) AS n FROM p{k + 1}_ GROUP BY source, unit),
r{k} AS (SELECT *, row_number() OVER (PARTITION BY source, unit ORDER BY CASE WHEN p < 1 THEN u / (1 - u) * ((1 - p) / p) ELSE 0 END, doc_id) AS pos FROM p{k + 1}_),
t{k} AS (SELECT x.source, x.unit, doc_id, size, want FROM r{k} x JOIN n{k} y ON {same} WHERE pos <= n),
g{k} AS (SELECT source, unit, sum(size) AS got FROM t{k} GROUP BY source, unit),
c{k} AS (SELECT x.source, x.unit, want - coalesce(got, 0) AS carry FROM v{k} x LEFT JOIN g{k} y ON {same} UNION ALL SELECT * FROM c{k + 1} x WHERE NOT EXISTS (FROM v{k} y WHERE {same}))"""


OP6_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'none ' || md5(coalesce(text, '')))), 1, 13))::BIGINT AS bits
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n,
        [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY source),
lv AS (
  SELECT 0 AS i, 0::DOUBLE AS level, -1::DOUBLE AS above
  UNION ALL
  SELECT i + 1, (SELECT (sum(source_size) - sum(CASE WHEN w * lv.level > 3 * source_size THEN 3 * source_size ELSE 0 END))::DOUBLE
                   / sum(CASE WHEN w * lv.level > 3 * source_size THEN 0 ELSE w END) FROM s), level
  FROM lv WHERE level <> above AND i < 200),
t AS (SELECT source, source_size, n, least(w * (SELECT max_by(level, i) FROM lv), (3 * source_size)::DOUBLE) AS target FROM s),
n AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole, ceil(n / {UNIT})::BIGINT AS units FROM t),
m AS (SELECT d.*, source_size, target, whole, CASE WHEN source_size > 0 THEN target / source_size - whole ELSE 0 END AS need,
        bits % units AS unit, (bits + 0.5) / 4503599627370496.0 AS u FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source),
q AS (SELECT *, need * sum(size) OVER (PARTITION BY source, unit) AS words FROM m),
fit AS (SELECT doc_id, source, unit, size, u, words FROM q WHERE size > 0 AND size <= words),{_inclusion_sql("p0", "fit", "words", "source, unit")},
c{len(LEVELS)} AS (SELECT source, unit, 0.0::DOUBLE AS carry FROM q WHERE false){"".join(_level_sql(k) for k in range(len(LEVELS) - 1, -1, -1))},
x AS ({" UNION ALL ".join(f"SELECT doc_id FROM t{k}" for k in range(len(LEVELS)))})
SELECT q.doc_id, size, source_size, target, (size * (whole + CASE WHEN x.doc_id IS NULL THEN 0 ELSE 1 END))::BIGINT AS taken
FROM q LEFT JOIN x USING (doc_id)
"""
