"""Merkle manifest of a dataset: 16-ary hash trees per source, under one root, with proofs.

Only every second level of a tree is stored. A stored node and its stored descendants two levels below
are an aligned subtree of at most 256 digests: the level between them is hashed again where a proof
needs it, its siblings are given out, and it is dropped. Trees are built from the leaves up and proofs
go from the root down, one shuffle each per stored level; a row never holds more than one subtree and the path above it.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import partial, reduce
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.llm.util import arrow_map, materialize, table

FAN, EVERY = 16, 2
SUBTREE = FAN**EVERY
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<l:string,r:string>>"
_NODE = pa.struct([("l", pa.string()), ("r", pa.string())])


def leaf(fields: dict[str, Column]) -> Column:
    """SHA-256 of the fields, each as its UTF-8 byte count, a colon and its text, or `-` if null."""
    text = [c.cast("string") for c in fields.values()]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text]), 256)


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(source, doc_id, leaf, other): other is the leaf with A-Z of the text in lower case where `tampered` holds, else null."""
    f = {c: F.col(c) for c in FIELDS}
    low = f | {"text": F.translate(F.col("text").cast("string"), string.ascii_uppercase, string.ascii_lowercase)}
    other = F.when(tampered, leaf(low)) if tampered is not None else F.lit(None)
    return docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), leaf(f).alias("leaf"), other.cast("string").alias("other"))


def _count(batches: Iterator[pa.RecordBatch], group: str | None) -> Iterator[pa.RecordBatch]:
    """Number the rows of each group inside a sorted partition."""
    last, n, part = (), -1, TaskContext.get().partitionId()
    for b in batches:
        keys = b.column(group).to_pylist() if group else [None] * b.num_rows
        at = []
        for k in keys:
            n = n + 1 if (k,) == last else 0
            last = (k,)
            at.append(n)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int64())], [*b.schema.names, "part", "at"])


def numbered(rows: DataFrame, group: str | None, *order: str) -> tuple[DataFrame, DataFrame]:
    """(rows with part and at, first(group, part, first, n)): first + at is a row's number in its group, n the group's size.

    Rows are dealt by range, so a group of any size is many tasks; only a count per group and range is added up.
    """
    keys = [*([group] if group else []), *order]
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", part int, at long"
    dealt = materialize(arrow_map(rows.repartitionByRange(*keys).sortWithinPartitions(*keys), partial(_count, group=group), kind), "numbered")
    by = F.col(group) if group else F.lit(0)
    size = dealt.groupBy(by.alias("g"), "part").agg(F.count("*").alias("m"))
    w = W.partitionBy("g")
    before = F.coalesce(F.sum("m").over(w.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return dealt, materialize(size.select("g", "part", before.alias("first"), F.sum("m").over(w).alias("n")), "first")


def height(n: Column) -> Column:
    """How often n nodes must be hashed in runs of FAN until one is left."""
    return reduce(lambda a, b: a + b, [(n > FAN**k).cast("int") for k in range(15)])


def raised(digests: list[str]) -> list[str]:
    """The next level: the SHA-256 of every run of FAN digests."""
    return [sha256("".join(digests[i : i + FAN]).encode()).hexdigest() for i in range(0, len(digests), FAN)]


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        top = []
        for digests, steps in zip(b.column("digests").to_pylist(), b.column("steps").to_pylist(), strict=True):
            for _ in range(steps):
                digests = raised(digests)
            top.append(digests[0])
        yield pa.RecordBatch.from_arrays([b.column("tree"), b.column("at"), pa.array(top, pa.string()), b.column("n")], ["tree", "at", "digest", "n"])


def _subtrees(level: DataFrame, depth: int, *extra: str) -> DataFrame:
    """One row per aligned subtree: its digests in order, and how many levels its top is above them."""
    item = F.struct("at", "digest", *extra)
    steps = F.least(F.lit(EVERY), height(F.col("n")) - depth)
    got = level.groupBy("tree", F.expr(f"at div {SUBTREE}").alias("up"), "n").agg(F.array_sort(F.collect_list(item)).alias("items"))  # at most SUBTREE items
    return got.select("tree", F.col("up").alias("at"), "n", steps.alias("steps"), F.col("items.digest").alias("digests"), *[F.col(f"items.{e}").alias(e) for e in extra])


def stored_levels(nodes: DataFrame) -> list[DataFrame]:
    """Levels 0, 2, 4, ... of all trees of nodes(tree, at, digest, n); a tree's root is the one node of its last level."""
    largest = nodes.agg(F.max("n")).first()[0] or 1
    levels, depth = [nodes], 0
    while FAN**depth < largest:
        below = levels[-1].where(height(F.col("n")) > depth)
        levels.append(materialize(arrow_map(_subtrees(below, depth).select("tree", "at", "digests", "n", "steps"), _tops, "tree long, at long, digest string, n long"), "level"))
        depth += EVERY
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """(tree, digest): each tree's root."""
    last = [t.where((height(F.col("n")) <= k * EVERY) & (height(F.col("n")) > (k - 1) * EVERY)) for k, t in enumerate(levels)]
    return reduce(DataFrame.union, [t.select("tree", "digest") for t in last])


def steps_of(digests: list[str], steps: int) -> list[list[tuple[str, str]]]:
    """Per digest of a subtree, its siblings to the left and to the right on each of `steps` levels; the levels between are made here and dropped."""
    out, level = [[] for _ in digests], digests
    for k in range(steps):
        near = []
        for i in range(len(level)):
            run = i - i % FAN
            near.append(("".join(level[run:i]), "".join(level[i + 1 : run + FAN])))
        for i, path in enumerate(out):
            path.append(near[i // FAN**k])
        level = raised(level)
    return out


def folded(digest: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        digest = sha256((left + digest + right).encode()).hexdigest()
    return digest


def _down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The paths of a subtree's digests."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 16):
            cols = {c: batch.slice(lo, 16).column(c).to_pylist() for c in ("tree", "at", "digests", "steps", "path")}
            tree, at, path = [], [], []
            for t, a, digests, steps, above in zip(*cols.values(), strict=True):
                above = [(p["l"], p["r"]) for p in above]
                for i, own in enumerate(steps_of(digests, steps)):
                    tree.append(t)
                    at.append(a * SUBTREE + i)
                    path.append([{"l": x, "r": y} for x, y in own + above])
            yield pa.RecordBatch.from_arrays([pa.array(tree, pa.int64()), pa.array(at, pa.int64()), pa.array(path, pa.list_(_NODE))], ["tree", "at", "path"])


def _proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per leaf: the digest of its siblings, and the root that its own or its other leaf leads to."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            cols = {c: batch.slice(lo, 64).column(c).to_pylist() for c in ("digests", "doc_id", "other", "steps", "path", "top")}
            out = {c: [] for c in ("doc_id", "leaf", "subroot", "proof_sha256", "folded_root")}
            for digests, ids, other, steps, above, top in zip(*cols.values(), strict=True):
                above = [(p["l"], p["r"]) for p in above]
                rest = "".join(x + y for x, y in above).encode()
                for i, own in enumerate(steps_of(digests, steps)):
                    out["doc_id"].append(ids[i])
                    out["leaf"].append(digests[i])
                    out["subroot"].append(top)
                    out["proof_sha256"].append(sha256("".join(x + y for x, y in own).encode() + rest).hexdigest())
                    out["folded_root"].append(folded(other[i] or digests[i], own + above))
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if k == "doc_id" else pa.string()) for k, v in out.items()], list(out))


def paths(levels: list[DataFrame], above: DataFrame, down: int = 0) -> DataFrame:
    """(tree, at, path) of the nodes of level `down`, from above(tree, path) of the trees' roots."""
    got = None
    for k in range(len(levels) - 1, down - 1, -1):
        tip = levels[k].where((height(F.col("n")) <= k * EVERY) & (height(F.col("n")) > (k - 1) * EVERY)).join(above, "tree").select("tree", "at", "path")
        if got is not None:
            under = _subtrees(levels[k].where(height(F.col("n")) > k * EVERY), k * EVERY).join(got, ["tree", "at"])
            tip = tip.union(arrow_map(under.select("tree", "at", "digests", "steps", "path"), _down, f"tree long, at long, path {PATH}"))
        got = materialize(tip, "paths")
    return got


class Manifest:
    """The stored levels of all sources' trees and of the tree over their roots.

    leaves(tree, at, digest, n, doc_id, other) are numbered by source (null first, bytewise) and doc_id (null first;
    leaves of one doc_id by digest). `root` is None for an empty table.
    """

    def __init__(self, rows: DataFrame):
        dealt, first = numbered(rows, "source", "doc_id", "leaf")
        names, start = numbered(first.select(F.col("g").alias("source")).distinct(), None, "source")
        trees = materialize(names.join(start, "part").select("source", (F.col("first") + F.col("at")).alias("tree")), "trees")
        known = materialize(first.join(trees, F.col("g").eqNullSafe(F.col("source"))).select("g", "part", "first", "n", "tree"), "places")
        placed = dealt.join(known.withColumnRenamed("part", "_part"), F.col("source").eqNullSafe(F.col("g")) & (F.col("part") == F.col("_part")))
        placed = placed.select("tree", (F.col("first") + F.col("at")).alias("at"), F.col("leaf").alias("digest"), "n", "doc_id", "other")
        self.leaves = materialize(placed, "leaves")
        self.levels = [self.leaves, *stored_levels(self.leaves.select("tree", "at", "digest", "n"))[1:]]
        self.subroots = materialize(tops([self.leaves.select("tree", "at", "digest", "n"), *self.levels[1:]]), "subroots")
        over = self.subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), "digest", F.lit(trees.count()).cast("long").alias("n"))
        self.over = stored_levels(materialize(over, "over"))
        top = self.over[-1].first()
        self.root = top["digest"] if top else None

    def proofs(self) -> DataFrame:
        """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every leaf."""
        spark = self.leaves.sparkSession
        start = spark.range(1).select(F.col("id").alias("tree"), F.array().cast(PATH).alias("path"))
        above = materialize(paths(self.over, start).select(F.col("at").alias("tree"), "path"), "above")
        top = self.subroots.withColumnRenamed("digest", "top")
        low = _subtrees(self.leaves, 0, "doc_id", "other").join(top, "tree")
        # A subtree's path: that of its stored top, or of the source's root where the source is no larger than the subtree.
        whole = paths([self.leaves.select("tree", "at", "digest", "n"), *self.levels[1:]], above, 1) if len(self.levels) > 1 else None
        single = low.where("n = 1").join(above, "tree")
        both = single if whole is None else single.unionByName(low.where("n > 1").join(whole, ["tree", "at"]))
        kind = "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string"
        got = arrow_map(both.select("digests", "doc_id", "other", "steps", "path", "top"), _proofs, kind)
        root = F.lit(self.root).cast("string")
        return got.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def tampered() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def op12_manifest(spark, sf_dir: str) -> DataFrame:
    return Manifest(leaves(table(spark, sf_dir, "documents"), tampered())).proofs()


#: CRC-32 of the decimal doc_id, a byte and then a bit at a time; levels and folding by recursion. Source trees are 0, 1, ..., the tree over them is -1.
OP12_SQL = r"""
WITH RECURSIVE part AS (
  SELECT doc_id, source, text, lang, n_chars,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT),
      lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))) % 5 = 0 AS tampered FROM documents),
doc AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN tampered THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS other FROM part),
tree AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, n FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)),
leaves AS (
  SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, n, doc_id, leaf, other
  FROM doc JOIN tree ON doc.source IS NOT DISTINCT FROM tree.source),
low AS (
  SELECT 0 AS lvl, tree, pos, leaf AS digest, n FROM leaves
  UNION ALL SELECT any_value(lvl) + 1, tree, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 15) // 16 FROM low WHERE n > 1 GROUP BY tree, pos // 16),
high AS (
  SELECT 0 AS lvl, -1::BIGINT AS tree, tree AS pos, digest, (SELECT count(*) FROM tree) AS n FROM low WHERE n = 1
  UNION ALL SELECT any_value(lvl) + 1, tree, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 15) // 16 FROM high WHERE n > 1 GROUP BY tree, pos // 16),
node AS (SELECT * FROM low UNION ALL SELECT * FROM high),
step AS (
  SELECT lvl, tree, pos, n = 1 AS top,
    coalesce(string_agg(digest, '') OVER (PARTITION BY tree, lvl, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(digest, '') OVER (PARTITION BY tree, lvl, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM node),
walk AS (
  SELECT tree AS home, pos AS seat, 0 AS lvl, tree, pos, coalesce(other, leaf) AS digest, '' AS proof, false AS fin FROM leaves
  UNION ALL
  SELECT home, seat, CASE WHEN top THEN 0 ELSE walk.lvl + 1 END, CASE WHEN top THEN -1 ELSE walk.tree END, CASE WHEN top THEN walk.tree ELSE walk.pos // 16 END,
    CASE WHEN top THEN digest ELSE sha256(l || digest || r) END, proof || l || r, top AND walk.tree = -1
  FROM walk JOIN step ON walk.lvl = step.lvl AND walk.tree = step.tree AND walk.pos = step.pos WHERE NOT fin)
SELECT doc_id, leaf, low.digest AS subroot, high.digest AS root, sha256(proof) AS proof_sha256, walk.digest AS folded_root, walk.digest = high.digest AS verified
FROM leaves JOIN walk ON leaves.tree = home AND leaves.pos = seat AND fin JOIN low ON low.tree = leaves.tree AND low.n = 1 JOIN high ON high.n = 1
"""
