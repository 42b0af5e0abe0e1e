"""Connected components by star contraction, in a logarithmic number of rounds.

In a round every node points to the neighbour with the smallest hash, unless its own is smaller. The
pointers are trees; pointer jumping turns them into stars, and every star becomes one node. Of the
nodes that still have a neighbour at most half are expected to be left, whatever the ids and
the shape of the graph, so the work of all rounds is about that of the first two. Labels then come
back down the rounds. Each hash serves two rounds: a hub that has found the smallest of its neighbours in the
first draws in all others in the second.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.shared import Scratch, settle


def _stars(edges: DataFrame, seed: int, scratch: Scratch) -> DataFrame:
    """(node, root) of all nodes of edges(a, b): the roots of the trees that the pointers make."""
    key = lambda c: F.struct(F.xxhash64(F.lit(seed), F.col(c)).alias("h"), F.col(c).alias("v"))
    both = edges.union(edges.select("b", "a"))
    near = both.groupBy("a").agg(F.min(key("b")).alias("m"))
    tree = scratch.settle(near.select(F.col("a").alias("node"), F.least("m", key("a"))["v"].alias("root")))
    while True:
        further = tree.select(F.col("node").alias("root"), F.col("root").alias("further"))
        new = scratch.settle(tree.join(further, "root").select("node", F.col("further").alias("root"), (F.col("root") != F.col("further")).alias("moved")))
        scratch.drop(tree)
        tree = new.select("node", "root")
        if not new.where("moved").limit(1).count():
            return new


def components(edges: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """(node, label) for the nodes of edges(a, b): label is the smallest node reachable.

    Loops and repeated edges change nothing; edges with a null end are ignored. Nodes may be of any type that has an
    order. If `rounds` is given, the number of edges of each round is appended to it.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    pairs = edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull())
    lone = scratch.settle(pairs.where("a = b").select(F.col("a").alias("node")).distinct())
    left = scratch.settle(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps: list[DataFrame] = []
    while n := left.count():
        if rounds is not None:
            rounds.append(n)
        star = _stars(left, len(maps) // 2, scratch)
        maps.append(star)
        ends = left.join(star.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(star.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        new = scratch.settle(ends.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        scratch.drop(left)
        left = new
    label = None
    for star in reversed(maps):
        own = star.select("node", "root")
        if label is not None:
            up = label.select(F.col("node").alias("root"), F.col("root").alias("top"))
            own = scratch.settle(own.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
            scratch.drop(star, label)
        label = own
    if label is None:
        out = settle(lone.select("node", F.col("node").alias("label")))
    else:
        least = label.groupBy("root").agg(F.min("node").alias("label"))
        own = lone.join(label, "node", "left_anti").select("node", F.col("node").alias("label"))
        out = settle(label.join(least, "root").select("node", "label").union(own))
    scratch.close()
    return out
