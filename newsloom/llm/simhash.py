"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints within `budget` bits of each other agree on some `exact` of `blocks` groups of bits
(pigeonhole), so each distinct fingerprint is put into one trie per choice of groups, rooted at the
bits that must agree. Inside a trie, pairs of nodes are walked down together, differing bits are
summed, and a pair is pruned once the sum exceeds the budget. A trie of more than `most` leaves is
split again by the bits that vary inside it, so no task holds an unbounded group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.util import U, arrow_map, materialize, own_names
from newsloom.operators.components import components

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def text_fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the word shingles of one text; 0 without words."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    k = min(width, len(words))
    one = xxhash.xxh64_intdigest
    h = np.array([one(joined[a:b], seed) for a, b in zip((end - size).tolist(), end[k - 1 :].tolist(), strict=False)], U)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    if len(h) > 255:
        ones = sum(bits[i : i + 255].sum(0, dtype=np.uint8).astype(np.int64) for i in range(0, len(h), 255))
    else:
        ones = bits.sum(0, dtype=np.uint8).astype(np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int, seed: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.array([text_fingerprint(t, width, seed) for t in b.column("text").to_pylist()], U)
        yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(fp.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long. Null text counts as empty."""
    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), partial(_fingerprints, width=width, seed=seed), "doc_id long, fp long")


def choices(mask: int, blocks: int, exact: int) -> list[int]:
    """For each choice of `exact` of `blocks` groups of the mask's bits, the bits that must agree (as signed longs)."""
    on = [i for i in range(64) if mask >> i & 1]
    group = [sum(1 << i for i in on[b::blocks]) for b in range(blocks)]
    return [int(np.array(sum(c), U).view(np.int64)) for c in combinations(group, exact)]


def trie_links(values: np.ndarray, group: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that link every two values of one group within `budget` bits, directly or through others.

    values are sorted inside each group and groups are contiguous. All groups' tries are walked at
    once, from the top bit down; a node is a range of the sorted array. Node pairs too small to
    differ by more than what is left of the budget are linked as a star instead of pair by pair.
    """
    cut = np.flatnonzero(np.diff(group)) + 1
    lo, hi = np.r_[0, cut], np.r_[cut, len(values)]
    keep = hi - lo > 1
    return walk(values, (lo[keep], hi[keep]), (lo[keep], hi[keep]), budget)


def walk(values: np.ndarray, one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray], budget: int, every: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The walk over pairs of tries, each a range (begins, ends) of values: one's with other's, a range with itself or with one behind it.

    With `every`, all index pairs i < j within `budget` bits come out, equal values too, and no stars.
    """
    (a0, a1), (b0, b1) = one, other
    err = np.zeros(len(a0), np.int64)
    out: list[tuple[np.ndarray, np.ndarray]] = []

    def product(a0, a1, b0, b1):
        """Each value of the first range with each of the second."""
        n = (a1 - a0) * (b1 - b0)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide = np.repeat(b1 - b0, n)
        out.append((np.repeat(a0, n) + at // wide, np.repeat(b0, n) + at % wide))

    def star(a0, a1, b0, b1):
        """Every value of both ranges to the first of the first range; returns index pairs."""
        for s, e in ((a0, a1), (b0, b1)):
            n = e - s
            idx = np.repeat(s - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            out.append((np.repeat(a0, n), idx))

    for bit in range(63, -1, -1):
        if not len(a0):
            break
        one = (a1 - a0 == 1) & (b1 - b0 == 1)
        if one.any():
            i, j = a0[one], b0[one]
            near = np.bitwise_count(values[i] ^ values[j]) <= budget
            out.append((i[near], j[near]))
            a0, a1, b0, b1, err = (x[~one] for x in (a0, a1, b0, b1, err))
        full = err + bit + 1 <= budget
        if full.any():
            (product if every else star)(a0[full], a1[full], b0[full], b1[full])
            a0, a1, b0, b1, err = (x[~full] for x in (a0, a1, b0, b1, err))
        if not len(a0):
            break
        ones = np.r_[0, np.cumsum((values >> U(bit) & U(1)).astype(np.int64))]
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = (a0 == b0) & (a1 == b1)
        parts = [(a0, am, b0, bm, err), (am, a1, bm, b1, err), (a0, am, bm, b1, err + 1)]
        swap = tuple(x[~same] for x in (am, a1, b0, bm, err + 1))
        a0, a1, b0, b1, err = (np.concatenate(x) for x in zip(*parts, swap, strict=True))
        ok = (err <= budget) & (a1 > a0) & (b1 > b0) & ~((a0 == b0) & (a1 - a0 == 1))
        a0, a1, b0, b1, err = (x[ok] for x in (a0, a1, b0, b1, err))
    if every:
        product(a0, a1, b0, b1)
    else:
        out.append((a0, b0))  # single values, told apart by the last bit
    i, j = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
    return (i[i < j], j[i < j]) if every else (i, j)


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index of each one's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _solve(batches: Iterator[pa.RecordBatch], budget: int, rows: int = 40_000) -> Iterator[pa.RecordBatch]:
    """Rows (node, fp) sorted by node and, as unsigned, by fp; a node's rows may cross batches."""
    node, fp = np.zeros(0, np.int64), np.zeros(0, U)

    def links(node, fp):
        i, j = trie_links(fp, node, budget)
        root = roots(len(fp), i, j)
        own = root != np.arange(len(fp))
        return pa.RecordBatch.from_arrays([pa.array(fp[own].view(np.int64)), pa.array(fp[root[own]].view(np.int64))], ["a", "b"])

    for b in batches:
        node = np.r_[node, b.column("node").to_numpy()]
        fp = np.r_[fp, b.column("fp").to_numpy().view(U)]
        while len(node) > rows:
            end = int(np.searchsorted(node, node[min(rows, len(node) - 1)]))
            end = end or int(np.searchsorted(node, node[0], "right"))
            if end == len(node) or node[end - 1] == node[-1]:
                break
            yield links(node[:end], fp[:end])
            node, fp = node[end:], fp[end:]
    if len(node):
        yield links(node, fp)


def links_within(prints: DataFrame, budget: int = 4, blocks: int | None = None, exact: int = 2, most: int = 2048) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fp`, with the same components as all pairs within `budget` bits.

    Without `blocks`, `exact` of budget + exact groups must agree, and exact is raised until the bits that agree
    leave about `most` fingerprints to a trie: 21 bits of 64 up to some 10^9, 27 bits up to 10^11.
    """
    distinct = materialize(prints.select("fp").distinct(), "distinct")
    if blocks is None:
        n = distinct.count()
        while exact < 8 and n > most * 2.0 ** (64 * exact // (budget + exact)):
            exact += 1
        blocks = budget + exact
    if blocks - budget < exact:
        raise ValueError("blocks - budget groups agree at least; exact can't be more")
    split = F.explode(F.array(*[F.struct(F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))).alias("node"), F.col("fp")) for t, m in enumerate(choices(2**64 - 1, blocks, exact))]))
    nodes = materialize(distinct.select(split.alias("x")).select("x.*"), "nodes")
    edges = None
    for _ in range(12):
        sizes = nodes.groupBy("node").agg(F.count("*").alias("n"), F.bit_or("fp").alias("any"), F.bit_and("fp").alias("all")).where("n > 1")
        small, large = sizes.where(F.col("n") <= most).select("node"), sizes.where(F.col("n") > most).select("node", "any", "all")
        now = arrow_map(
            nodes.join(small, "node").repartition("node").sortWithinPartitions("node", F.col("fp") < 0, "fp"),
            partial(_solve, budget=budget), "a long, b long",
        )
        now = materialize(now.distinct(), "links")
        edges = now if edges is None else edges.union(now)
        large = materialize(large, "large")
        if not large.limit(1).count():
            return edges

        @F.pandas_udf("array<long>")
        def masks(some: pd.Series, every: pd.Series) -> pd.Series:
            return pd.Series([choices(int((x ^ y) & 0xFFFFFFFFFFFFFFFF), blocks, exact) for x, y in zip(some, every, strict=True)])

        deeper = nodes.join(large.select("node", masks("any", "all").alias("masks")), "node")
        deeper = deeper.select("node", "fp", F.posexplode("masks").alias("t", "m"))
        nodes = materialize(deeper.select(F.xxhash64("node", "t", F.col("fp").bitwiseAND(F.col("m"))).alias("node"), "fp"), "nodes")
    raise RuntimeError("a trie could not be split")


def simhash_components(docs: DataFrame, width: int = 4, seed: int = 42, budget: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links of at most `budget` bits.

    Null or wordless texts have fingerprint 0 and link like any other. Rows with a null doc_id take
    part; they have their group's id, which is null where every id of the group is. Repeated rows
    stay repeated. Other columns are ignored.
    """
    prints = materialize(fingerprints(docs, width, seed), "prints")
    edges = links_within(prints, budget)
    label = components(edges)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    least = least.join(label.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("label", "fp").alias("label"))
    least = materialize(least, "least")
    group = least.groupBy("label").agg(F.min("low").alias("component_id"))
    return prints.join(least.join(group, "label").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs without all but one document of each near-duplicate group (the one with the smallest doc_id); columns unchanged.

    Rows without a doc_id are kept. Of rows that repeat the kept doc_id, all stay: an id is one document.
    """
    own, name = own_names(docs)
    found = simhash_components(own.select(F.col(name["doc_id"]).alias("doc_id"), F.col(name["text"]).alias("text")), **options)
    drop = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    left = own.join(drop, F.col(name["doc_id"]).cast("long") == F.col("_gone"), "left_anti")
    return left.select(*[F.col(n).alias(c) for c, n in name.items()])


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    out = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
