"""Gradient-boosted trees: trained by Spark ML, kept in the shared folder, evaluated as arrays inside tasks."""

from __future__ import annotations

import hashlib
import inspect
import sys
import uuid
from collections.abc import Callable
from types import ModuleType

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession

from newsloom.llm.util import shared_dir

Node = tuple[int, float, int, int, float]


class Trees:
    """Boosted trees as arrays: feature (-1: leaf), threshold, left, right, value; one row per tree."""

    def __init__(self, trees: list[list[Node]], weights: list[float]):
        self.trees, size = trees, max(map(len, trees))
        pad = [t + [(-1, 0.0, 0, 0, 0.0)] * (size - len(t)) for t in trees]
        self.feature = np.array([[n[0] for n in t] for t in pad])
        self.threshold = np.array([[n[1] for n in t] for t in pad])
        self.next = np.array([[(n[3], n[2]) for n in t] for t in pad])
        self.value = np.array([[n[4] for n in t] for t in pad])
        self.weights = np.array(weights)

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin, row = np.zeros(len(x)), np.arange(len(x))
        for k, w in enumerate(self.weights):
            at = np.zeros(len(x), np.int64)
            while True:
                f = self.feature[k, at]
                inner = f >= 0
                if not inner.any():
                    break
                at = np.where(inner, self.next[k, at, (x[row, np.maximum(f, 0)] <= self.threshold[k, at]).astype(int)], at)
            margin += w * self.value[k, at]
        return 1 / (1 + np.exp(-2 * margin))


def boosted(rows: DataFrame, rounds: int, depth: int, seed: int) -> Trees:
    """Trees from rows(x array<double>, label double)."""
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.35, seed=seed, maxBins=64, cacheNodeIds=False).fit(rows.select(array_to_vector("x").alias("features"), "label"))

    def flat(node, out: list) -> int:
        at = len(out)
        out.append(None)
        if node.getClass().getSimpleName() == "LeafNode":
            out[at] = (-1, 0.0, 0, 0, node.prediction())
        else:
            split = node.split()
            out[at] = (split.featureIndex(), split.threshold(), flat(node.leftChild(), out), flat(node.rightChild(), out), 0.0)
        return at

    trees = []
    for tree in model._java_obj.trees():
        flat(tree.rootNode(), own := [])
        trees.append(own)
    return Trees(trees, list(model.treeWeights))


def kept(spark: SparkSession, name: str, train: Callable[[], Trees], *modules: ModuleType) -> Trees:
    """The trees saved as `name` in the shared folder; trained and saved if there are none.

    The name must tell all parameters; the source of the modules that write and describe the examples is
    part of it too, so a change there trains anew. A table is written beside its place and then moved
    there: a reader finds all of it or nothing.
    """
    source = "".join(inspect.getsource(m) for m in (*modules, sys.modules[__name__]))
    path = f"{shared_dir(spark)}/models/{name}-{hashlib.sha256(source.encode()).hexdigest()[:16]}"
    at = lambda p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at(f"{path}/_SUCCESS")):
        rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r["tree"])  # a row per tree
        return Trees([[tuple(n) for n in r["nodes"]] for r in rows], [r["weight"] for r in rows])
    made = train()
    own = f"{path}-{uuid.uuid4().hex}"
    table = [(k, float(w), [tuple(n) for n in t]) for k, (t, w) in enumerate(zip(made.trees, made.weights, strict=True))]
    kind = "tree int, weight double, nodes array<struct<feature:int,threshold:double,left:int,right:int,value:double>>"
    spark.createDataFrame(table, kind).coalesce(1).write.parquet(own)
    if not fs.rename(at(own), at(path)):
        fs.delete(at(own), True)
    return made
