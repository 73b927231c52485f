"""Connected components of a table of links, by alternating large-star and small-star steps over written tables.

Before each step links are contracted within Arrow batches of bounded size by union-find, which leaves a forest. Every
step is an aggregation by node and an equi-join, so no neighbourhood is ever held in one place; the tables of each step
lie in the shared folder, and the loop ends when every node has one link, to the smallest of its component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, column, written


class Forest:
    """Union-find over 0 .. n - 1 whose roots are the smallest numbers."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True

    def roots(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.parent))], np.int64)


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of the same components: each node but the smallest to the smallest."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    forest = Forest(len(nodes))
    for x, y in zip(inverse[: len(a)].tolist(), inverse[len(a) :].tolist()):
        forest.union(x, y)
    roots = forest.roots()
    other = roots != np.arange(len(nodes))
    return nodes[other], nodes[roots[other]]


def _contract_batches(batches):
    for batch in batches:
        a, b = (column(batch, c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
        if len(a):
            a, b = contract(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


#: Links that one Arrow batch holds, and about as many as a task is given.
BATCH = 100_000


def _contracted(edges: DataFrame, count: int) -> DataFrame:
    """The same components in fewer links, contracted batch by batch, in a table of few files."""
    spark = edges.sparkSession
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    arrow_rows(spark, BATCH)
    try:
        return written(edges.coalesce(max(1, -(-count // BATCH))).mapInArrow(_contract_batches, "a long, b long"), "links")
    finally:
        arrow_rows(spark, int(before))


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one link, to a node that has none."""
    if not edges.groupBy("a").count().where("count > 1").isEmpty():
        return False
    return edges.select("b").distinct().join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) of every node that some link (a, b) joins to another."""
    edges = written(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b"), "links")
    for _ in range(rounds):
        edges = _contracted(edges, edges.count())  # each from the larger node to the smaller
        if _settled(edges):
            break
        # large star: every neighbour larger than a node is linked to the node's smallest neighbour
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = _contracted(large, edges.count())
        # small star: a node's smaller neighbours, and the node, are linked to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = written(edges, "links")
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
