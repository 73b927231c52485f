"""A session over one generated corpus: ingest, index, query, benchmark, status."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..plans import ladder as L
from ..sources.datagen import uniform_rows
from ..types import ColumnType, MetadataSchema, Metric, SearchOptions
from . import search as S
from .analytics import throughput
from .index import VectorIndex
from .table import Catalog


class Session:
    """Cosine search over id, vector and category; limits as a shared service would set them."""

    MAX_VECTORS, MAX_PASSES = 200_000, 20

    def __init__(self, spark: SparkSession, root: str, vectors: int = 1000, dimension: int = 64, categories: int = 10, seed: int = 42):
        self.spark, self.seed = spark, seed
        self.dimension, n = min(max(dimension, 8), 1024), min(vectors, self.MAX_VECTORS)
        self.catalog = Catalog(spark, f"{root}/tables")
        self.table = self.catalog.create("explorer", self.dimension, Metric.COSINE, MetadataSchema((("category", ColumnType.I64),)))
        self.index = VectorIndex(spark, f"{root}/index", self.dimension, Metric.COSINE)
        self.ingest(n, categories)

    def ingest(self, n: int, categories: int = 10) -> float:
        rows = uniform_rows(self.spark, n, self.dimension, categories, self.seed)
        began = time.perf_counter()
        self.table.insert(rows.select("id", "vector", F.col("category").cast("long").alias("category")))
        took = time.perf_counter() - began
        self.index.write(rows)
        return throughput(n, took)

    def build(self, kind: str = L.HNSW) -> None:
        self.index.remove_indexes()
        if kind != L.EXHAUSTIVE:
            self.index.build(L.default_params(kind, self.dimension))

    rebuild = build

    def query(self, vector: list[float], k: int = 10, knobs: L.Knobs | None = None) -> dict:
        """What the index and the exact search find, the recall of the one by the other, and their milliseconds."""
        k = min(max(k, 1), 1000)
        began = time.perf_counter()
        found = self.index.query(vector, knobs or L.naive_knobs(k)).collect()
        middle = time.perf_counter()
        exact = S.nearest(self.table.snapshot().visible(), vector, Metric.COSINE, k).select("id", "distance").collect()
        end = time.perf_counter()
        expected = {r["id"] for r in exact}
        return {"hits": found, "exact": exact, "recall": len(expected & {r["id"] for r in found}) / len(expected) if expected else 0.0, "ms": 1e3 * (middle - began), "exact_ms": 1e3 * (end - middle)}

    def bench(self, queries: list[list[float]], passes: int = 1, k: int = 10) -> dict:
        passes = min(max(passes, 1), self.MAX_PASSES)
        began = time.perf_counter()
        all_of = [self.query(q, k) for _ in range(passes) for q in queries]
        times = sorted(r["ms"] for r in all_of)
        at = lambda p: times[(len(times) - 1) * p // 100]
        return {"p50_ms": at(50), "p99_ms": at(99), "mean_ms": sum(times) / len(times), "recall": sum(r["recall"] for r in all_of) / len(all_of), "qps": throughput(len(times), time.perf_counter() - began)}

    def search(self, vector: list[float], k: int = 10, predicate=None):
        return self.table.snapshot().search(vector, predicate, SearchOptions(k))

    def status(self) -> dict:
        return self.catalog.status() | {"index": self.index.index_names(), "build": self.index.build_state}
