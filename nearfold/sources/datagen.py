"""Generated corpora, the same for the same seed on any number of tasks.

The random numbers are SplitMix64's. Its n-th draw is a function of seed and n, so every task computes its own rows'
draws without the others'.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..errors import SchemaViolation

GAMMA = np.uint64(0x9E3779B97F4A7C15)
#: Streams of the corpora.
CORPUS, CATEGORY, QUERY = 1, 2, 3
CENTRE, ASSIGN, CLUSTER_CATEGORY, NOISE, QUERY_ASSIGN, QUERY_NOISE = range(10, 16)
DEFAULT_SEED = 0x9E3779B97F4A7C15


def draws(seed: int, first: int, count: int) -> np.ndarray:
    """Draws number first, first + 1, ... (from 0) of SplitMix64."""
    with np.errstate(over="ignore"):
        z = np.uint64(seed & (1 << 64) - 1) + (np.arange(first, first + count, dtype=np.uint64) + np.uint64(1)) * GAMMA
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def stream_seed(seed: int, stream: int) -> int:
    """The seed of an independent stream."""
    second = int(draws(seed ^ 0x123456789ABCDEF0, 1, 1)[0])
    return second ^ (stream * 0x85EBCA6B9487E9C1 & (1 << 64) - 1)


def unit_floats(raw: np.ndarray) -> np.ndarray:
    """Floats in [0, 1) from the top 24 bits."""
    return (raw >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24)


def normals(seed: int, first: int, count: int) -> np.ndarray:
    """Standard normal floats number first, ...: Box-Muller on two draws each. A first draw of zero is rare enough
    (one in 2**24) to be replaced by the least positive one, so that numbers stay where they are."""
    u = unit_floats(draws(seed, 2 * first, 2 * count))
    one = np.maximum(u[0::2], np.float32(2.0**-24))
    return np.sqrt(np.float32(-2) * np.log(one)) * np.cos(np.float32(2 * np.pi) * u[1::2])


def _check(**sizes) -> None:
    for name, n in sizes.items():
        if n < 1:
            raise SchemaViolation(f"{name} must be greater than zero")


def _rows(spark: SparkSession, n: int, dim: int, make, schema: str) -> DataFrame:
    def of(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i in range(0, len(ids), 4096):
                own = ids[i : i + 4096]
                columns = make(int(own[0]), len(own))
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, len(own) * dim + 1, dim, dtype=np.int32)), pa.array(columns.pop("vector").reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(own), vectors, *[pa.array(c) for c in columns.values()]], names=["id", "vector", *columns])

    return spark.range(n).mapInArrow(of, schema)


def uniform_rows(spark: SparkSession, n: int, dim: int, categories: int = 1000, seed: int = DEFAULT_SEED) -> DataFrame:
    """id, vector (components uniform in [0, 1)) and category."""
    _check(num_vectors=n, dimension=dim, num_categories=categories)
    vectors, labels = stream_seed(seed, CORPUS), stream_seed(seed, CATEGORY)

    def make(first, count):
        return {"vector": unit_floats(draws(vectors, first * dim, count * dim)), "category": (draws(labels, first, count) % np.uint64(categories)).astype(np.int32)}

    return _rows(spark, n, dim, make, "id long, vector array<float>, category int")


def uniform_queries(n: int, dim: int, seed: int = DEFAULT_SEED) -> list[tuple[int, list[float]]]:
    _check(num_queries=n, dimension=dim)
    x = unit_floats(draws(stream_seed(seed, QUERY), 0, n * dim)).reshape(n, dim)
    return [(i, v.tolist()) for i, v in enumerate(x)]


def _centres(dim: int, clusters: int, seed: int, mean: float, deviation: float) -> np.ndarray:
    return (np.float32(mean) + np.float32(deviation) * normals(stream_seed(seed, CENTRE), 0, clusters * dim)).reshape(clusters, dim)


def clustered_rows(spark: SparkSession, n: int, dim: int, clusters: int = 1000, categories: int = 1000, seed: int = DEFAULT_SEED, sigma: float = 0.05, centre_mean: float = 0.5, centre_sigma: float = 0.15) -> DataFrame:
    """id, vector (a cluster's centre and noise), category and cluster."""
    _check(num_vectors=n, dimension=dim, num_categories=categories, num_clusters=clusters)
    for name, s in (("sigma", sigma), ("centre_sigma", centre_sigma)):
        if not (np.isfinite(s) and s > 0):
            raise SchemaViolation(f"{name} must be finite and greater than zero")
    centres = _centres(dim, clusters, seed, centre_mean, centre_sigma)
    assign, labels, noise = (stream_seed(seed, s) for s in (ASSIGN, CLUSTER_CATEGORY, NOISE))

    def make(first, count):
        own = (draws(assign, first, count) % np.uint64(clusters)).astype(np.int64)
        x = centres[own] + np.float32(sigma) * normals(noise, first * dim, count * dim).reshape(count, dim)
        return {"vector": x.astype(np.float32), "category": (draws(labels, first, count) % np.uint64(categories)).astype(np.int32), "cluster": own}

    return _rows(spark, n, dim, make, "id long, vector array<float>, category int, cluster long")


def clustered_queries(n: int, dim: int, clusters: int = 1000, seed: int = DEFAULT_SEED, sigma: float = 0.05, centre_mean: float = 0.5, centre_sigma: float = 0.15) -> list[tuple[int, list[float]]]:
    _check(num_queries=n, dimension=dim, num_clusters=clusters)
    own = (draws(stream_seed(seed, QUERY_ASSIGN), 0, n) % np.uint64(clusters)).astype(np.int64)
    x = _centres(dim, clusters, seed, centre_mean, centre_sigma)[own] + np.float32(sigma) * normals(stream_seed(seed, QUERY_NOISE), 0, n * dim).reshape(n, dim)
    return [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]


def manifest(family: str, metric: str, dimension: int, vectors: int, queries: int, top_k: int, seed: int, categories: int) -> str:
    from ..plans.predicates import selectivity_tiers

    return json.dumps({
        "format_version": 1, "generator": "corpus-gen", "metric": metric, "dimension": dimension, "num_vectors": vectors, "num_queries": queries, "top_k": top_k, "seed": seed,
        "distribution": family, "num_categories": categories, "selectivity_tiers": [round(t, 6) for t in selectivity_tiers(categories)],
        "files": {"corpus": "corpus.bin", "meta": "meta.bin", "queries": "queries.bin", "ground_truth": "ground_truth.bin"},
    }, indent=2)


class Mulberry32:
    """A small 32-bit generator of numbers in [0, 1)."""

    def __init__(self, seed: int):
        self.state = seed & 0xFFFFFFFF

    def __call__(self) -> float:
        m = 0xFFFFFFFF
        self.state = (self.state + 0x6D2B79F5) & m
        t = (self.state ^ self.state >> 15) * (1 | self.state) & m
        t = (t + ((t ^ t >> 7) * (61 | t) & m)) & m ^ t
        return ((t ^ t >> 14) & m) / 4294967296


def demo_rows(count: int = 2000, dim: int = 8, clusters: int = 5, seed: int = 42) -> list[tuple[int, list[float], int]]:
    """id, vector and cluster of a small demonstration: clusters in turn, centres in (-1, 1), noise within a quarter."""
    random = Mulberry32(seed)
    centres = [[random() * 2 - 1 for _ in range(dim)] for _ in range(clusters)]
    return [(i, [c + (random() - 0.5) * 0.5 for c in centres[i % clusters]], i % clusters) for i in range(count)]
