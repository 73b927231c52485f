"""python -m nearfold.sources.generate: writes a corpus with its queries and exact answers as Parquet, and a small one as a fixture too."""

from __future__ import annotations

import argparse
import os

import numpy as np
from pyspark.sql import SparkSession

from ..operators.search import ground_truth
from ..types import Metric
from . import datagen as G
from .fixtures import write_fixture

#: Vectors up to which the binary fixture is written by the driver.
FIXTURE_ROWS = 200_000


def options(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--mode", choices=["uniform", "clustered"], default="uniform")
    p.add_argument("--vectors", type=int, default=10_000)
    p.add_argument("--dimension", type=int, default=64)
    p.add_argument("--queries", type=int, default=100)
    p.add_argument("--top-k", type=int, default=10)
    p.add_argument("--categories", type=int, default=1000)
    p.add_argument("--clusters", type=int, default=1000)
    p.add_argument("--seed", type=int, default=G.DEFAULT_SEED)
    p.add_argument("--metric", type=Metric.parse, default=Metric.COSINE)
    p.add_argument("--out", required=True)
    return p.parse_args(args)


def generate(spark: SparkSession, o: argparse.Namespace) -> None:
    if o.mode == "uniform":
        rows, queries = G.uniform_rows(spark, o.vectors, o.dimension, o.categories, o.seed), G.uniform_queries(o.queries, o.dimension, o.seed)
    else:
        rows, queries = G.clustered_rows(spark, o.vectors, o.dimension, o.clusters, o.categories, o.seed), G.clustered_queries(o.queries, o.dimension, o.clusters, o.seed)
    truth = ground_truth(rows, queries, o.metric, o.top_k)
    rows.write.mode("overwrite").parquet(f"{o.out}/corpus")
    spark.createDataFrame(queries, "query_id long, vector array<float>").write.mode("overwrite").parquet(f"{o.out}/queries")
    truth.write.mode("overwrite").parquet(f"{o.out}/truth")
    if o.vectors <= FIXTURE_ROWS:
        got = rows.select("id", "vector", "category").orderBy("id").toArrow()
        vectors = got["vector"].combine_chunks().flatten().to_numpy().reshape(o.vectors, o.dimension)
        answers = [(list(r["ids"]), list(r["distances"])) for r in truth.orderBy("query_id").collect()]
        about = G.manifest(o.mode, o.metric.value, o.dimension, o.vectors, o.queries, o.top_k, o.seed, o.categories)
        write_fixture(os.path.join(o.out, "fixture"), o.mode, vectors, got["category"].to_numpy(), np.array([v for _, v in queries], np.float32), answers, o.top_k, about)


if __name__ == "__main__":
    generate(SparkSession.builder.getOrCreate(), options())
