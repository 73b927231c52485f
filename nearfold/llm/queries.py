"""The thin queries over the operators, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ego, extract, fingerprint, hosts, licenses, mixing, oracles, packing, tjoin, tokenfile, toxicity


def op1_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return hosts.judge(pages, labels.selectExpr("doc_id AS page_id", "quality AS good"))


def op3_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_text_to_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_t_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tjoin.join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_multiset_fingerprint, op2_host_reputation, op3_bm25_packing, op4_poisson_mix, op5_license_rules, op6_bit_planes, op7_factorization_machine, op8_text_to_tag, op9_epsilon_grid, op10_t_occurrence)}
ORACLES: dict[str, str] = {"op2_host_reputation": oracles.OP2, "op4_poisson_mix": oracles.OP4, "op9_epsilon_grid": oracles.OP9, "op10_t_occurrence": oracles.OP10}
