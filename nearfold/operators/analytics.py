"""Recall, percentiles, histograms, principal components and verdicts over searches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import bucket_of, quantile_cuts


def recall(found: DataFrame, truth: DataFrame, empty: str = "skip") -> DataFrame:
    """query_id and the share of the expected ids (query_id, id) that were found; a query that expects none is skipped, 0 or 1."""
    expected = truth.where("id IS NOT NULL").select("query_id", "id").distinct()
    both = expected.join(found.select("query_id", "id").distinct().withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    each = both.groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
    if empty == "skip":
        return each
    every = truth.select("query_id").distinct()
    return every.join(each, "query_id", "left").select("query_id", F.coalesce("recall", F.lit(1.0 if empty == "one" else 0.0)).alias("recall"))


def mean_recall(found: DataFrame, truth: DataFrame, empty: str = "skip") -> DataFrame:
    return recall(found, truth, empty).agg(F.avg("recall").alias("recall"))


def _at_ranks(rows: DataFrame, value: str, wanted: Callable[[int], dict], name: str, kind: str) -> DataFrame:
    """name and the value at each wanted rank among the n values that are not null; wanted: the ranks by name, given n.

    Rows are counted by buckets between quantiles, and only the buckets that hold a wanted rank are looked into; there
    equal values are counted first, so a frequent one is one row.
    """
    known = rows.where(F.col(value).isNotNull()).select(F.col(value).alias("v"))
    number = F.col("v").cast("double")
    placed = known.withColumn("bucket", bucket_of(number, quantile_cuts(known, number)))
    counts = {r["bucket"]: r["count"] for r in placed.groupBy("bucket").count().collect()}  # a row for each bucket
    begin, n = {}, 0
    for b in sorted(counts):
        begin[b], n = n, n + counts[b]
    if not n:
        return rows.sparkSession.createDataFrame([], f"{name} {kind}, value {known.schema['v'].dataType.simpleString()}")
    asked = [(key, b, r - begin[b]) for key, r in wanted(n).items() for b in begin if begin[b] <= r < begin[b] + counts[b]]
    copies = placed.where(F.col("bucket").isin([b for _, b, _ in asked])).groupBy("bucket", "v").agg(F.count(F.lit(1)).alias("copies"))
    before = F.sum("copies").over(Window.partitionBy("bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) - F.col("copies")
    places = F.array(*[F.struct(F.lit(key).cast(kind).alias("key"), F.lit(b).alias("bucket"), F.lit(r).cast("long").alias("rank")) for key, b, r in asked])
    here = F.filter(places, lambda a: (a["bucket"] == F.col("bucket")) & (a["rank"] >= F.col("before")) & (a["rank"] < F.col("before") + F.col("copies")))
    return copies.withColumn("before", before).select(F.explode(here).alias("at"), "v").select(F.col("at.key").alias(name), F.col("v").alias("value"))


def percentiles(rows: DataFrame, value: str, percents: list[int]) -> DataFrame:
    """percent and the value at rank floor((n - 1) p / 100), exactly."""
    return _at_ranks(rows, value, lambda n: {p: (n - 1) * p // 100 for p in percents}, "percent", "int")


def nearest_rank(rows: DataFrame, value: str, quantiles: list[float]) -> DataFrame:
    """quantile and the value at rank ceil(q n), at least the first."""
    return _at_ranks(rows, value, lambda n: {q: min(max(int(np.ceil(q * n - 1e-12)) - 1, 0), n - 1) for q in quantiles}, "quantile", "double")


def summary(rows: DataFrame, value: str) -> DataFrame:
    v = F.col(value)
    return rows.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"))


def throughput(count: int, seconds: float) -> float:
    return count / seconds if seconds > 0 else 0.0


def histogram(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """bin, low, high and n for every one of the equal bins between the least and the largest value; the last one is closed."""
    v = F.col(value).cast("double")
    edge = rows.agg(F.min(v).alias("low"), F.max(v).alias("high")).first()
    if edge["low"] is None:
        return rows.sparkSession.createDataFrame([], "bin long, low double, high double, n long")
    width = (edge["high"] - edge["low"]) / bins or 1.0
    place = F.least(F.lit(bins - 1), F.floor((v - F.lit(edge["low"])) / F.lit(width))).cast("long")
    counts = rows.where(v.isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    all_bins = rows.sparkSession.range(bins).select(F.col("id").alias("bin"))
    low = F.lit(edge["low"]) + F.col("bin") * F.lit(width)
    return all_bins.join(counts, "bin", "left").select("bin", low.alias("low"), (low + F.lit(width)).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


@dataclass(frozen=True)
class Ceilings:
    p50_max_ms: float
    p99_max_ms: float
    recall_min: float

    def violations(self, p50: float, p99: float, recall: float) -> list[str]:
        out = []
        if p50 > self.p50_max_ms:
            out.append(f"p50 {p50:.3f} ms is above {self.p50_max_ms:.3f} ms")
        if p99 > self.p99_max_ms:
            out.append(f"p99 {p99:.3f} ms is above {self.p99_max_ms:.3f} ms")
        if recall < self.recall_min:
            out.append(f"recall {recall:.4f} is below {self.recall_min:.4f}")
        return out


def better(recall: Column, p50: Column, p99: Column, other_recall: Column, other_p50: Column, other_p99: Column) -> Column:
    """Whether a configuration is at least as good in all three."""
    return (recall >= other_recall) & (p50 <= other_p50) & (p99 <= other_p99)


def pareto(points: DataFrame) -> DataFrame:
    """Points (name, recall, latency) by latency, with whether no other point has more recall at no more latency: one pass over the sorted points."""
    from pyspark.sql import Window

    order = Window.orderBy("latency", F.col("recall").desc(), "name").rowsBetween(Window.unboundedPreceding, -1)
    best = F.max("recall").over(order)
    return points.withColumn("optimal", best.isNull() | (F.col("recall") > best)).orderBy("latency", "name")


def moments(rows: DataFrame, column: str = "vector") -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and population covariance of all vectors: one matrix product a batch, sums by component in Spark."""

    def of(batches):
        n, total, outer = 0, None, None
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                n += len(x)
                total = x.sum(0) + (0 if total is None else total)
                outer = x.T @ x + (0 if outer is None else outer)
        if n:
            d = len(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, d)), pa.array([[float(n)], *np.c_[total, outer].tolist()], pa.list_(pa.float64()))], names=["i", "row"])

    parts = rows.where(F.col(column).isNotNull()).select(column).mapInArrow(of, "i long, row array<double>")
    cells = parts.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()  # dimension squared
    if not cells:
        return 0, np.zeros(0), np.zeros((0, 0))
    d = max(r["i"] for r in cells) + 1
    n = next(int(r["x"]) for r in cells if r["i"] == -1)
    table = np.zeros((d, d + 1))
    for r in cells:
        if r["i"] >= 0:
            table[r["i"], r["j"]] = r["x"]
    mean = table[:, 0] / n
    return n, mean, table[:, 1:] / n - np.outer(mean, mean)


@dataclass(frozen=True)
class Projection:
    """A basis of principal components: column signs are such that the largest entry is positive."""

    mean: np.ndarray
    basis: np.ndarray
    explained: np.ndarray

    def point(self, vector: list[float]) -> list[float]:
        return ((np.asarray(vector, np.float64) - self.mean) @ self.basis).tolist()

    def apply(self, rows: DataFrame) -> DataFrame:
        """id and the point of every row."""
        mean, basis = self.mean, self.basis

        def of(batches):
            for batch in batches:
                if batch.num_rows:
                    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(((x - mean) @ basis).tolist(), pa.list_(pa.float64()))], names=["id", "point"])

        return rows.select("id", "vector").mapInArrow(of, "id long, point array<double>")


def principal_components(rows: DataFrame, components: int = 3) -> Projection:
    """Of the covariance over all rows."""
    _, mean, covariance = moments(rows)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1][:components]
    basis = vectors[:, order]
    basis = basis * np.sign(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])])
    return Projection(mean, basis, values[order])
