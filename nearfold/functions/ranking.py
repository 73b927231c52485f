"""Ranks over all rows without a window over one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_of(value: Column, cuts: list[float]) -> Column:
    """How many of the ascending cuts lie below value; found among about the square root of them, then within one stretch."""
    if not cuts:
        return F.lit(0)
    stretch = max(1, int(len(cuts) ** 0.5))
    parts = [cuts[i : i + stretch] for i in range(0, len(cuts), stretch)]
    below = lambda found: F.size(F.filter(found, lambda c: c < value))
    coarse = F.greatest(below(F.array(*[F.lit(float(p[0])) for p in parts])) - 1, F.lit(0))
    fine = F.element_at(F.array(*[F.array(*[F.lit(float(c)) for c in p]) for p in parts]), coarse + 1)
    return coarse * stretch + below(fine)


def quantile_cuts(rows: DataFrame, value: Column) -> list[float]:
    """Ascending numbers near the quantiles of value over all rows, fewer than there are shuffle partitions."""
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return sorted(set(rows.select(value.alias("x")).approxQuantile("x", [i / n for i in range(1, n)], 0.5 / n))) if n > 1 else []


def global_rank(rows: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """rows with a dense rank from 0 in that order: rows fall into buckets at quantiles of the first column, which is a
    number, ranks run within buckets, and each bucket begins where the counts before it end."""
    first = F.col(order[0]).cast("double")
    cuts = quantile_cuts(rows, first)
    placed = rows.withColumn("rank_bucket", bucket_of(first, cuts))
    counts = {r["rank_bucket"]: r["count"] for r in placed.groupBy("rank_bucket").count().collect()}  # a row for each bucket
    begin, at = [], 0
    for b in range(len(cuts) + 1):
        begin.append(F.lit(at).cast("long"))
        at += counts.get(b, 0)
    within = F.row_number().over(Window.partitionBy("rank_bucket").orderBy(*order)) - 1
    return placed.withColumn(name, within + F.element_at(F.array(*begin), F.col("rank_bucket") + 1)).drop("rank_bucket")
