"""Poisson replication: sources mixed to target weights by drawing how often each document is repeated.

A source whose share of all characters is s gets the weight s**alpha (or one given by name), scaled so that the
expected size of the result is `factor` times the input; its mean repetition rate is weight over share. A uniform
number hashed from seed, doc_id and text is put through the inverse of the Poisson distribution with that mean; each
document is exploded by its count, and a hash of seed, document and repetition orders the result over all partitions,
whose bounds divide the hash's range evenly.

Null sources are one source of their own, null texts count as empty; repeated rows draw alike. A source without
characters keeps rate `factor`. The count is worked out for each row from its source's rate, so there may be any number
of sources and rates of any height; only weights given by name that ask for a rate above `most` are refused. An input
column that clashes with an output's name is replaced; a prefix keeps them apart.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sources with more than this share of the rows have their rates broadcast (fewer than its inverse); the others are joined by a shuffle.
HEAVY = 1e-5
#: Repetitions that one array holds while rows are exploded.
BLOCK = 1 << 16


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from an MD5 of the parts, the same on any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_table(mean: float, tail: float = 1e-13) -> list[float]:
    """Probabilities of at most 0, 1, 2, ... events, as far as they differ from 1 by more than tail."""
    out, k, term, total = [], 0, math.exp(-mean), 0.0
    while total < 1 - tail and k < 10 * mean + 60:
        total += term
        out.append(total)
        k += 1
        term *= mean / k
    return out


@lru_cache(maxsize=256)
def _chances(mean: float) -> tuple[int, np.ndarray]:
    """A first count and the probabilities of at most it, one more, ...; below a mean of 50 those of poisson_table."""
    if mean <= 50:
        return 0, np.array(poisson_table(mean))
    mode, reach = int(mean), int(10 * math.sqrt(mean)) + 60  # what lies beyond is below 1e-17
    first = max(0, mode - reach)
    up = np.cumprod(mean / np.arange(mode + 1, mode + reach + 1))
    down = np.cumprod(np.arange(mode, first, -1) / mean)[::-1]
    chance = np.cumsum(np.r_[down, 1.0, up])
    return first, chance / chance[-1]


def counts(rate: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The inverse Poisson distribution with mean rate at number, for each pair."""
    out = np.zeros(len(rate), np.int64)
    order = np.argsort(rate, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(rate[order])) + 1) if len(rate) else []:
        mean = float(rate[part[0]])
        first, chance = _chances(mean) if mean < 1e6 else _chances.__wrapped__(mean)
        out[part] = first + np.searchsorted(chance, number[part], "right")
    return out


def _drawn(rate: pa.Array, number: pa.Array) -> pa.Array:
    return pa.array(counts(rate.to_numpy(zero_copy_only=False), number.to_numpy(zero_copy_only=False)), pa.int64())


def rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.7, factor: float = 1.0) -> DataFrame:
    """source, n_docs, chars and mean repetition rate of every source."""
    size = F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double")
    sums = docs.groupBy(F.col("source")).agg(F.count(F.lit(1)).alias("n_docs"), size.alias("chars"))
    if weights is None:
        weight = F.pow("chars", F.lit(alpha))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source") == name, float(w)).otherwise(weight)
    sums = sums.withColumn("weight", F.when(F.col("chars") > 0, weight).otherwise(0.0))
    total = sums.agg(F.sum("chars").alias("chars"), F.sum("weight").alias("weight")).first()
    scale = factor * (total["chars"] or 0.0) / (total["weight"] or 1.0)
    return sums.withColumn("rate", F.when(F.col("chars") > 0, F.col("weight") * scale / F.col("chars")).otherwise(F.lit(float(factor))))


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.7, factor: float = 1.0, seed: int = 7, most: float = 50.0, digits: int = 6, prefix: str = "") -> DataFrame:
    """The columns of docs, with repetition, copies, rate and shuffle_key (after prefix), in the order of shuffle_key over all partitions."""
    from .common import partitions, written

    spark = docs.sparkSession
    known = written(rates(docs, weights, alpha, factor).select("source", "n_docs", F.round("rate", digits).alias("rate")), "rates")
    if weights is not None and not known.where(F.col("rate") > most).isEmpty():
        raise ValueError(f"the weights ask for a rate above {most}")
    repetition, copies, rate, shuffle_key = (prefix + n for n in ("repetition", "copies", "rate", "shuffle_key"))
    own = {n: f"_mixing_{n}" for n in ("source", "rate", "number", "key", "copies", "block")}
    table = known.select(F.col("source").alias(own["source"]), F.col("rate").alias(own["rate"]), "n_docs")
    heavy = F.col("n_docs") > HEAVY * (known.agg(F.sum("n_docs")).first()[0] or 0)
    same = F.col("source").eqNullSafe(F.col(own["source"]))
    light = table.where(~heavy).drop("n_docs")
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text))
    kept = [f"`{c}`" for c in docs.columns if c not in (repetition, copies, rate, shuffle_key)]
    keyed = docs.select(*kept, uniform(key).alias(own["number"]), key.alias(own["key"]))
    rated = keyed.join(F.broadcast(table.where(heavy).drop("n_docs")), same, "left")
    if light.isEmpty():
        rated = rated.where(F.col(own["rate"]).isNotNull())
    else:  # no source of these has many rows, so none makes a large partition
        rest = rated.where(F.col(own["rate"]).isNull()).drop(own["source"], own["rate"]).join(light.hint("merge"), same)
        rated = rated.where(F.col(own["rate"]).isNotNull()).unionByName(rest)
    count = F.arrow_udf(_drawn, "long").asNondeterministic()  # worked out once for each row
    last = F.least(F.col(own["copies"]), (F.col(own["block"]) + 1) * BLOCK)
    drawn = (
        rated.withColumn(own["copies"], count(own["rate"], own["number"])).where(F.col(own["copies"]) > 0)
        .withColumn(own["block"], F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({own['copies']} - 1) div {BLOCK}"))))
        .select(*kept, own["key"], F.col(own["copies"]).alias(copies), F.col(own["rate"]).alias(rate), F.explode(F.sequence(F.col(own["block"]) * BLOCK + 1, last)).alias(repetition))
    )
    order = F.conv(F.substring(F.md5(F.concat_ws("|", own["key"], F.lit("order"), F.col(repetition).cast("string"))), 1, 15), 16, 10).cast("long")
    n = partitions(spark)
    part = F.shiftright(F.shiftright(shuffle_key, 30) * n, 30).cast("int")  # 60 bits, evenly dealt: no sample is needed for the cut points
    return drawn.select(*kept, repetition, copies, rate, order.alias(shuffle_key)).repartitionById(n, part).sortWithinPartitions(shuffle_key)
