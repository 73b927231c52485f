"""Distances as column expressions, and as matrix products for many queries.

All arithmetic is in double precision. L2 is squared, dot is negated, so smaller is nearer. A zero vector has cosine
distance 1 in searches and infinity in oracles.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import Metric


def _sum_of(left: Column, right: Column, each) -> Column:
    return F.aggregate(F.zip_with(left, right, each), F.lit(0.0), lambda acc, x: acc + x)


def as_double(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def dot_product(left: Column, right: Column) -> Column:
    return _sum_of(left, right, lambda x, y: x.cast("double") * y.cast("double"))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def distance(metric: Metric, vector: Column, query: Column, vector_norm: Column | None = None, query_norm: Column | float | None = None, zero_norm: float = 1.0) -> Column:
    """The distance of two array columns; norms that are known need not be computed again."""
    if metric is Metric.L2:
        return _sum_of(vector, query, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    if metric is Metric.DOT:
        return -dot_product(vector, query)
    scale = (norm(vector) if vector_norm is None else vector_norm) * (norm(query) if query_norm is None else query_norm)
    return F.when(scale == 0, F.lit(zero_norm)).otherwise(1.0 - dot_product(vector, query) / F.when(scale != 0, scale))


def distance_to(metric: Metric, vector: Column, query: list[float], zero_norm: float = 1.0) -> Column:
    """The distance to a query known now: its norm is a literal, not computed for each row."""
    size = math.sqrt(sum(float(x) * float(x) for x in query))
    return distance(metric, vector, literal(query), query_norm=F.lit(size), zero_norm=zero_norm)


def expanded_l2(vector: Column, query: Column) -> Column:
    """Squared L2 from norms and a dot product, not below zero."""
    return F.greatest(F.lit(0.0), dot_product(vector, vector) + dot_product(query, query) - 2 * dot_product(vector, query))


class Side:
    """Vectors of one side of a matrix of distances, prepared once for many products: of unit length for cosine."""

    def __init__(self, metric: Metric, x: np.ndarray):
        self.metric, self.x = metric, x.astype(np.float64, copy=False)
        self.squares = None if metric is Metric.DOT else (self.x * self.x).sum(1)
        if metric is Metric.COSINE:
            self.x = self.x / np.sqrt(np.where(self.squares > 0, self.squares, 1.0))[:, None]

    def __len__(self) -> int:
        return len(self.x)

    def __getitem__(self, some) -> Side:
        out = object.__new__(Side)
        out.metric, out.x, out.squares = self.metric, self.x[some], None if self.squares is None else self.squares[some]
        return out

    def distances(self, other: Side, zero_norm: float = 1.0) -> np.ndarray:
        """Distances of every vector (first axis) to every one of the other side, in double precision."""
        product = self.x @ other.x.T
        if self.metric is Metric.DOT:
            return np.negative(product, out=product)
        if self.metric is Metric.L2:
            return np.maximum(0.0, self.squares[:, None] + other.squares[None, :] - 2 * product)
        np.subtract(1.0, product, out=product)
        product[self.squares == 0] = zero_norm
        product[:, other.squares == 0] = zero_norm
        return product


def matrix_distances(metric: Metric, rows: np.ndarray, queries: np.ndarray, zero_norm: float = 1.0) -> np.ndarray:
    """Distances of every row (first axis) to every query, in double precision."""
    return Side(metric, rows).distances(Side(metric, queries), zero_norm)
