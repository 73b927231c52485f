"""Which index a table of some size should have, how it is built, and the knobs to ask it with."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import SchemaViolation
from ..types import MAX_TOP_K

EXHAUSTIVE, HNSW, IVF_PQ = "exhaustive", "hnsw", "ivf_pq"
#: Rows from which a graph index, a quantised index and a background build are chosen.
HNSW_ROWS, PQ_ROWS, BACKGROUND_ROWS = 10_000, 1_000_000, 50_000
#: Rows of a partition that an index of many rows is built for, and the most partitions.
PARTITION_ROWS, MOST_PARTITIONS = 250_000, 256
#: Rows that product quantisation needs to be trained.
PQ_MIN_ROWS = 256
CALIBRATION_QUERIES, CALIBRATION_ROWS = 8, 250_000


def ladder_choice(rows: int, forced: str | None = None) -> str:
    if forced is not None:
        if forced not in (EXHAUSTIVE, HNSW, IVF_PQ):
            raise SchemaViolation(f"unknown index kind '{forced}'")
        return forced
    return EXHAUSTIVE if rows < HNSW_ROWS else HNSW if rows < PQ_ROWS else IVF_PQ


def ladder_column(rows: Column) -> Column:
    return F.when(rows < HNSW_ROWS, EXHAUSTIVE).when(rows < PQ_ROWS, HNSW).otherwise(IVF_PQ)


def build_disposition(kind: str, rows: int) -> str:
    if kind == EXHAUSTIVE:
        return "not_needed"
    return "background" if rows >= BACKGROUND_ROWS else "inline"


def disposition_column(rows: Column) -> Column:
    return F.when(rows < HNSW_ROWS, "not_needed").when(rows >= BACKGROUND_ROWS, "background").otherwise("inline")


@dataclass(frozen=True)
class BuildParams:
    kind: str
    partitions: int = 4
    sub_vectors: int | None = None
    ef_construction: int | None = None

    def check(self, dimension: int) -> None:
        if self.partitions < 1:
            raise SchemaViolation("partitions must be greater than zero")
        if self.kind == IVF_PQ:
            if not self.sub_vectors or dimension % self.sub_vectors:
                raise SchemaViolation(f"sub_vectors must divide the dimension {dimension}")
        elif self.sub_vectors is not None:
            raise SchemaViolation("only a quantised index has sub_vectors")


def default_params(kind: str, dimension: int, rows: int = 0) -> BuildParams:
    """Four partitions, and more for tables of over a million rows."""
    partitions = min(max(4, rows // PARTITION_ROWS), MOST_PARTITIONS)
    if kind == IVF_PQ:
        return BuildParams(kind, partitions, sub_vectors=next(m for m in (16, 8, 4, 2, 1) if dimension % m == 0))
    return BuildParams(kind, partitions, ef_construction=64)


@dataclass(frozen=True)
class Knobs:
    """probes: partitions looked into; without it as many as the build found to be enough."""

    top_k: int = 10
    probes: int | None = None
    ef_search: int | None = None

    def check(self) -> None:
        if not 1 <= self.top_k <= MAX_TOP_K:
            raise SchemaViolation(f"top_k must be from 1 to {MAX_TOP_K}")
        if self.probes is not None and self.probes < 1:
            raise SchemaViolation("probes must be greater than zero")
        if self.ef_search is not None and self.ef_search < self.top_k:
            raise SchemaViolation("ef_search must not be below top_k")


def naive_knobs(top_k: int) -> Knobs:
    return Knobs(top_k, 4, max(64, top_k))


def calibration_grid(top_k: int) -> list[Knobs]:
    """The knobs that are tried, the naive ones first; equal neighbours are one."""
    least = max(top_k, 16)
    tried = [naive_knobs(top_k), *(Knobs(top_k, p, least * m) for p in (1, 2) for m in (1, 2, 4)), Knobs(top_k, 4, max(4 * top_k, 32))]
    return [k for k, _ in groupby(tried)]


def choose(candidates: list[tuple[Knobs, float]], slack: float = 0.01) -> Knobs:
    """The cheapest knobs whose recall is not far below the naive ones' (the first); else those with the best recall."""
    bar = candidates[0][1] - slack
    cost = lambda k: (k.probes * k.ef_search, k.probes, k.ef_search)
    good = [k for k, recall in candidates if recall >= bar]
    return min(good, key=cost) if good else max(candidates, key=lambda c: c[1])[0]


def sweep_grid() -> list[Knobs | None]:
    """The knobs of a sweep: automatic, then probes by ef."""
    return [None, *(Knobs(10, p, ef) for p in (1, 2, 4) for ef in (64, 128))]
