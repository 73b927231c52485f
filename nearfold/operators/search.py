"""Exact nearest neighbours: one query as a lazily planned DataFrame, many queries as matrix products."""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DimensionMismatch, SchemaViolation
from ..functions.distance import Side, distance_to
from ..functions.values import metadata_json
from ..plans.admission import GATE, AdmissionGate
from ..plans.predicates import Predicate, compile_predicate, from_json, selectivity_categories, validate
from ..types import MetadataSchema, Metric, SearchOptions, TableSpec

#: Bytes of query vectors, or of their neighbours so far, that one block of queries takes; more queries take more blocks.
QUERY_BYTES = 64 << 20
#: Rows and distances (of some of the queries to those rows) that a task works on at a time, whatever the number of queries.
TILE_ROWS, TILE = 8_192, 1 << 20
#: From so many queries on, products take far longer than moving the rows, so rows are dealt evenly to the cores first.
SPREAD = 1_024


def nearest(rows: DataFrame, query: list[float], metric: Metric, k: int, zero_norm: float = 1.0, digits: int | None = None, tie: list[str] | None = None) -> DataFrame:
    """rows with their distance, the k nearest; ties by id and then by generation where there is one. Plans as a top-k, not a sort."""
    d = distance_to(metric, F.col("vector"), query, zero_norm)
    d = d if digits is None else F.round(d, digits) + F.lit(0.0)
    keys = ["id", *(["generation"] if "generation" in rows.columns else [])] if tie is None else tie
    return rows.withColumn("distance", d).orderBy("distance", *keys).limit(k)


def visible(log: DataFrame, tombstones: DataFrame | None) -> DataFrame:
    """The rows of a log whose (id, generation) has no tombstone."""
    return log if tombstones is None else log.join(tombstones.select("id", "generation"), ["id", "generation"], "left_anti")


def hidden_by_id(log: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The rows whose id ever had a tombstone, inserted again or not."""
    return log.join(tombstones.select("id").distinct(), "id", "left_semi")


def check_query(spec: TableSpec, query: list[float], predicate: Predicate | None) -> None:
    if len(query) != spec.dimension:
        raise DimensionMismatch(spec.dimension, len(query))
    if predicate is not None:
        validate(predicate, spec.schema)


def search(spec: TableSpec, log: DataFrame, tombstones: DataFrame | None, query: list[float], predicate: Predicate | None = None, options: SearchOptions = SearchOptions(), gate: AdmissionGate = GATE) -> DataFrame:
    """id, distance, vector and metadata of the nearest visible rows that the predicate lets through.

    Checks come in this order: dimension, predicate, permit. The permit is held while the plan is made; `collect_search`
    holds it while the job runs.
    """
    check_query(spec, query, predicate)
    with gate.permit():
        rows = visible(log, tombstones)
        if predicate is not None:
            rows = rows.where(compile_predicate(predicate, spec.schema))
        found = nearest(rows, query, spec.metric, options.top_k)
        return found.select("id", "distance", "vector", *[f"`{c}`" for c in spec.schema.names])


def collect_search(spec: TableSpec, log: DataFrame, tombstones: DataFrame | None, query: list[float], predicate: Predicate | None = None, options: SearchOptions = SearchOptions(), gate: AdmissionGate = GATE) -> list:
    check_query(spec, query, predicate)
    with gate.permit():
        return search(spec, log, tombstones, query, predicate, options, AdmissionGate(1)).collect()


def exact_search(spec: TableSpec, log: DataFrame, query: list[float], k: int, predicate: Predicate | None = None) -> DataFrame:
    """The same over all rows, hidden ones too, and for any k of at least 1."""
    if k < 1:
        raise SchemaViolation("top_k must be greater than zero")
    check_query(spec, query, predicate)
    rows = log if predicate is None else log.where(compile_predicate(predicate, spec.schema))
    return nearest(rows, query, spec.metric, k).select("id", "distance", "vector", *[f"`{c}`" for c in spec.schema.names])


def hits(found: DataFrame, schema: MetadataSchema) -> DataFrame:
    """id, distance and the metadata as JSON."""
    return found.select("id", "distance", metadata_json(schema).alias("metadata_json"))


def search_json(spec: TableSpec, log: DataFrame, tombstones: DataFrame | None, query: list[float], k: int = 10, predicate_json: str | None = None, probes: int | None = None, ef_search: int | None = None) -> DataFrame:
    """search with a predicate as JSON, as hits."""
    options = SearchOptions(k, probes, ef_search)
    return hits(search(spec, log, tombstones, query, from_json(predicate_json, spec.schema), options), spec.schema)


def profile(spec: TableSpec, log: DataFrame, tombstones: DataFrame | None, query: list[float], k: int = 10, predicate: Predicate | None = None) -> dict:
    """Rows in all, matched, scanned and returned, and the microseconds that the phases took."""
    options = SearchOptions(k)
    check_query(spec, query, predicate)
    total = log.count()
    begin = time.perf_counter()
    rows = visible(log, tombstones)
    rows = rows if predicate is None else rows.where(compile_predicate(predicate, spec.schema))
    matched = rows.count()
    middle = time.perf_counter()
    returned = len(nearest(rows, query, spec.metric, options.top_k).select("id", "distance").collect())
    end = time.perf_counter()
    return {"total_rows": total, "matched_rows": matched, "scanned_rows": matched, "returned_rows": returned, "filter_us": int((middle - begin) * 1e6), "rank_us": int((end - middle) * 1e6)}


def profile_counts(log: DataFrame, tombstones: DataFrame | None, predicate: Column, k: int) -> DataFrame:
    """The counts of `profile` as one row, in one job."""
    rows = log.withColumn("matches", predicate)
    if tombstones is not None:
        gone = tombstones.select("id", "generation").distinct().withColumn("gone", F.lit(True))
        rows = rows.join(gone, ["id", "generation"], "left")
    else:
        rows = rows.withColumn("gone", F.lit(None).cast("boolean"))
    matched = F.count_if(F.col("matches") & F.col("gone").isNull())
    return rows.agg(F.count(F.lit(1)).alias("total_rows"), matched.alias("matched_rows")).withColumn("returned_rows", F.least("matched_rows", F.lit(k).cast("long")))


BEST = "query_id long, id long, distance double"


@dataclass(frozen=True)
class Queries:
    """Ids and vectors (a row each) of many queries."""

    names: np.ndarray
    vectors: np.ndarray

    @classmethod
    def of(cls, queries: Queries | list[tuple[int, list[float]]]) -> Queries:
        return queries if isinstance(queries, Queries) else cls(np.array([q for q, _ in queries], np.int64), np.array([v for _, v in queries], np.float64))

    @classmethod
    def collect(cls, rows: DataFrame) -> Queries:
        """The rows (id, vector) in the order of their ids."""
        got = rows.select("id", "vector").toArrow().combine_chunks().sort_by("id")
        vectors = got["vector"].combine_chunks()
        return cls(got["id"].to_numpy().astype(np.int64), vectors.flatten().to_numpy().reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0)))

    def __len__(self) -> int:
        return len(self.names)

    def __getitem__(self, some: slice) -> Queries:
        return Queries(self.names[some], self.vectors[some])

    def __iter__(self):
        return zip(self.names.tolist(), map(np.ndarray.tolist, self.vectors))

    def blocks(self, k: int) -> list[Queries]:
        """Blocks whose vectors, and k neighbours so far, take QUERY_BYTES each at most."""
        each = max(1, QUERY_BYTES // (8 * max(self.vectors.shape[1], 2 * k)))
        return [self[at : at + each] for at in range(0, len(self), each)]


class Best:
    """The k nearest rows of each of n queries so far; distances are rounded to digits before they are compared."""

    def __init__(self, n: int, k: int, digits: int | None = None):
        self.k, self.digits = k, digits
        self.have = np.zeros(n, np.int64)
        self.ids, self.near = np.zeros((n, k), np.int64), np.full((n, k), np.nan)

    def add(self, who: np.ndarray, ids: np.ndarray, distances: np.ndarray) -> None:
        """Rows with their distances to the queries numbered who, a line of distances for each of those."""
        slack = 0.0 if self.digits is None else 10.0**-self.digits
        bars = np.where(self.have[who] == self.k, self.near[who, -1], np.nan)  # nothing is above NaN
        if len(ids) > 4 * self.k and np.isnan(bars).any():  # all but the k nearest and their ties go at once
            bars = np.fmin(bars, np.partition(distances, self.k - 1, axis=1)[:, self.k - 1])
        at, some = np.nonzero(~(distances > (bars + slack)[:, None]))
        if not len(at):
            return
        near = distances[at, some]
        near = near if self.digits is None else np.round(near, self.digits) + 0.0
        fresh, at = np.unique(at, return_inverse=True)
        old = who[fresh]
        known = np.arange(self.k) < self.have[old][:, None]
        at, own, near = np.r_[at, np.nonzero(known)[0]], np.r_[ids[some], self.ids[old][known]], np.r_[near, self.near[old][known]]
        order = np.lexsort((own, near, at))
        at, own, near = at[order], own[order], near[order]
        count = np.bincount(at, minlength=len(old))
        place = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        best = place < self.k
        self.ids[old[at[best]], place[best]], self.near[old[at[best]], place[best]] = own[best], near[best]
        self.have[old] = np.minimum(count, self.k)

    def scan(self, who: np.ndarray, queries: Side, ids: np.ndarray, rows: Side, zero_norm: float = 1.0) -> None:
        """Adds rows for the queries numbered who, a tile of distances at a time."""
        ids = ids.astype(np.int64, copy=False)
        for i in range(0, len(rows), TILE_ROWS):
            part = rows[i : i + TILE_ROWS]
            each = max(1, TILE // len(part))
            for j in range(0, len(who), each):
                self.add(who[j : j + each], ids[i : i + TILE_ROWS], queries[who[j : j + each]].distances(part, zero_norm))

    def batches(self, names: np.ndarray):
        each = max(1, TILE // self.k)
        for i in range(0, len(names), each):
            have = self.have[i : i + each]
            known = np.arange(self.k) < have[:, None]
            if have.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names[i : i + each], have)), pa.array(self.ids[i : i + each][known]), pa.array(self.near[i : i + each][known])], names=["query_id", "id", "distance"])


def spread(rows: DataFrame, queries: Queries) -> DataFrame:
    """rows, a like number of them for each core where there are many queries."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism) if len(queries) >= SPREAD else rows


def merged_best(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank (from 1), id, distance of the k nearest of each query; ties by id."""
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def batch_knn(rows: DataFrame, queries: Queries | list[tuple[int, list[float]]], metric: Metric, k: int, zero_norm: float = 1.0, digits: int | None = None) -> DataFrame:
    """query_id, rank (from 1), id, distance: the k nearest rows of every query; ties by id.

    Each task multiplies its Arrow batches with a block of queries, tile by tile, keeps k rows a query, and one shuffle
    of those by query_id merges the tasks' results. More queries than QUERY_BYTES hold take more blocks.
    """
    queries = Queries.of(queries)
    if not len(queries):
        return rows.sparkSession.createDataFrame([], "query_id long, rank long, id long, distance double")
    rows = spread(rows.select("id", "vector"), queries)
    parts = [_knn_block(rows, block, metric, k, zero_norm, digits) for block in queries.blocks(k)]
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    return merged_best(found, k)


def _knn_block(rows: DataFrame, queries: Queries, metric: Metric, k: int, zero_norm: float, digits: int | None) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((queries.names, queries.vectors))

    def of(batches):
        names, vectors = shared.value
        best, everyone, asked = Best(len(names), k, digits), np.arange(len(names)), Side(metric, vectors)
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                best.scan(everyone, asked, batch.column(0).to_numpy(zero_copy_only=False), Side(metric, x), zero_norm)
        yield from best.batches(names)

    return rows.mapInArrow(of, BEST)


def ground_truth(rows: DataFrame, queries: Queries | list[tuple[int, list[float]]], metric: Metric, k: int, zero_norm: float = float("inf"), digits: int | None = None) -> DataFrame:
    """query_id, ids and distances as arrays, the nearest first."""
    found = batch_knn(rows, queries, metric, k, zero_norm, digits)
    packed = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "distance"))).alias("all"))
    return packed.select("query_id", F.col("all.id").alias("ids"), F.col("all.distance").alias("distances"))


def filtered_knn(rows: DataFrame, queries, metric: Metric, k: int, selectivity: float, categories: int, column: str = "category", **options) -> DataFrame:
    """batch_knn over the categories of a selectivity tier."""
    keep = selectivity_categories(selectivity, categories)
    return batch_knn(rows if keep is None else rows.where(F.col(column).isin(keep)), queries, metric, k, **options)
