"""Approximate search: coarse partitions by k-means, with whole vectors (IVF) or product-quantised codes (IVF-PQ).

The rows of an index lie in folders by partition, so that a query's probes prune folders. The graph kind keeps whole
vectors and scans the probed partitions exactly: its recall is at least that of a graph over them, and ef_search is
checked but bounds nothing. The quantised kind ranks the probed partitions by codes and the best of them again by exact
distance. A build asks the new index for the neighbours of some stored rows and keeps how many probes, and how many
candidates for each neighbour, reach RECALL over all rows; queries that name no probes use those. Rows written after
the build are scanned by every query.
"""

from __future__ import annotations

import json
import threading
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DimensionMismatch, SchemaViolation
from ..functions.distance import Side, distance, matrix_distances
from ..plans import ladder as L
from ..types import Metric
from . import search as S
from .table import _Store

#: Rows that k-means is fitted on at most, for the coarse partitions and each code book.
TRAIN_ROWS = 100_000
ROWS = "id long, vector array<float>"
#: Mean recall of TESTED stored rows' ten neighbours that a build's defaults reach, and the candidates for each neighbour that it tries.
RECALL, TESTED, AGAIN = 0.97, 64, (5, 10, 20, 40, 80)
#: Rows of one file of an index.
FILE_ROWS = 500_000
#: Digits of the distances by codes that count.
CODE_DIGITS = 9


def kmeans(points: np.ndarray, k: int, seed: int = 17, rounds: int = 15) -> np.ndarray:
    """Lloyd's centres from k-means++ starts; the same for the same points in the same order."""
    rng = np.random.default_rng(seed)
    points = points.astype(np.float64)
    k = min(k, len(points))
    centres = points[[int(rng.integers(len(points)))]]
    near = ((points - centres[0]) ** 2).sum(1)
    while len(centres) < k:
        total = near.sum()
        at = int(np.searchsorted(np.cumsum(near), rng.random() * total)) if total > 0 else int(rng.integers(len(points)))
        centres = np.vstack([centres, points[min(at, len(points) - 1)]])
        near = np.minimum(near, ((points - centres[-1]) ** 2).sum(1))
    for _ in range(rounds):
        own = matrix_distances(Metric.L2, points, centres).argmin(1)
        count = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, points[:, d], k) for d in range(points.shape[1])], axis=1)
        fresh = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
        if np.allclose(fresh, centres):
            break
        centres = fresh
    return centres


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def prepared(metric: Metric, x: np.ndarray) -> np.ndarray:
    """Vectors as the index sees them: of unit length for cosine."""
    x = x.astype(np.float64)
    return _unit(x) if metric is Metric.COSINE else x


def sample_matrix(rows: DataFrame, most: int = TRAIN_ROWS) -> np.ndarray:
    """A bounded sample, chosen by a hash of the id, in the order of that hash."""
    got = rows.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(most).toArrow()
    return np.array(got["vector"].to_pylist(), np.float64).reshape(got.num_rows, -1 if got.num_rows else 1)


def assign(rows: DataFrame, centres: np.ndarray, metric: Metric) -> DataFrame:
    """rows (id, vector) with the number of the nearest centre; ties to the lowest number."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def of(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                own = matrix_distances(Metric.L2, prepared(metric, x), shared.value).argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own.astype(np.int32))], names=["id", "vector", "partition_id"])

    return rows.select("id", "vector").mapInArrow(of, ROWS + ", partition_id int")


def label_centres(rows: DataFrame, label: str, dim: int) -> DataFrame:
    """The mean vector of each label, as one row of doubles; plain aggregation over every row."""
    means = [F.avg(F.col("vector")[i].cast("double")) for i in range(dim)]
    return rows.groupBy(F.col(label).cast("long").alias("centre_id")).agg(F.array(*means).alias("centre"))


def probe_order(metric: Metric, centres: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Centres from the nearest on; ties to the lowest number."""
    d = matrix_distances(Metric.L2, centres, prepared(metric, query[None, :]))[:, 0]
    return np.lexsort((np.arange(len(d)), d))


class CodeBooks:
    """Product quantisation: a code book for each part of the vector."""

    def __init__(self, books: list[np.ndarray]):
        self.books = books

    @classmethod
    def fit(cls, points: np.ndarray, sub_vectors: int, codes: int = 256, seed: int = 23) -> CodeBooks:
        return cls([kmeans(part, codes, seed + i, 8) for i, part in enumerate(np.split(points, sub_vectors, axis=1))])

    def encode(self, x: np.ndarray) -> np.ndarray:
        parts = np.split(x, len(self.books), axis=1)
        return np.stack([matrix_distances(Metric.L2, p, b).argmin(1) for p, b in zip(parts, self.books)], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that the codes stand for."""
        return np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], axis=1)


class VectorIndex:
    """Rows (id, vector) in a folder and at most one index over them."""

    def __init__(self, spark: SparkSession, root: str, dimension: int, metric: Metric = Metric.COSINE, forced: str | None = None):
        if dimension < 1:
            raise SchemaViolation("dimension must be greater than zero")
        self.spark, self.root, self.dimension, self.metric = spark, root.rstrip("/"), dimension, metric
        self.forced = forced
        self.store = _Store(spark, self.root)
        self._lock = threading.Lock()
        self.build_state, self.build_error = "idle", None
        self._thread: threading.Thread | None = None

    # rows

    def write(self, rows: DataFrame) -> None:
        """Appends rows; duplicates are kept; they are found by the next query, index or not."""
        rows = rows.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector"))
        wrong = rows.agg(F.max(F.when(F.coalesce(F.size("vector"), F.lit(-1)) != self.dimension, F.coalesce(F.size("vector"), F.lit(-1)))).alias("n"), F.count(F.lit(1)).alias("rows")).first()
        if wrong["n"] is not None:
            raise DimensionMismatch(self.dimension, wrong["n"])
        if wrong["rows"]:
            rows.write.parquet(f"{self.root}/rows/{uuid.uuid4().hex}")

    def rows(self) -> DataFrame:
        names = sorted(self.store.names("rows"))
        if not names:
            return self.spark.createDataFrame([], ROWS)
        return self.spark.read.schema(ROWS).parquet(*[f"{self.root}/rows/{n}" for n in names])

    def row_count(self) -> int:
        return self.rows().count()

    def fetch_rows(self, limit: int) -> DataFrame:
        return self.rows().orderBy("id").limit(limit)

    # index

    def index_names(self) -> list[str]:
        return sorted(n for n in self.store.names("index") if n.endswith(".json"))

    def remove_indexes(self) -> int:
        names = self.index_names()
        self.store.delete("index")
        return len(names)

    def build(self, params: L.BuildParams) -> None:
        params.check(self.dimension)
        rows = self.rows()
        points = prepared(self.metric, sample_matrix(rows))
        if params.kind == L.IVF_PQ and len(points) < L.PQ_MIN_ROWS:
            raise SchemaViolation(f"product quantisation needs {L.PQ_MIN_ROWS} rows, there are {len(points)}")
        if not len(points):
            raise SchemaViolation("there are no rows to index")
        centres = kmeans(points, params.partitions)
        placed, books = assign(rows, centres, self.metric), None
        folder = f"index/{uuid.uuid4().hex}"
        if params.kind == L.IVF_PQ:
            books = CodeBooks.fit(points[:20_000], params.sub_vectors)
            shared, metric = self.spark.sparkContext.broadcast(books), self.metric

            def code(batches):
                for batch in batches:
                    if batch.num_rows:
                        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                        codes = shared.value.encode(prepared(metric, x))
                        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), *batch.columns[1:]], names=["id", "codes", "vector", "partition_id"])

            placed = placed.mapInArrow(code, "id long, codes binary, vector array<float>, partition_id int")
        files = params.partitions * max(1, -(-rows.count() // (params.partitions * FILE_ROWS)))
        own = F.pmod(F.xxhash64("id"), F.lit(files // params.partitions))  # a large partition is no single task
        placed = placed.repartition(files, "partition_id", own).sortWithinPartitions("partition_id", "id")
        placed.write.partitionBy("partition_id").parquet(f"{self.root}/{folder}")
        about = {"kind": params.kind, "folder": folder, "covered": sorted(self.store.names("rows")), "centres": centres.tolist(), "books": [b.tolist() for b in books.books] if books else None}
        about |= self._enough(about)
        for name in self.index_names():
            self.store.delete(f"index/{name}")
        self.store.create(f"index/{params.kind}-{uuid.uuid4().hex}.json", json.dumps(about))

    def _enough(self, about: dict) -> dict:
        """The fewest probes, and candidates for each neighbour, with which an index reaches RECALL; measured against all rows."""
        rows, k = self.rows(), 10
        asked = rows.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(TESTED).collect()
        queries = S.Queries.of([(i, r["vector"]) for i, r in enumerate(asked)])
        truth = {(r["query_id"], r["id"]) for r in S.batch_knn(rows, queries, self.metric, k).collect()}
        size = np.bincount([q for q, _ in truth], minlength=len(queries))
        # the cell of each true neighbour: one scan of two columns
        ids = self.spark.createDataFrame([(int(i),) for i in {i for _, i in truth}], "id long")
        lies: dict[int, list[int]] = {}
        for r in self._parts(about, range(len(about["centres"]))).select("id", "partition_id").join(F.broadcast(ids), "id").collect():
            lies.setdefault(r["id"], []).append(r["partition_id"])
        centres = np.array(about["centres"])
        place = [np.argsort(probe_order(self.metric, centres, np.array(v, np.float64))) for _, v in queries]
        needed = {(q, i): 1 + min(int(place[q][c]) for c in lies[i]) for q, i in truth}
        coded = dict.fromkeys(truth, 0)
        if about["books"] is not None:
            coded = dict.fromkeys(truth, 1 + AGAIN[-1] * k)
            for r in self._ranked(about, queries, AGAIN[-1] * k, len(centres)).collect():
                if (at := (r["query_id"], r["id"])) in truth:
                    coded[at] = min(coded[at], r["rank"])

        def recall(probes: int, again: int) -> float:  # fewer probes only take rivals away, so this is the least that is found
            hits = np.bincount([at[0] for at in truth if needed[at] <= probes and coded[at] <= again * k], minlength=len(queries))
            return float((hits / size).mean())

        again = next((n for n in AGAIN if recall(len(centres), n) >= RECALL), AGAIN[-1])
        bar = min(RECALL, recall(len(centres), again))
        return {"probes": next(p for p in range(1, len(centres) + 1) if recall(p, again) >= bar), "again": again}

    def _about(self) -> dict | None:
        names = self.index_names()
        return json.loads(self.store.read(f"index/{names[0]}")) if names else None

    def query(self, vector: list[float], knobs: L.Knobs = L.Knobs()) -> DataFrame:
        """id and distance of the rows found near a vector; every row without an index, the probed partitions with one."""
        knobs.check()
        if len(vector) != self.dimension:
            raise DimensionMismatch(self.dimension, len(vector))
        about = self._about()
        if about is None:
            return S.nearest(self.rows(), vector, self.metric, knobs.top_k).select("id", "distance")
        if about["books"] is not None:
            return self._batch(about, S.Queries.of([(0, vector)]), knobs.top_k, knobs.probes).orderBy("rank").select("id", "distance")
        probed = probe_order(self.metric, np.array(about["centres"]), np.array(vector, np.float64))[: knobs.probes or about["probes"]]
        rows = self._parts(about, probed).select("id", "vector")
        late = self._late(about)
        return S.nearest(rows if late is None else rows.union(late), vector, self.metric, knobs.top_k).select("id", "distance")

    def query_batch(self, queries: S.Queries | list[tuple[int, list[float]]], knobs: L.Knobs = L.Knobs()) -> DataFrame:
        """query_id, rank (from 1), id and distance of what query() finds for each of many vectors, in one job."""
        knobs.check()
        for n in {queries.vectors.shape[1]} if isinstance(queries, S.Queries) and len(queries) else {len(v) for _, v in queries}:
            if n != self.dimension:
                raise DimensionMismatch(self.dimension, n)
        about = self._about()
        if about is None or not len(queries):
            return S.batch_knn(self.rows(), queries, self.metric, knobs.top_k)
        # the candidates that a task keeps for a block count for its size
        blocks = S.Queries.of(queries).blocks(knobs.top_k * (about["again"] if about["books"] else 1))
        parts = [self._batch(about, block, knobs.top_k, knobs.probes) for block in blocks]
        found = parts[0]
        for part in parts[1:]:
            found = found.union(part)
        return found

    def _parts(self, about: dict, probed) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{about['folder']}").where(F.col("partition_id").isin([int(p) for p in probed]))

    def _late(self, about: dict) -> DataFrame | None:
        """Rows written after the build."""
        late = sorted(set(self.store.names("rows")) - set(about["covered"]))
        return self.spark.read.schema(ROWS).parquet(*[f"{self.root}/rows/{n}" for n in late]) if late else None

    def _asked(self, about: dict, queries: S.Queries, probes: int | None) -> np.ndarray:
        """Whether each query looks into each partition."""
        centres = np.array(about["centres"])
        asked = np.zeros((len(queries), len(centres)), bool)
        for i in range(0, len(queries), S.TILE_ROWS):
            d = matrix_distances(Metric.L2, prepared(self.metric, queries.vectors[i : i + S.TILE_ROWS]), centres)
            np.put_along_axis(asked[i : i + S.TILE_ROWS], np.argsort(d, axis=1, kind="stable")[:, : probes or about["probes"]], True, axis=1)
        return asked

    def _ranked(self, about: dict, queries: S.Queries, wanted: int, probes: int | None) -> DataFrame:
        """query_id, rank, id and distance of the best rows of the probed partitions, by exact distance or by that of codes."""
        metric, asked = self.metric, self._asked(about, queries, probes)
        books = CodeBooks([np.array(b) for b in about["books"]]) if about["books"] is not None else None
        # vectors that codes stand for are not quite of unit length; rows of equal codes tie, whatever the products' last digits
        by, digits = (metric, None) if books is None else (Metric.L2 if metric is Metric.L2 else Metric.DOT, CODE_DIGITS)
        shared = self.spark.sparkContext.broadcast((queries.names, queries.vectors, asked, books))

        def of(batches):
            names, vectors, asked, books = shared.value
            sought = Side(by, vectors if books is None else prepared(metric, vectors))
            best = S.Best(len(names), wanted, digits)
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2))
                if books is None:
                    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                else:
                    x = books.decode(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1))
                for cell in np.unique(own):
                    at = np.flatnonzero(own == cell)
                    best.scan(np.flatnonzero(asked[:, cell]), sought, ids[at], Side(by, x[at]))
            yield from best.batches(names)

        parts = self._parts(about, np.flatnonzero(asked.any(axis=0))).select("id", "vector" if books is None else "codes", "partition_id")
        return S.merged_best(S.spread(parts, queries).mapInArrow(of, S.BEST), wanted)

    def _batch(self, about: dict, queries: S.Queries, k: int, probes: int | None) -> DataFrame:
        if about["books"] is None:
            found = self._ranked(about, queries, k, probes)
        else:  # ranked again by exact distance; an id may stand for several rows
            named = self._ranked(about, queries, k * about["again"], probes).select("query_id", "id").distinct()
            lists = pa.FixedSizeListArray.from_arrays(pa.array(queries.vectors.astype(np.float64).ravel()), self.dimension).cast(pa.list_(pa.float64()))
            vectors = self.spark.createDataFrame(pa.table({"query_id": pa.array(queries.names), "query": lists}))
            probed = np.flatnonzero(self._asked(about, queries, probes).any(axis=0))
            exact = self._parts(about, probed).select("id", "vector").join(named, "id").join(F.broadcast(vectors), "query_id")
            found = S.merged_best(exact.select("query_id", "id", distance(self.metric, F.col("vector"), F.col("query")).alias("distance")), k)
        late = self._late(about)
        if late is None:
            return found
        return S.merged_best(found.union(S.batch_knn(late, queries, self.metric, k)).select("query_id", "id", "distance"), k)

    # ladder

    def apply_ladder(self) -> str:
        """Builds what the row count (or a forced kind) asks for: not_needed, built, started or already_in_progress."""
        n = self.row_count()
        kind = L.ladder_choice(n, self.forced)
        how = L.build_disposition(kind, n)
        if how == "not_needed":
            return how
        with self._lock:
            if self.build_state == "in_progress":
                return "already_in_progress"
            self.build_state, self.build_error = "in_progress", None
        if how == "inline":
            self._build(L.default_params(kind, self.dimension, n), again=True)
            return "built"
        self._thread = threading.Thread(target=self._build, args=(L.default_params(kind, self.dimension, n),), name="index-build", daemon=True)
        self._thread.start()
        return "started"

    def _build(self, params: L.BuildParams, again: bool = False) -> None:
        try:
            self.build(params)
            self.build_state = "completed"
        except Exception as e:
            self.build_state, self.build_error = "failed", str(e)
            if again:
                raise

    def wait(self) -> str:
        if self._thread:
            self._thread.join()
        return self.build_state

    # calibration

    def calibration(self, top_k: int) -> list[tuple[L.Knobs, float]]:
        """The recall of every knob of the grid over evenly spaced stored rows."""
        L.Knobs(top_k).check()
        stored = self.fetch_rows(L.CALIBRATION_ROWS)
        n = stored.count()
        if not n:
            return []
        count = min(L.CALIBRATION_QUERIES, n)
        queries = [(r["id"], r["vector"]) for r in every(stored, n // count, "id").limit(count).collect()]
        queries = list(enumerate(v for _, v in queries))
        truth: dict[int, set] = {}
        for r in S.batch_knn(stored, queries, self.metric, top_k).collect():
            truth.setdefault(r["query_id"], set()).add(r["id"])
        out, known = [], {}
        for knobs in L.calibration_grid(top_k):
            if knobs.probes not in known:  # ef has no effect on what is found
                found = [len(truth[i] & {r["id"] for r in self.query(v, knobs).collect()}) / len(truth[i]) for i, v in queries]
                known[knobs.probes] = sum(found) / len(found)
            out.append((knobs, known[knobs.probes]))
        return out

    def calibrate(self, top_k: int = 10) -> L.Knobs:
        found = self.calibration(top_k)
        return L.choose(found) if found else L.naive_knobs(top_k)


def every(rows: DataFrame, stride: int, *order: str) -> DataFrame:
    """Each stride-th row in the order of the columns, the first among them, by ranks over sorted partitions."""
    ranked = ranks(rows, *order)
    return ranked.where(F.col("rank") % stride == 0).drop("rank").orderBy(*order)


def ranks(rows: DataFrame, *order: str) -> DataFrame:
    """rows with their rank from 0 over all partitions: a sort, then offsets by the partitions' counts."""
    from ..functions.ranking import global_rank

    return global_rank(rows, list(order))
