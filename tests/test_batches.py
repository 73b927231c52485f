"""Many queries at once: what a task keeps in memory, and the neighbours that it finds."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearfold.operators import search as S
from nearfold.operators.index import CodeBooks, VectorIndex
from nearfold.types import Metric


class Rows:
    """Stands for a DataFrame: mapInArrow gives the function that a task would run."""

    def __init__(self):
        context = SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x), defaultParallelism=4)
        self.sparkSession = SimpleNamespace(sparkContext=context)

    def select(self, *names):
        return self

    repartition = select

    def mapInArrow(self, f, schema):
        return f


def peak_mb(task, batch):
    tracemalloc.start()
    try:
        found = list(task(iter([batch])))
        return tracemalloc.get_traced_memory()[1] / 1e6, sum(b.num_rows for b in found)
    finally:
        tracemalloc.stop()


N, DIM, K = 6_000, 8, 10


@pytest.fixture
def data(monkeypatch):
    monkeypatch.setattr(S, "merged_best", lambda found, k: found)
    x = np.random.default_rng(1).normal(size=(N, DIM))
    ids, vectors = pa.array(np.arange(N)), pa.ListArray.from_arrays(np.arange(0, N * DIM + 1, DIM, dtype=np.int32), pa.array(x.astype(np.float32).ravel()))
    return ids, vectors, list(enumerate(x.tolist()))


def test_a_task_works_in_tiles(data):
    ids, vectors, queries = data
    task = S.batch_knn(Rows(), queries, Metric.COSINE, K, digits=6)
    mb, rows = peak_mb(task, pa.RecordBatch.from_arrays([ids, vectors], names=["id", "vector"]))
    assert rows == N * K and mb < 150  # all distances of 4,096 rows to the queries alone are 197 MB


@pytest.mark.parametrize("kind", ["whole", "codes"])
def test_an_index_works_in_tiles(data, kind, monkeypatch):
    ids, vectors, queries = data
    rng = np.random.default_rng(2)
    books = [rng.normal(size=(256, 2)) for _ in range(4)]
    assert CodeBooks(books).encode(np.zeros((1, DIM))).shape == (1, 4)
    codes = pa.array([c.tobytes() for c in rng.integers(0, 256, (N, 4)).astype(np.uint8)], pa.binary())
    about = {"centres": rng.normal(size=(2, DIM)).tolist(), "books": [b.tolist() for b in books] if kind == "codes" else None, "probes": 2, "again": 2}
    index = object.__new__(VectorIndex)
    index.spark, index.metric, index.dimension = Rows().sparkSession, Metric.COSINE, DIM
    for name, f in {"_about": lambda: about, "_late": lambda a: None, "_parts": lambda a, p: Rows(), "_batch": lambda a, q, k, p: index._ranked(a, q, k, p)}.items():
        monkeypatch.setattr(index, name, f, raising=False)
    cells = pa.array((np.arange(N) % 2).astype(np.int32))
    mb, rows = peak_mb(index.query_batch(queries), pa.RecordBatch.from_arrays([ids, vectors if kind == "whole" else codes, cells], names=["id", "v", "partition_id"]))
    assert rows == N * K and mb < 150  # half of the rows by all queries are 144 MB, and were copied several times


def test_blocks_have_room_for_neighbours():
    queries = S.Queries(np.arange(20_000), np.zeros((20_000, 4), np.float32))
    for k in (1, 1_000):
        blocks = queries.blocks(k)
        assert sum(map(len, blocks)) == 20_000 and max(map(len, blocks)) * 8 * max(4, 2 * k) <= S.QUERY_BYTES
    assert list(queries[:2]) == [(0, [0.0] * 4), (1, [0.0] * 4)]


@pytest.mark.parametrize("k", [1, 3, 40, 500])
@pytest.mark.parametrize("metric", list(Metric))
@pytest.mark.parametrize("zero_norm", [1.0, float("inf")])
def test_neighbours_with_ties(k, metric, zero_norm, monkeypatch):
    monkeypatch.setattr(S, "TILE_ROWS", 64)
    monkeypatch.setattr(S, "TILE", 1_000)
    rng = np.random.default_rng(k)
    x = rng.integers(-1, 2, size=(400, 3)).astype(float)  # many equal, some zero
    x[5, 1] = np.nan
    ids, q = rng.permutation(400), rng.normal(size=(30, 3))
    best = S.Best(30, k, 6)
    who = np.flatnonzero(np.arange(30) % 3)  # the others see no rows
    for part in np.split(np.arange(400), [1, 150]):
        best.scan(who, S.Side(metric, q), ids[part], S.Side(metric, x[part]), zero_norm)
    found = {}
    for b in best.batches(np.arange(100, 130)):
        for r in b.to_pylist():
            found.setdefault(r["query_id"], []).append((r["id"], r["distance"]))
    assert sorted(found) == [100 + i for i in who]
    for i in who:
        size = np.sqrt((x * x).sum(1) * (q[i] @ q[i]))
        d = {Metric.DOT: -(x @ q[i]), Metric.L2: ((x - q[i]) ** 2).sum(1), Metric.COSINE: np.where(size == 0, zero_norm, 1 - x @ q[i] / np.where(size == 0, 1, size))}[metric]
        d = np.round(d, 6) + 0.0
        order = np.lexsort((ids, d))[:k]
        assert [n for n, _ in found[100 + i]] == ids[order].tolist()
        assert np.allclose([y for _, y in found[100 + i]], d[order], atol=1e-9, equal_nan=True)


def test_many_queries_are_dealt_over_the_cores(spark):
    """One file's rows are the work of every core, and the rows found are those of few queries."""
    rows = spark.range(0, 1_200, 1, 1).select("id", F.array(*[F.sin(F.col("id") * (i + 1)) for i in range(4)]).alias("vector"))
    queries = S.Queries.collect(rows)
    assert S.spread(rows, queries).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and S.spread(rows, queries[:9]).rdd.getNumPartitions() == 1
    some = lambda q: sorted(tuple(r) for r in S.batch_knn(rows, q, Metric.L2, 3, digits=6).where("query_id < 9").collect())
    assert some(queries) == some(list(queries[:9])) and len(some(queries[:9])) == 27
