import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfold.errors import DimensionMismatch, SchemaViolation
from nearfold.functions.distance import matrix_distances
from nearfold.operators import search as S
from nearfold.operators.index import VectorIndex
from nearfold.operators.session import Session
from nearfold.plans import ladder as L
from nearfold.types import Metric


def rows(spark, n=512, dim=16):
    return spark.createDataFrame([(r, [((31 * r + 7 * c) % 97) / 97 for c in range(dim)]) for r in range(n)], "id long, vector array<float>")


def test_ladder():
    want = {0: "exhaustive", 9_999: "exhaustive", 10_000: "hnsw", 999_999: "hnsw", 1_000_000: "ivf_pq"}
    assert {n: L.ladder_choice(n) for n in want} == want and L.ladder_choice(5, "ivf_pq") == "ivf_pq"
    assert [L.build_disposition(k, n) for k, n in (("hnsw", 49_999), ("hnsw", 50_000), ("exhaustive", 10**7))] == ["inline", "background", "not_needed"]
    assert L.default_params("ivf_pq", 24).sub_vectors == 8 and L.default_params("hnsw", 24).ef_construction == 64
    for p in (L.BuildParams("ivf_pq", 4, 5), L.BuildParams("hnsw", 0), L.BuildParams("hnsw", 4, 4), L.BuildParams("ivf_pq", 4)):
        with pytest.raises(SchemaViolation):
            p.check(16)


def test_grid_and_choice():
    grid = L.calibration_grid(10)
    assert grid[0] == L.Knobs(10, 4, 64) and len(grid) == 8 and all(k.ef_search >= 10 and 1 <= k.probes <= 4 for k in grid)
    assert L.choose([(grid[0], 0.9), (grid[1], 0.895), (grid[2], 0.5)]) == grid[1]
    assert len(L.sweep_grid()) == 7


def test_index(spark, tmp_path):
    index = VectorIndex(spark, f"file://{tmp_path}/i", 16, Metric.L2)
    q = [0.5] * 16
    assert index.query(q).collect() == [] and index.index_names() == [] and index.remove_indexes() == 0 and index.row_count() == 0
    with pytest.raises(SchemaViolation):
        index.build(L.BuildParams("hnsw"))
    index.write(rows(spark))
    exact = [(r["id"], r["distance"]) for r in index.query(q, L.Knobs(5)).collect()]
    index.build(L.BuildParams("hnsw", 2))
    assert [(r["id"], r["distance"]) for r in index.query(q, L.Knobs(5, 2, 16)).collect()] == exact  # all partitions probed
    index.write(spark.createDataFrame([(9999, q)], "id long, vector array<double>"))
    assert index.query(q, L.Knobs(5, 1, 16)).first()["id"] == 9999  # written after the build
    index.build(L.BuildParams("ivf_pq", 2, 4))
    assert len(index.index_names()) == 1
    found = index.query(q, L.Knobs(5, 2)).collect()
    assert len(found) == 5 and all(np.isfinite(r["distance"]) for r in found)
    assert index.remove_indexes() == 1 and index.query(q, L.Knobs(1)).first()["id"] == 9999
    for bad in (L.Knobs(10, 1, 4), L.Knobs(0), L.Knobs(1001), L.Knobs(5, 0)):
        with pytest.raises(SchemaViolation):
            index.query(q, bad)
    with pytest.raises(DimensionMismatch):
        index.query([0.1])
    with pytest.raises(DimensionMismatch):
        index.write(spark.createDataFrame([(1, [1.0])], "id long, vector array<float>"))


def test_apply_ladder_and_calibrate(spark, tmp_path):
    index = VectorIndex(spark, f"file://{tmp_path}/i", 16, Metric.COSINE)
    assert index.apply_ladder() == "not_needed" and index.calibrate(5) == L.naive_knobs(5)
    index.write(rows(spark, 300))
    index.forced = "hnsw"
    assert index.apply_ladder() == "built" and index.build_state == "completed"
    found = index.calibration(5)
    assert [k for k, _ in found] == L.calibration_grid(5) and found[0][1] == 1.0 and index.calibrate(5) == L.choose(found)


def test_batch_equals_single(spark):
    data = rows(spark, 200).withColumn("category", (F.col("id") % 4).cast("int"))
    queries = [(i, [float((i * c) % 5) for c in range(16)]) for i in range(4)]
    for metric in Metric:
        found = {}
        for r in S.batch_knn(data, queries, metric, 7).orderBy("query_id", "rank").collect():
            found.setdefault(r["query_id"], []).append(r["id"])
        for i, q in queries:
            one = [r["id"] for r in S.nearest(data, q, metric, 7, digits=9).select("id", "distance").collect()]
            x = np.array([r["vector"] for r in data.orderBy("id").collect()])
            d = matrix_distances(metric, x, np.array([q]))[:, 0]
            assert sorted(np.round(d[found.get(i, one)], 9)) == sorted(np.round(d[one], 9))
    assert S.batch_knn(data, [], Metric.L2, 3).count() == 0
    half = S.filtered_knn(data, queries, Metric.L2, 5, 0.5, 4).join(data, "id")
    assert {r["category"] for r in half.select("category").collect()} <= {0, 1}


def test_session(spark, tmp_path):
    s = Session(spark, f"file://{tmp_path}", 400, 16, 4)
    s.build()
    q = s.table.snapshot().log().where("id = 7").first()["vector"]
    found = s.query(q, 5, L.Knobs(5, 4, 64))
    assert found["recall"] == 1.0 and found["hits"][0]["id"] == 7
    assert s.bench([q], 1)["recall"] > 0.5 and s.status()["vectors"] == 400


def test_defaults_are_measured(spark, tmp_path):
    rng = np.random.default_rng(3)
    data = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(600, 16)))], "id long, vector array<float>")
    asked = [(i, r["vector"]) for i, r in enumerate(data.where("id % 20 = 0").collect())]
    truth = {(r["query_id"], r["id"]) for r in S.batch_knn(data, asked, Metric.COSINE, 10).collect()}
    for kind in (L.HNSW, L.IVF_PQ):
        index = VectorIndex(spark, f"file://{tmp_path}/{kind}", 16, Metric.COSINE)
        index.write(data.union(data.where("id < 3")))  # repeated ids
        index.build(L.default_params(kind, 16, 600))
        found = index.query_batch(asked).collect()
        assert len({(r["query_id"], r["id"]) for r in found} & truth) >= 0.9 * len(truth)
        one = [(r["id"], round(r["distance"], 9)) for r in index.query(asked[3][1]).collect()]
        assert one == [(r["id"], round(r["distance"], 9)) for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == 3]
        assert sum(r["id"] == 0 for r in index.query(asked[0][1]).collect()) == 2
        index.write(spark.createDataFrame([(9999, asked[3][1])], "id long, vector array<double>"))
        assert 9999 in {r["id"] for r in index.query_batch(asked[3:4], L.Knobs(5)).collect()}
    assert L.default_params(L.HNSW, 16, 10**7).partitions == 40 and L.default_params(L.HNSW, 16, 10**9).partitions == 256
