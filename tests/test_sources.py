import json
import os
import random

import numpy as np
import pytest

from nearfold.errors import CorruptSegment, DimensionMismatch, SchemaViolation
from nearfold.functions.values import infer_json_type, infer_text_type, parse_literal
from nearfold.operators import analytics as A
from nearfold.operators.search import ground_truth
from nearfold.operators.table import VectorTable
from nearfold.sources import datagen as G
from nearfold.sources import fixtures as X
from nearfold.sources.ingest import flat_rows, read_csv, read_json
from nearfold.sources.reports import report
from nearfold.sources.segments import Bitmap, Segment, SegmentWriter, read_segments, write_segments
from nearfold.streaming import mutations
from nearfold.types import ColumnType, MetadataSchema, Metric, TableSpec


def test_bitmap():
    b = Bitmap(70)
    for i in (0, 8, 69):
        b.set(i)
    b.clear(8)
    assert list(b) == [0, 69] and len(b) == 70 and not b.get(500) and list(Bitmap(70, b.tobytes())) == [0, 69]
    with pytest.raises(SchemaViolation):
        b.set(70)


def test_segment(spark, tmp_path):
    w = SegmentWriter(str(tmp_path), 3, 4)
    w.append_vectors(range(8))
    w.tombstone(1)
    w.append_vectors([8, 9, 10, 11])
    with pytest.raises(DimensionMismatch):
        w.append_vectors([1.0])
    assert not os.listdir(tmp_path)
    path = w.commit()
    s = Segment.open(path)
    assert (s.rows, s.live_rows, list(s.tombstones), s.vector(2)) == (3, 2, [1], [8, 9, 10, 11])
    raw = open(path, "rb").read()
    rng = random.Random(1)
    for _ in range(500):  # any change outside the bitmap is found
        at = rng.randrange(len(raw) - 1)
        bad = raw[:at] + bytes([raw[at] ^ (1 << rng.randrange(8))]) + raw[at + 1 :]
        with pytest.raises(CorruptSegment):
            Segment(bad)
    for n in (0, 10, 63, len(raw) - 1):
        with pytest.raises(CorruptSegment):
            Segment(raw[:n])
    rows = read_segments(spark, f"file://{tmp_path}/*.fseg").orderBy("row").collect()
    assert [r["tombstoned"] for r in rows] == [False, True, False]
    data = spark.range(10).selectExpr("id", "array(cast(id as float), 1.0f) AS vector", "id = 3 AS dead").coalesce(1)
    out = write_segments(data, f"{tmp_path}/many", 2, 4).collect()
    assert sorted(r["rows"] for r in out) == [2, 4, 4] and read_segments(spark, f"file://{tmp_path}/many/*.fseg").where("tombstoned").count() == 1


def test_splitmix():
    state, want, m = 42, [], (1 << 64) - 1
    for _ in range(5):
        state = (state + 0x9E3779B97F4A7C15) & m
        z = (state ^ state >> 30) * 0xBF58476D1CE4E5B9 & m
        z = (z ^ z >> 27) * 0x94D049BB133111EB & m
        want.append(z ^ z >> 31)
    assert G.draws(42, 0, 5).tolist() == want and G.draws(42, 3, 2).tolist() == want[3:]


def test_corpora(spark):
    a = G.uniform_rows(spark, 300, 8, 10, 42).orderBy("id").collect()
    b = G.uniform_rows(spark, 300, 8, 10, 42).repartition(7).orderBy("id").collect()
    assert a == b and all(0 <= x < 1 for x in a[0]["vector"]) and len({r["category"] for r in a}) == 10
    c = G.clustered_rows(spark, 400, 4, 10, 10, 7, 0.01, 0.5, 0.3).orderBy("id").collect()
    queries = G.clustered_queries(20, 4, 10, 7, 0.01, 0.5, 0.3)
    cluster = {r["id"]: r["cluster"] for r in c}
    truth = ground_truth(G.clustered_rows(spark, 400, 4, 10, 10, 7, 0.01, 0.5, 0.3), queries, Metric.L2, 5).collect()
    assert all(len({cluster[i] for i in r["ids"]}) == 1 for r in truth)
    for bad in (dict(sigma=0.0), dict(centre_sigma=float("inf")), dict(clusters=0)):
        with pytest.raises(SchemaViolation):
            G.clustered_rows(spark, 4, 4, **({"clusters": 2} | bad))
    demo = G.demo_rows(10, 3, 2)
    assert demo == G.demo_rows(10, 3, 2) and [r[2] for r in demo[:3]] == [0, 1, 0]


@pytest.mark.parametrize("family", ["uniform", "clustered"])
def test_fixture(spark, tmp_path, family):
    x = np.arange(20, dtype=np.float32).reshape(5, 4)
    truth = [([0, 1], [0.0, 0.5]), ([4, 3], [0.1, 0.2])]
    X.write_fixture(str(tmp_path), family, x, np.arange(5), x[:2], truth, 2, G.manifest(family, "L2", 4, 5, 2, 2, 7, 5))
    got = X.load_fixture(spark, str(tmp_path), family)
    assert got["metric"] is Metric.L2 and got["corpus"].where("category = 3").first()["vector"] == x[3].tolist()
    assert [r["ids"] for r in got["truth"].orderBy("query_id").collect()] == [[0, 1], [4, 3]]
    with pytest.raises(SchemaViolation):
        X.load_fixture(spark, str(tmp_path), {"uniform": "clustered", "clustered": "uniform"}[family])
    raw = (tmp_path / "meta.bin").read_bytes()
    (tmp_path / "meta.bin").write_bytes(raw[:-1])
    with pytest.raises(SchemaViolation):
        X.load_fixture(spark, str(tmp_path), family)


def test_vecs(spark, tmp_path):
    def vecs(rows, kind):
        return b"".join(np.array([len(r)], "<i4").tobytes() + np.array(r, kind).tobytes() for r in rows)

    (tmp_path / "base.fvecs").write_bytes(vecs([[1, 0, 0], [0, 1, 0]], "<f4"))
    (tmp_path / "query.fvecs").write_bytes(vecs([[0.5, 0.5, 0]], "<f4"))
    (tmp_path / "groundtruth.ivecs").write_bytes(vecs([[0, 1]], "<i4"))
    got = X.load_vecs_dataset(spark, str(tmp_path))
    assert got["k"] == 2 and got["truth"].first()["ids"] == [0, 1] and X.load_vecs_dataset(spark, str(tmp_path), 1)["k"] == 1
    assert [r["vector"] for r in X.scan_vecs(spark, f"file://{tmp_path}/base.fvecs", 3).orderBy("id").collect()] == [[1, 0, 0], [0, 1, 0]]
    for bad in (b"\0" * 3, vecs([[1.0], [1.0, 2.0]], "<f4"), np.array([0], "<i4").tobytes()):
        with pytest.raises(SchemaViolation):
            X.parse_vecs(bad, "<f4")


def test_uploads(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 7, "vector": [1, 2.5], "metadata": {"k": True, "n": 3, "s": "x"}}, {"vector": [3, 4], "metadata": {"k": False, "n": 4, "s": "y"}}]))
    rows, schema = read_json(spark, f"file://{tmp_path}/a.json")
    assert {n: k.value for n, k in schema.columns} == {"k": "bool", "n": "i64", "s": "string"}
    assert [(r["id"], r["vector"], r["n"]) for r in rows.orderBy("place").collect()] == [(7, [1.0, 2.5], 3), (1, [3.0, 4.0], 4)]
    (tmp_path / "b.json").write_text(json.dumps([{"vector": [1, 2], "metadata": {"k": 1}}, {"vector": [1, 2], "metadata": {}}]))
    with pytest.raises(SchemaViolation):
        read_json(spark, f"file://{tmp_path}/b.json")
    (tmp_path / "a.csv").write_text("id,dim1,dim0,flag,f\n5,2,1,true,1.5\n6,4,3,false,2\n")
    rows, schema = read_csv(spark, f"file://{tmp_path}/a.csv")
    assert {n: k.value for n, k in schema.columns} == {"flag": "bool", "f": "f64"}
    assert [(r["id"], r["vector"], r["flag"], r["f"]) for r in rows.orderBy("id").collect()] == [(5, [1.0, 2.0], True, 1.5), (6, [3.0, 4.0], False, 2.0)]
    (tmp_path / "c.csv").write_text("id,x\n1,2\n")
    with pytest.raises(SchemaViolation):
        read_csv(spark, f"file://{tmp_path}/c.csv")
    assert flat_rows(spark, [1, 2], [1, 2, 3, 4], 2).count() == 2
    with pytest.raises(SchemaViolation):
        flat_rows(spark, [1], [1, 2, 3], 2)


def test_literals():
    assert parse_literal(ColumnType.BOOL, " TRUE ") is True and parse_literal(ColumnType.I64, " 7 ") == 7 and parse_literal(ColumnType.F64, "1e3") == 1000.0 and parse_literal(ColumnType.STRING, " a ") == "a"
    for kind, raw in ((ColumnType.BOOL, "1"), (ColumnType.I64, "1.0"), (ColumnType.I64, str(1 << 63)), (ColumnType.F64, "x")):
        with pytest.raises(SchemaViolation):
            parse_literal(kind, raw)
    assert [infer_json_type(x).value for x in (True, 1, 1.0, 1.5, "a")] == ["bool", "i64", "i64", "f64", "string"]
    assert [infer_text_type(x).value for x in ("true", "-3", "1.5", ".5", "1e3")] == ["bool", "i64", "f64", "f64", "string"]


def test_analytics(spark):
    truth = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, None)], "query_id long, id long")
    found = spark.createDataFrame([(0, 1), (1, 9)], "query_id long, id long")
    of = lambda empty: {r["query_id"]: r["recall"] for r in A.recall(found, truth, empty).collect()}
    assert of("skip") == {0: 0.5, 1: 0.0} and of("zero")[2] == 0.0 and of("one")[2] == 1.0
    rows = spark.range(20).selectExpr("cast(id as double) AS v")
    assert {r["percent"]: r["value"] for r in A.percentiles(rows, "v", [50, 99]).collect()} == {50: 9.0, 99: 18.0}
    assert {r["quantile"]: r["value"] for r in A.nearest_rank(rows, "v", [0.5, 0.99]).collect()} == {0.5: 9.0, 0.99: 19.0}
    assert A.percentiles(rows.limit(0), "v", [50]).collect() == []
    assert [r["n"] for r in A.histogram(rows, "v", 4).orderBy("bin").collect()] == [5, 5, 5, 5]
    assert [r["n"] for r in A.histogram(rows.selectExpr("3.0 AS v"), "v", 3).orderBy("bin").collect()] == [20, 0, 0]
    assert A.Ceilings(1, 2, 0.9).violations(2, 1, 0.5) and not A.Ceilings(1, 2, 0.9).violations(1, 2, 0.9)
    x = np.random.default_rng(0).normal(size=(200, 5)) * [5, 3, 1, 0.1, 0.1]
    p = A.principal_components(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>"), 2)
    assert np.allclose(p.explained, np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1][:2]) and np.allclose(p.point(p.mean), 0)
    assert json.loads(report({}, {}, {}, {"p50": 1.0}, 0.5, {}, None, {}, ["x"]))["ceiling_violations"] == ["x"]


def test_stream(spark, tmp_path):
    schema = MetadataSchema((("k", ColumnType.I64),))
    t = VectorTable(spark, TableSpec("t", 2, Metric.L2, schema), f"file://{tmp_path}/t")
    rows = [("upsert", 1, 1, [1.0, 0.0], 1), ("upsert", 2, 2, [2.0, 0.0], 2), ("upsert", 3, 1, [9.0, 0.0], 9), ("delete", 4, 2, None, None), ("delete", 5, 77, None, None)]
    kind = "op string, seq long, id long, vector array<float>, k long"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
    mutations.start(stream, t, f"{tmp_path}/cp", available_now=True).awaitTermination()
    assert [(r["id"], r["k"]) for r in t.snapshot().visible().collect()] == [(1, 9)]
    assert not mutations.apply_batch(t, spark.read.parquet(f"{tmp_path}/in"), 0)
