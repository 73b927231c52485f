import pytest

from nearfold.errors import Busy, DimensionMismatch, SchemaViolation, TableNotFound
from nearfold.operators import search as S
from nearfold.operators.lifecycle import CompactionConfig, Lifecycle, evaluate_trigger, trigger
from nearfold.operators.table import Catalog, VectorTable
from nearfold.plans import predicates as P
from nearfold.plans.admission import AdmissionGate
from nearfold.types import ColumnType, MetadataSchema, Metric, SearchOptions, TableSpec

ROWS = MetadataSchema((("active", ColumnType.BOOL), ("rank", ColumnType.I64), ("label", ColumnType.STRING)))
ONE = MetadataSchema((("category", ColumnType.I64),))


@pytest.fixture()
def catalog(spark, tmp_path):
    return Catalog(spark, f"file://{tmp_path}")


def six(catalog, metric="l2"):
    t = catalog.create("vectors", 3, metric, ROWS)
    t.insert([{"id": i, "vector": [float(i), 0.0, 0.0], "metadata": {"active": i % 2 == 0, "rank": i, "label": f"v{i}"}} for i in range(6)])
    return t


def test_catalog(catalog):
    t = catalog.create("a", 4)
    assert catalog.open("a") is t and catalog.names() == ["a"] and t.spec.metric is Metric.COSINE
    for bad in (("a", 4), (" ", 4), ("b\0", 4), ("c", 0)):
        with pytest.raises(SchemaViolation):
            catalog.create(*bad)
    catalog.drop("a")
    for f in (catalog.open, catalog.drop):
        with pytest.raises(TableNotFound):
            f("a")
    assert catalog.status() == {"tables": 0, "vectors": 0, "by_table": {}}


def test_schema():
    for bad in ((("a", ColumnType.I64), ("a", ColumnType.F64)), ((" ", ColumnType.I64),), (("id", ColumnType.I64),)):
        with pytest.raises(SchemaViolation):
            MetadataSchema(bad)
    with pytest.raises(SchemaViolation):
        MetadataSchema.of(["a"], ["i64", "f64"])
    assert MetadataSchema.of(["a"], [" BOOL "]).type_of("a") is ColumnType.BOOL
    for k in (0, 1001):
        with pytest.raises(SchemaViolation):
            SearchOptions(k)


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
def test_search(catalog, metric):
    t = six(catalog, metric)
    found = t.snapshot().search([5.0, 0.0, 0.0], options=SearchOptions(3)).collect()
    d = [r["distance"] for r in found]
    assert len(found) == 3 and d == sorted(d)
    if metric == "cosine":
        zero = {r["id"]: r["distance"] for r in t.snapshot().search([5.0, 0.0, 0.0]).collect()}
        assert zero[0] == 1.0


def test_predicates_and_ties(catalog):
    t = six(catalog)
    p = P.gte("rank", 2) & (P.eq("active", True) | P.is_in("rank", [3, 5])) & ~P.eq("rank", 4)
    found = t.snapshot().search([0.0, 0.0, 0.0], p).collect()
    assert [r["id"] for r in found] == [2, 3, 5] and found[0]["label"] == "v2"
    assert [r["id"] for r in t.snapshot().search([0.5, 0.0, 0.0], options=SearchOptions(2)).collect()] == [0, 1]
    assert S.profile(t.spec, t.snapshot().log(), None, [0.0, 0.0, 0.0], 2, P.lt("rank", 4))["matched_rows"] == 4
    with pytest.raises(DimensionMismatch):
        t.snapshot().search([0.0])
    with pytest.raises(SchemaViolation):
        t.snapshot().search([0.0] * 3, P.eq("label", "v1"))


def test_admission(catalog):
    t, gate = six(catalog), AdmissionGate(1)
    with gate.permit():
        with pytest.raises(Busy):
            S.search(t.spec, t.snapshot().log(), None, [0.0] * 3, gate=gate)
    assert gate.in_flight == 0 and len(S.collect_search(t.spec, t.snapshot().log(), None, [0.0] * 3, gate=gate)) == 6
    with pytest.raises(Busy):
        with AdmissionGate(0).permit():
            pass


def test_writes(catalog):
    t = six(catalog)
    with pytest.raises(SchemaViolation):
        t.insert([{"id": 9, "vector": [1.0, 2.0, 3.0], "metadata": {"active": True, "rank": 1, "label": "a"}}, {"id": 10, "vector": [1.0, 2.0, 3.0], "metadata": {"active": 1, "rank": 1, "label": "a"}}])
    with pytest.raises(DimensionMismatch):
        t.insert([{"id": 9, "vector": [1.0], "metadata": {"active": True, "rank": 1, "label": "a"}}])
    assert len(t.snapshot()) == 6
    old = t.snapshot()
    t.delete([4, 99])
    assert [r["id"] for r in t.snapshot().tombstoned_ids().collect()] == [4] and old.visible().count() == 6
    t.update([{"id": 4, "vector": [9.0, 0.0, 0.0], "metadata": {"active": True, "rank": 40, "label": "new"}}, {"id": 1, "vector": [8.0, 0.0, 0.0], "metadata": {"active": True, "rank": 10, "label": "new"}}])
    seen = {r["id"]: r["rank"] for r in t.snapshot().visible().collect()}
    assert seen == {0: 0, 1: 10, 2: 2, 3: 3, 4: 40, 5: 5} and t.snapshot().is_tombstoned(4)
    t.insert([{"id": 5, "vector": [5.0, 0.0, 0.0], "metadata": {"active": False, "rank": 5, "label": "again"}}])
    assert [r["id"] for r in t.snapshot().search([5.0, 0.0, 0.0], options=SearchOptions(2)).collect()] == [5, 5]
    generations = [r["generation"] for r in t.snapshot().log().select("generation").collect()]
    assert sorted(generations) == list(range(9)) and t.snapshot().export().count() == 9


def test_dataframes_and_segments(spark, tmp_path):
    t = VectorTable(spark, TableSpec("t", 2, Metric.L2, ONE), f"file://{tmp_path}/t", segment_rows=10)
    rows = spark.range(25).selectExpr("id", "array(cast(id as float), 0.0f) AS vector", "cast(id % 3 as int) AS category", "id AS place")
    t.insert(rows)
    s = t.snapshot()
    assert s.sealed_segments == 2 and s.sealed().count() == 20 and s.active().count() == 5
    assert [r["id"] for r in s.log().orderBy("generation").select("id").collect()] == list(range(25))
    for bad in (rows.withColumn("category", rows["id"].cast("string")), rows.drop("category"), rows.selectExpr("id", "vector", "nullif(category, 1) AS category")):
        with pytest.raises(SchemaViolation):
            t.insert(bad)
    assert len(t.snapshot()) == 25
    flat = VectorTable(spark, TableSpec("f", 2, Metric.L2, ONE), f"file://{tmp_path}/f")
    flat.insert_flat([1, 2], [0.0, 1.0, 2.0, 3.0], ["category"], ["i64"], ["7", " 8 "])
    assert [(r["id"], r["category"]) for r in flat.snapshot().log().orderBy("id").collect()] == [(1, 7), (2, 8)]


def test_trigger():
    c = CompactionConfig(0.9, 10)
    assert trigger(c, 100, 0, 0, 89) is None and trigger(c, 100, 0, 0, 90) == "change_threshold"
    c = CompactionConfig(0.01, 30)
    assert trigger(c, 40, 0, 0, 29) is None and trigger(c, 40, 0, 0, 30) == "change_threshold"
    c = CompactionConfig()
    assert trigger(c, 100, 30, 3, 0) is None and trigger(c, 100, 40, 4, 0) == "delta_count"


def _table(spark, tmp_path, n):
    t = VectorTable(spark, TableSpec("t", 8, Metric.COSINE, ONE), f"file://{tmp_path}/t")
    if n:
        t.insert([{"id": i, "vector": [((31 * i + 7 * c) % 89) / 89 for c in range(8)], "metadata": {"category": i % 7}} for i in range(n)])
    return t


def test_merge(spark, tmp_path):
    t = _table(spark, tmp_path, 300)
    t.delete([5, 17, 250])
    t.insert([{"id": i, "vector": [((31 * i + 7 * c) % 89) / 89 for c in range(8)], "metadata": {"category": i % 7}} for i in (42, 301)])
    query = [0.3] * 8
    before = [r["id"] for r in t.snapshot().search(query, options=SearchOptions(1000)).collect()]
    life = Lifecycle(t)
    report = life.compact()
    assert (report.rows_before, report.rows_after, report.tombstones_retained, report.tombstones_purged) == (302, 301, 3, 0)
    after = [r["id"] for r in t.snapshot().search(query, options=SearchOptions(1000)).collect()]
    assert sorted(after) == sorted(set(before)) and life.needed() is None
    assert life.compact().rows_after == 301 and life.last.tombstones_retained == 3


@pytest.mark.parametrize("deleted,rows,retained,purged", [(19, 100, 19, 0), (20, 100, 20, 0), (21, 79, 0, 21)])
def test_purge_gate(spark, tmp_path, deleted, rows, retained, purged):
    t = _table(spark, tmp_path, 100)
    t.delete(range(deleted))
    r = Lifecycle(t).compact()
    assert (r.rows_after, r.tombstones_retained, r.tombstones_purged) == (rows, retained, purged) and t.snapshot().visible().count() == 100 - deleted


def test_empty_and_background(spark, tmp_path):
    t = _table(spark, tmp_path, 0)
    assert t.snapshot().search([0.1] * 8).collect() == [] and Lifecycle(t).compact().rows_after == 0
    t.insert([{"id": i, "vector": [float(i + 1)] * 8, "metadata": {"category": 0}} for i in range(20)])
    t.delete(range(10))
    life = Lifecycle(t, CompactionConfig(0.1, 5))
    assert evaluate_trigger(life.config, life.snapshot()) == "change_threshold"
    job = life.watch(0.05)
    import time

    for _ in range(200):
        if job.runs:
            break
        time.sleep(0.1)
    job.stop()
    assert job.error is None and job.runs == 1 and len(t.snapshot()) == 10 and life.export().count() == 1
