from pyspark.sql import functions as F

from nearfold import observability as O
from nearfold.functions.ranking import bucket_of
from nearfold.operators import analytics as A
from nearfold.operators.index import VectorIndex
from nearfold.operators.sweeps import compare, sweep
from nearfold.plans import ladder as L
from nearfold.sources import datagen as G
from nearfold.sources.fixtures import load_fixture
from nearfold.sources.generate import generate, options
from nearfold.types import Metric


def test_generate(spark, tmp_path):
    for mode in ("uniform", "clustered"):
        out = f"{tmp_path}/{mode}"
        generate(spark, options(["--mode", mode, "--vectors", "200", "--dimension", "8", "--queries", "5", "--top-k", "3", "--categories", "4", "--clusters", "5", "--seed", "7", "--metric", "L2", "--out", out]))
        got = load_fixture(spark, f"{out}/fixture", mode)
        assert got["corpus"].count() == 200 and got["k"] == 3 and got["metric"] is Metric.L2
        assert [r["ids"] for r in got["truth"].orderBy("query_id").collect()] == [r["ids"] for r in spark.read.parquet(f"{out}/truth").orderBy("query_id").collect()]


def test_sweeps(spark, tmp_path):
    index = VectorIndex(spark, f"file://{tmp_path}/i", 8, Metric.L2)
    index.write(G.uniform_rows(spark, 300, 8, 4, 3))
    index.build(L.BuildParams("hnsw"))
    queries = G.uniform_queries(2, 8, 3)
    found = sweep(index, queries, passes=1)
    assert len(found) == 7 and {r["recall"] for r in found if r["probes"] == 4} == {1.0}
    assert compare(index, queries, passes=1)["naive"]["recall"] == 1.0


def test_events(spark):
    O.histogram("unheard", 1)
    with O.capture() as events:
        with O.span("search", spark):
            O.histogram("rows", 3)
        rows, watch = O.observed(spark.range(5), "w")
        rows.collect()
    assert [(k, n) for k, n, _ in events] == [("histogram", "rows"), ("span", "search")] and watch.get == {"rows": 5}


def test_ranks_with_a_frequent_value(spark):
    values = sorted([5.0] * 400 + [float(i % 37) for i in range(300)])
    rows = spark.createDataFrame([(v,) for v in reversed(values)] + [(None,)], "value double")
    got = {r["percent"]: r["value"] for r in A.percentiles(rows, "value", [0, 10, 50, 90, 100]).collect()}
    assert got == {p: values[(len(values) - 1) * p // 100] for p in got} and len(got) == 5
    assert A.percentiles(rows.limit(0), "value", [50]).count() == 0
    cuts = [float(i) for i in range(0, 300, 3)]
    placed = spark.range(400).select("id", bucket_of(F.col("id").cast("double") - 10, cuts).alias("b")).collect()
    assert all(r["b"] == sum(c < r["id"] - 10 for c in cuts) for r in placed)
