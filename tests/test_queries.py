import pytest

from nearfold.queries import ORACLES, QUERIES

from .conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(name, same):
    same(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(name, spark):
    assert QUERIES[name](spark, SF).count()


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["knn_lineitem"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)]" in plan
    assert "TakeOrderedAndProject" in plan and "l_extendedprice" not in plan


def test_negations_are_pushed_down(spark):
    from pyspark.sql import functions as F

    from nearfold.plans import predicates as P
    from nearfold.types import ColumnType, MetadataSchema

    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "label")
    schema = MetadataSchema((("label", ColumnType.I64),))
    plan = rows.where(P.compile_predicate(~P.eq("label", 3), schema))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(IsNull(label),Not(EqualTo(label,3)))]" in plan
    assert F is not None


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["ivf_recall", "pq_recall"])
def test_recall_of_indexes(name, spark):
    from pyspark.sql import functions as F

    assert QUERIES[name](spark, "/root/testdata/sf0.1").agg(F.avg("recall")).first()[0] >= 0.9
