import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def same(spark, duck):
    """Whether a query's rows equal its SQL's."""
    import math

    def norm(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v)
        if isinstance(v, list):
            return tuple(norm(x) for x in v)
        return None if v is None else str(v)

    def check(query, sql):
        df = query(spark, SF)
        columns = sorted(df.columns)
        got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
        out = duck.execute(sql)
        at = {d[0]: i for i, d in enumerate(out.description)}
        assert sorted(at) == columns
        assert got == sorted((tuple(norm(r[at[c]]) for c in columns) for r in out.fetchall()), key=repr)

    return check
