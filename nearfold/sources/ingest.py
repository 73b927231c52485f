"""Datasets as JSON and CSV uploads.

JSON is an array of objects with vector, and optionally id and metadata; CSV has a header with an optional id, columns
dim0, dim1, ... and metadata. Types are those of the first record, which later ones have to keep; ids default to the
record's place.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaViolation
from ..functions.values import infer_json_type, infer_text_type, literal_column
from ..types import ColumnType, MetadataSchema


def read_json(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, MetadataSchema]:
    """Rows (id, vector, metadata columns) and their schema; multi_line=False reads one object a line, by many tasks."""
    raw = spark.read.schema("id long, vector array<double>, metadata map<string, string>, _corrupt_record string").option("multiLine", multi_line).json(path)
    kinds = spark.read.option("multiLine", multi_line).option("samplingRatio", 1.0).option("primitivesAsString", False)
    first = raw.where("metadata IS NOT NULL").limit(1).collect()
    names = sorted(first[0]["metadata"]) if first else []
    types: dict[str, ColumnType] = {}
    if names:
        typed = kinds.json(path).where("metadata IS NOT NULL").select("metadata.*").limit(1).collect()[0].asDict()
        types = {n: infer_json_type(typed.get(n)) for n in names}
    schema = MetadataSchema(tuple((n, types[n]) for n in names))
    rows = raw.withColumn("place", F.monotonically_increasing_id())
    columns = [literal_column(types[n], F.col("metadata")[n]).alias(n) for n in names]
    out = rows.select("place", F.coalesce("id", "place").alias("id"), F.col("vector").cast("array<float>").alias("vector"), *columns)
    _refuse(out, names, "vector IS NULL")
    return out, schema


def read_csv(spark: SparkSession, path: str) -> tuple[DataFrame, MetadataSchema]:
    """Rows (id, vector, metadata columns) and their schema, by a header and the first data row."""
    raw = spark.read.option("header", True).csv(path)
    dims = sorted((c for c in raw.columns if re.fullmatch(r"dim\d+", c)), key=lambda c: int(c[3:]))
    if not dims:
        raise SchemaViolation("there is no column dim0")
    names = [c for c in raw.columns if c not in dims and c != "id"]
    first = raw.limit(1).collect()
    if not first:
        raise SchemaViolation("there are no rows")
    types = {n: infer_text_type(first[0][n] or "") for n in names}
    schema = MetadataSchema(tuple((n, types[n]) for n in names))
    rows = raw.withColumn("place", F.monotonically_increasing_id())
    id_ = F.coalesce(F.col("id").try_cast("long"), F.col("place")) if "id" in raw.columns else F.col("place")
    vector = F.array(*[F.col(f"`{d}`").try_cast("float") for d in dims])
    out = rows.select("place", id_.alias("id"), vector.alias("vector"), *[literal_column(types[n], F.col(f"`{n}`")).alias(n) for n in names])
    _refuse(out, names, "exists(vector, x -> x IS NULL)")
    return out, schema


def _refuse(rows: DataFrame, names: list[str], bad_vector: str) -> None:
    bad = rows.agg(F.count_if(F.expr(bad_vector)).alias("vector"), *[F.count_if(F.col(f"`{n}`").isNull()).alias(n) for n in names]).first().asDict()
    wrong = {k: v for k, v in bad.items() if v}
    if wrong:
        raise SchemaViolation(f"records without a proper value: {wrong}")


def flat_rows(spark: SparkSession, ids: list[int], flat: list[float], dimension: int) -> DataFrame:
    """id and vector from a flat list of numbers, cut by position."""
    if len(flat) != dimension * len(ids):
        raise SchemaViolation(f"{len(flat)} numbers for {len(ids)} rows of {dimension}")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("vector", T.ArrayType(T.FloatType()))])
    return spark.createDataFrame([(i, [float(x) for x in flat[r * dimension : (r + 1) * dimension]]) for r, i in enumerate(ids)], schema)
