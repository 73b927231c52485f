"""Benchmark fixtures in binary files: corpus, categories, queries and exact answers.

Files hold little-endian numbers after a magic that ends in the family's digit (1 uniform, 2 clustered) and a version.
Corpora are read by rows through Spark; queries and answers are small.
"""

from __future__ import annotations

import json
import os
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..errors import SchemaViolation, StorageError
from ..types import Metric

FAMILIES = {"uniform": b"1", "clustered": b"2"}
#: Fixed values of the format: magics without their digit, version, the largest width of a vecs row.
CORPUS, META, QUERIES, TRUTH, VERSION, MAX_WIDTH = b"FRC", b"FRM", b"FRQ", b"FRG", 1, 1 << 20


def _read(folder: str, name: str) -> bytes:
    try:
        with open(os.path.join(folder, name), "rb") as f:
            return f.read()
    except OSError as e:
        raise StorageError(str(e)) from e


def _header(raw: bytes, magic: bytes, family: str, layout: str) -> tuple:
    size = struct.calcsize("<4sI" + layout)
    if len(raw) < size or raw[:4] != magic + FAMILIES[family]:
        raise SchemaViolation(f"no {family} {magic.decode()} file")
    _, version, *rest = struct.unpack("<4sI" + layout, raw[:size])
    if version != VERSION:
        raise SchemaViolation(f"version {version}")
    return size, *rest


def _exactly(raw: bytes, size: int) -> None:
    if len(raw) != size:
        raise SchemaViolation(f"{len(raw)} bytes, not {size}")


def write_fixture(folder: str, family: str, corpus: np.ndarray, categories: np.ndarray, queries: np.ndarray, truth: list[tuple[list[int], list[float]]], k: int, manifest: str) -> None:
    """The four files and the manifest."""
    digit, k_of = FAMILIES[family], min(k, len(corpus))
    files = {
        "corpus.bin": struct.pack("<4sIIQ", CORPUS + digit, VERSION, corpus.shape[1], len(corpus)) + corpus.astype("<f4").tobytes(),
        "meta.bin": struct.pack("<4sIQ", META + digit, VERSION, len(corpus)) + categories.astype("<u2").tobytes(),
        "queries.bin": struct.pack("<4sIIQ", QUERIES + digit, VERSION, queries.shape[1], len(queries)) + queries.astype("<f4").tobytes(),
        "ground_truth.bin": struct.pack("<4sIQI", TRUTH + digit, VERSION, len(truth), k_of) + b"".join(np.array(i[:k_of], "<u4").tobytes() + np.array(d[:k_of], "<f4").tobytes() for i, d in truth),
        "manifest.json": manifest.encode(),
    }
    os.makedirs(folder, exist_ok=True)
    for name, data in files.items():
        with open(os.path.join(folder, name + ".tmp"), "wb") as f:
            f.write(data)
        os.replace(os.path.join(folder, name + ".tmp"), os.path.join(folder, name))


def load_fixture(spark: SparkSession, folder: str, family: str = "uniform") -> dict:
    """corpus (id, vector, category), queries and truth (query_id, ids, distances) as DataFrames, and metric, dimension and k."""
    about = json.loads(_read(folder, "manifest.json"))
    if about.get("num_categories", 0) < 1:
        raise SchemaViolation("the manifest names no categories")
    metric = Metric.parse(about["metric"])
    raw = _read(folder, "corpus.bin")
    at, dim, n = _header(raw, CORPUS, family, "IQ")
    _exactly(raw, at + 4 * n * dim)
    vectors = np.frombuffer(raw, "<f4", n * dim, at).reshape(n, dim)
    raw = _read(folder, "meta.bin")
    at, m = _header(raw, META, family, "Q")
    _exactly(raw, at + 2 * m)
    categories = np.frombuffer(raw, "<u2", m, at)
    raw = _read(folder, "queries.bin")
    at, q_dim, q = _header(raw, QUERIES, family, "IQ")
    _exactly(raw, at + 4 * q * q_dim)
    queries = np.frombuffer(raw, "<f4", q * q_dim, at).reshape(q, q_dim)
    raw = _read(folder, "ground_truth.bin")
    at, t, k = _header(raw, TRUTH, family, "QI")
    _exactly(raw, at + 8 * t * k)
    body = np.frombuffer(raw, np.uint8, 8 * t * k, at).reshape(t, 8 * k)
    if m != n or q_dim != dim or t != q:
        raise SchemaViolation("the files do not belong together")
    ids, distances = np.ascontiguousarray(body[:, : 4 * k]).view("<u4"), np.ascontiguousarray(body[:, 4 * k :]).view("<f4")
    return {
        "corpus": _frame(spark, vectors).join(spark.createDataFrame(pa.table({"id": np.arange(n), "category": categories.astype(np.int32)})), "id"),
        "queries": _frame(spark, queries).withColumnRenamed("id", "query_id"),
        "truth": spark.createDataFrame(pa.table({"query_id": np.arange(t), "ids": pa.array(ids.astype(np.int64).tolist(), pa.list_(pa.int64())), "distances": pa.array(distances.astype(np.float64).tolist(), pa.list_(pa.float64()))})),
        "metric": metric, "dimension": dim, "k": k, "manifest": about,
    }


def _frame(spark: SparkSession, x: np.ndarray) -> DataFrame:
    values = pa.array(np.ascontiguousarray(x, dtype=np.float32).reshape(-1))
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), values)
    return spark.createDataFrame(pa.table({"id": np.arange(len(x)), "vector": vectors}))


def parse_vecs(raw: bytes, kind: str) -> np.ndarray:
    """Rows of a fvecs ('<f4') or ivecs ('<i4') file: each a width and that many numbers, the same width in all."""
    if not raw:
        return np.zeros((0, 0), kind)
    width = struct.unpack("<i", raw[:4])[0] if len(raw) >= 4 else 0
    if not 1 <= width <= MAX_WIDTH or len(raw) % (4 + 4 * width):
        raise SchemaViolation("no whole rows of one width")
    rows = np.frombuffer(raw, "<i4").reshape(-1, 1 + width)
    if (rows[:, 0] != width).any():
        raise SchemaViolation("rows of different widths")
    return np.ascontiguousarray(rows[:, 1:]).view(kind)


def load_vecs_dataset(spark: SparkSession, folder: str, k: int | None = None) -> dict:
    """base.fvecs, query.fvecs and groundtruth.ivecs: squared L2, no categories; answers cut to k."""
    base, query = parse_vecs(_read(folder, "base.fvecs"), "<f4"), parse_vecs(_read(folder, "query.fvecs"), "<f4")
    truth = parse_vecs(_read(folder, "groundtruth.ivecs"), "<i4")
    if base.shape[1] != query.shape[1] or len(truth) != len(query):
        raise SchemaViolation("the files do not belong together")
    k = min(k or truth.shape[1], truth.shape[1])
    answers = pa.table({"query_id": np.arange(len(truth)), "ids": pa.array(truth[:, :k].astype(np.int64).tolist(), pa.list_(pa.int64())), "distances": pa.array([[0.0] * k] * len(truth), pa.list_(pa.float64()))})
    return {"corpus": _frame(spark, base), "queries": _frame(spark, query).withColumnRenamed("id", "query_id"), "truth": spark.createDataFrame(answers), "metric": Metric.L2, "dimension": base.shape[1], "k": k}


def scan_vecs(spark: SparkSession, path: str, width: int) -> DataFrame:
    """A large fvecs file as id and vector, read by many tasks as records of one length."""
    size = 4 + 4 * width
    raw = spark.sparkContext.binaryRecords(path, size).zipWithIndex().toDF("record binary, id long")

    def of(batches):
        for batch in batches:
            if batch.num_rows:
                x = parse_vecs(b"".join(batch.column(1).to_pylist()), "<f4")
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, width, dtype=np.int32)), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), vectors], names=["id", "vector"])

    return raw.select("id", "record").mapInArrow(of, "id long, vector array<float>")
