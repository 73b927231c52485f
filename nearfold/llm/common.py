"""What the operators share: scratch tables in the folder the cluster shares, range buckets, Arrow column access."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCRATCH: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset (tests, one machine) a temporary folder is set first."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        root = "file://" + tempfile.mkdtemp(prefix="nearfold-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed by release() or at exit."""
    path = f"{shared_dir(spark)}/scratch/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append((spark, path))
    return path


def release(spark: SparkSession) -> None:
    """Delete this session's scratch tables; results that still read them must have been written by then."""
    for owner, path in [x for x in _SCRATCH if x[0] is spark]:
        _SCRATCH.remove((owner, path))
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _release_all() -> None:
    for spark in {id(s): s for s, _ in _SCRATCH}.values():
        try:
            release(spark)
        except Exception:  # the session has ended before the interpreter
            continue


atexit.register(_release_all)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a Parquet table in the shared folder: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_rows(spark: SparkSession, rows: int) -> None:
    """Bound the rows and bytes of one Arrow batch, and so what a Python worker holds of long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 4 << 20):
    """Row ranges of about `most` bytes, at least one row each."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


#: What a null key sorts as: below every other key.
NULL_KEY = -(1 << 63)


def key_splits(df: DataFrame, key: str, n: int) -> np.ndarray:
    """At most n - 1 ascending cut points of a long column, near its quantiles over all rows; few, so they go to the driver."""
    if n < 2:
        return np.zeros(0, np.int64)
    found = df.select(F.col(key).cast("double").alias(key)).approxQuantile(key, [i / n for i in range(1, n)], max(0.25 / n, 1e-5))
    return np.unique(np.array(found, dtype=np.float64)).astype(np.int64)


def batch_of(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def concat_ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indices of all ranges [start, start + len), one range after the other."""
    total = int(lens.sum())
    ends = np.cumsum(lens)
    return np.repeat(starts - (ends - lens), lens) + np.arange(total)
