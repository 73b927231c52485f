"""Folders for tables that a query needs while it runs, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_MADE: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir (a temporary folder where that is unset: tests, one machine), removed at exit."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        root = "file://" + tempfile.mkdtemp(prefix="nearfold-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/scratch/{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def _remove() -> None:
    for spark, path in _MADE:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended before the interpreter
            continue


atexit.register(_remove)
