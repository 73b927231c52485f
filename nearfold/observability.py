"""Spans and histogram events, kept only while someone listens."""

from __future__ import annotations

import threading
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

_LOCK = threading.Lock()
_LISTENERS: list[list[tuple[str, str, float]]] = []


@contextmanager
def capture():
    """Collects the events (kind, name, value) of all threads while it lasts."""
    events: list[tuple[str, str, float]] = []
    with _LOCK:
        _LISTENERS.append(events)
    try:
        yield events
    finally:
        with _LOCK:
            _LISTENERS.remove(events)


def _emit(kind: str, name: str, value: float) -> None:
    if _LISTENERS:
        with _LOCK:
            for events in _LISTENERS:
                events.append((kind, name, value))


@contextmanager
def span(name: str, spark=None):
    """Times what it holds; with a session, its jobs carry the name as their group."""
    began = time.perf_counter()
    if spark is not None:
        spark.sparkContext.setJobDescription(name)
    try:
        yield
    finally:
        _emit("span", name, time.perf_counter() - began)


def histogram(name: str, value: float) -> None:
    _emit("histogram", name, float(value))


def observed(rows: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """rows that count themselves while another job reads them."""
    watch = Observation(name)
    return rows.observe(watch, F.count(F.lit(1)).alias("rows")), watch
