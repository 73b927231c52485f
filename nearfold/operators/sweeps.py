"""Benchmark runs over an index's knobs: a sweep, and two settings in turn."""

from __future__ import annotations

import statistics
import time

from pyspark.sql import DataFrame

from ..plans import ladder as L
from ..types import Metric
from . import search as S
from .index import VectorIndex


def _truth(rows: DataFrame, queries: list[tuple[int, list[float]]], metric: Metric, k: int) -> dict[int, set]:
    out: dict[int, set] = {}
    for r in S.batch_knn(rows, queries, metric, k).collect():
        out.setdefault(r["query_id"], set()).add(r["id"])
    return out


def measure(index: VectorIndex, queries: list[tuple[int, list[float]]], truth: dict[int, set], knobs: L.Knobs) -> tuple[list[float], list[float]]:
    """Milliseconds and recall of each query in turn."""
    times, recall = [], []
    for i, q in queries:
        began = time.perf_counter()
        found = {r["id"] for r in index.query(q, knobs).collect()}
        times.append(1e3 * (time.perf_counter() - began))
        recall.append(len(found & truth[i]) / len(truth[i]))
    return times, recall


def summary(name: str, knobs: L.Knobs, times: list[float], recall: list[float]) -> dict:
    times = sorted(times)
    at = lambda p: times[(len(times) - 1) * p // 100]
    return {"name": name, "probes": knobs.probes, "ef_search": knobs.ef_search, "p50_ms": at(50), "p99_ms": at(99), "mean_ms": statistics.mean(times), "recall": statistics.mean(recall)}


def sweep(index: VectorIndex, queries: list[tuple[int, list[float]]], k: int = 10, passes: int = 2) -> list[dict]:
    """Every setting of the sweep's grid, after a pass to warm up; the automatic one is calibrated."""
    truth = _truth(index.rows(), queries, index.metric, k)
    out = []
    for knobs in L.sweep_grid():
        name = "automatic" if knobs is None else f"probes {knobs.probes} ef {knobs.ef_search}"
        knobs = knobs or index.calibrate(k)
        measure(index, queries[:1], truth, knobs)
        runs = [measure(index, queries, truth, knobs) for _ in range(passes)]
        out.append(summary(name, knobs, [t for r in runs for t in r[0]], [x for r in runs for x in r[1]]))
    return out


def compare(index: VectorIndex, queries: list[tuple[int, list[float]]], k: int = 10, passes: int = 5) -> dict:
    """The naive and the calibrated setting, pass by pass in turn, and whether the second is as good in all three."""
    truth = _truth(index.rows(), queries, index.metric, k)
    settings = {"naive": L.naive_knobs(k), "calibrated": index.calibrate(k)}
    runs: dict[str, list] = {n: [] for n in settings}
    for _ in range(passes):
        for name, knobs in settings.items():
            runs[name].append(measure(index, queries, truth, knobs))
    naive, calibrated = (summary(n, settings[n], [t for r in runs[n] for t in r[0]], [x for r in runs[n] for x in r[1]]) for n in settings)
    good = calibrated["recall"] >= naive["recall"] and calibrated["p50_ms"] <= naive["p50_ms"] and calibrated["p99_ms"] <= naive["p99_ms"]
    return {"naive": naive, "calibrated": calibrated, "pareto": good}
