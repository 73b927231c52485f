"""Benchmark reports as JSON."""

from __future__ import annotations

import json


def report(dataset: dict, environment: dict, run: dict, latency_ms: dict, recall: float, ingest: dict, peak_rss: int | None, ceilings: dict, violations: list[str]) -> str:
    """One object: what was measured, where, with which result, and which ceilings it broke."""
    return json.dumps({
        "format_version": 1, "tool": "nearfold-bench", "dataset": dataset, "environment": environment, "run": run, "latency_ms": {k: round(v, 6) for k, v in latency_ms.items()},
        "recall_at_k": round(recall, 6), "ingest": ingest, "memory_bytes": {"peak_rss": peak_rss}, "ceilings": ceilings, "ceiling_violations": violations,
    })
