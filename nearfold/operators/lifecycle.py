"""Compaction: when a table needs it, what it keeps, and a job that watches for it."""

from __future__ import annotations

import threading
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .search import visible
from .table import Manifest, Snapshot, VectorTable


@dataclass(frozen=True)
class CompactionConfig:
    """Shares and counts from which a table is compacted, and the share of hidden rows above which they are purged."""

    change_fraction: float = 0.01
    change_floor: int = 100_000
    sealed_segments: int = 4
    purge_ratio: float = 0.20


def trigger(config: CompactionConfig, rows: int, sealed_rows: int, sealed_segments: int, tombstoned_ids: int) -> str | None:
    if sealed_rows + tombstoned_ids >= max(int(rows * config.change_fraction), config.change_floor):
        return "change_threshold"
    return "delta_count" if sealed_segments >= config.sealed_segments else None


def evaluate_trigger(config: CompactionConfig, snapshot: Snapshot) -> str | None:
    ids = snapshot.tombstones().select("id").distinct().count() if snapshot.manifest.tombs else 0
    return trigger(config, len(snapshot), snapshot.sealed_segments * snapshot.segment_rows, snapshot.sealed_segments, ids)


def dead_ratio(log: DataFrame, tombstones: DataFrame) -> DataFrame:
    """rows, hidden and their ratio, as one row."""
    marked = log.select("id", "generation").join(tombstones.select("id", "generation").distinct().withColumn("gone", F.lit(1)), ["id", "generation"], "left")
    sums = marked.agg(F.count(F.lit(1)).alias("rows"), F.count("gone").alias("hidden"))
    return sums.withColumn("ratio", F.when(F.col("rows") > 0, F.col("hidden") / F.col("rows")).otherwise(F.lit(0.0)))


def _newest(rows: DataFrame) -> DataFrame:
    """The row with the highest generation of each id."""
    packed = rows.groupBy("id").agg(F.max_by(F.struct(*rows.columns), "generation").alias("row"))
    return packed.select("row.*")


def merged(log: DataFrame, tombstones: DataFrame, purge_ratio: float = 0.20) -> tuple[DataFrame, DataFrame, bool]:
    """The newest visible row of each id; the newest row of each fully hidden id (empty if purged); whether it is purged."""
    purge = dead_ratio(log, tombstones).first()["ratio"] > purge_ratio
    kept = _newest(visible(log, tombstones))
    hidden = log.join(tombstones.select("id", "generation"), ["id", "generation"], "left_semi").select(*log.columns)
    retained = _newest(hidden).join(kept.select("id"), "id", "left_anti").select(*log.columns)
    return kept.select(*log.columns), retained.limit(0) if purge else retained, purge


@dataclass(frozen=True)
class CompactionReport:
    rows_before: int
    rows_after: int
    segments_before: int
    segments_after: int
    tombstones_purged: int
    tombstones_retained: int


class Lifecycle:
    """A table with compaction; the table's lock is held from reading a version to publishing the next."""

    def __init__(self, table: VectorTable, config: CompactionConfig = CompactionConfig()):
        self.table, self.config = table, config
        self.last: CompactionReport | None = None
        self._compacted: int | None = None

    def snapshot(self) -> Snapshot:
        return self.table.snapshot()

    def needed(self) -> str | None:
        """The trigger, unless nothing was written since the last compaction."""
        snapshot = self.snapshot()
        return None if snapshot.manifest.version == self._compacted else evaluate_trigger(self.config, snapshot)

    def compact(self) -> CompactionReport:
        table = self.table
        with table.lock:
            before = table.snapshot()
            log, tombs = before.log(), before.tombstones()
            sums = dead_ratio(log, tombs).first()
            kept, retained, purge = merged(log, tombs, self.config.purge_ratio)
            both = kept.withColumn("dead", F.lit(False)).union(retained.withColumn("dead", F.lit(True)))
            start = before.manifest.next_generation
            fresh = Manifest(before.manifest.version, start, start)
            ids = retained.select("id")
            staged = both.drop("generation", "segment_no", "dead").withColumn("place", F.col("id"))
            after = table._appended(fresh, staged)
            n_retained = 0
            if not purge and sums["hidden"]:
                view = Snapshot(table.spark, table.spec, table.root, after, table.segment_rows)
                folder = table._folder("tomb")
                view.log().select("id", "generation").join(ids, "id", "left_semi").write.parquet(f"{table.root}/{folder}")
                n_retained = table.spark.read.parquet(f"{table.root}/{folder}").count()
                after = Manifest(after.version, after.next_generation, after.first_generation, after.rows, after.logs, (folder,) if n_retained else ())
            done = table.publish(Manifest(before.manifest.version + 1, after.next_generation, after.first_generation, after.rows, after.logs, after.tombs))
            count = lambda s: s.sealed_segments + (1 if len(s) % s.segment_rows else 0)
            self.last = CompactionReport(len(before), len(done), count(before), count(done), int(sums["hidden"]) if purge else 0, n_retained)
            self._compacted = done.manifest.version
            return self.last

    def export(self) -> DataFrame:
        """For each segment, and the active buffer (null): rows, and rows whose id ever had a tombstone."""
        snapshot = self.snapshot()
        gone = snapshot.tombstones().select("id").distinct().withColumn("gone", F.lit(1))
        return segment_summary(snapshot.log().join(gone, "id", "left"))

    def watch(self, interval: float = 1.0) -> BackgroundCompaction:
        return BackgroundCompaction(self, interval)


def segment_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("segment_no").agg(F.count(F.lit(1)).alias("rows"), F.count("gone").alias("dead"))


class BackgroundCompaction:
    """A thread that compacts a table whenever it needs it; a failure is kept and tried again next time."""

    def __init__(self, lifecycle: Lifecycle, interval: float):
        self.lifecycle, self.interval, self.runs, self.error = lifecycle, interval, 0, None
        self._stop = threading.Event()
        self._thread = threading.Thread(target=self._run, name="compaction", daemon=True)
        self._thread.start()

    def _run(self) -> None:
        while not self._stop.wait(self.interval):
            try:
                if self.lifecycle.needed():
                    self.lifecycle.compact()
                    self.runs += 1
                self.error = None
            except Exception as e:  # shown to whoever asks, and tried again
                self.error = e

    def stop(self) -> None:
        self._stop.set()
        self._thread.join()
