"""Versioned vector tables: an append-only log and tombstones, published by manifests.

A version is a manifest that names the folders of its log and tombstones; a commit writes new folders first and then
creates the next manifest, which fails if another writer has created it. Readers keep the snapshot they opened.
"""

from __future__ import annotations

import json
import threading
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DimensionMismatch, SchemaViolation, StorageError, TableNotFound
from ..plans.predicates import Predicate
from ..types import ColumnType, MetadataSchema, Metric, SearchOptions, TableSpec
from . import search as S

#: Rows of a sealed segment, and the bounds within which it may be set.
SEGMENT_ROWS, SEGMENT_MIN, SEGMENT_MAX = 98_304, 65_536, 131_072
TOMB_SCHEMA = "id long, generation long"


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    next_generation: int = 0
    first_generation: int = 0
    rows: int = 0
    logs: tuple[str, ...] = ()
    tombs: tuple[str, ...] = ()


class _Store:
    """Small files and renames through Hadoop's file systems, so that any of Spark's stores will do."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        p = self._path(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def create(self, name: str, text: str) -> None:
        """A file that must not exist yet."""
        path = self._path(f"{self.root}/{name}")
        try:
            out = self.fs.create(path, False)
            out.write(bytearray(text.encode()))
            out.close()
        except Exception as e:
            raise StorageError(f"{path} can't be created: {str(e).splitlines()[0]}") from e

    def read(self, name: str) -> str:
        rows = self.spark.read.text(f"{self.root}/{name}", wholetext=True).collect()
        return rows[0][0]

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(f"{self.root}/{name}"), True)


@dataclass(frozen=True)
class Snapshot:
    """An immutable version of a table."""

    spark: SparkSession
    spec: TableSpec
    root: str
    manifest: Manifest
    segment_rows: int = SEGMENT_ROWS

    @property
    def sealed_segments(self) -> int:
        return self.manifest.rows // self.segment_rows

    def log(self) -> DataFrame:
        """All rows, hidden ones too; segment_no is null for rows of the active buffer."""
        fixed = [f for f in self.spec.log_schema if f.name != "segment_no"]
        schema = T.StructType(fixed)
        if not self.manifest.logs:
            return self.spark.createDataFrame([], self.spec.log_schema)
        rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in self.manifest.logs])
        place = F.col("generation") - self.manifest.first_generation
        segment = F.when(place < self.sealed_segments * self.segment_rows, F.floor(place / self.segment_rows).cast("long"))
        return rows.withColumn("segment_no", segment).select(*self.spec.log_schema.names)

    def sealed(self) -> DataFrame:
        return self.log().where("segment_no IS NOT NULL")

    def active(self) -> DataFrame:
        return self.log().where("segment_no IS NULL")

    def tombstones(self) -> DataFrame:
        if not self.manifest.tombs:
            return self.spark.createDataFrame([], TOMB_SCHEMA)
        return self.spark.read.schema(TOMB_SCHEMA).parquet(*[f"{self.root}/{p}" for p in self.manifest.tombs])

    def visible(self) -> DataFrame:
        return S.visible(self.log(), self.tombstones() if self.manifest.tombs else None)

    def tombstoned_ids(self) -> DataFrame:
        return self.tombstones().select("id").distinct().orderBy("id")

    def is_tombstoned(self, id_: int) -> bool:
        return not self.tombstones().where(F.col("id") == id_).isEmpty()

    def __len__(self) -> int:
        return self.manifest.rows

    def search(self, query: list[float], predicate: Predicate | None = None, options: SearchOptions = SearchOptions()) -> DataFrame:
        return S.search(self.spec, self.log(), self.tombstones() if self.manifest.tombs else None, query, predicate, options)

    def exact_search(self, query: list[float], k: int = 10, predicate: Predicate | None = None) -> DataFrame:
        return S.exact_search(self.spec, self.log(), query, k, predicate)

    def export(self) -> DataFrame:
        """id, vector and metadata as JSON of all rows, hidden ones too, in the order of insertion."""
        from ..functions.values import metadata_json

        return self.log().orderBy("generation").select("id", "vector", metadata_json(self.spec.schema).alias("metadata_json"))


class VectorTable:
    """A table in a folder; one writer at a time, any number of readers of snapshots."""

    def __init__(self, spark: SparkSession, spec: TableSpec, root: str, segment_rows: int = SEGMENT_ROWS):
        self.spark, self.spec, self.root, self.segment_rows = spark, spec, root.rstrip("/"), segment_rows
        self.store = _Store(spark, self.root)
        self.lock = threading.RLock()

    def manifest(self) -> Manifest:
        names = sorted(n for n in self.store.names("manifests") if n.endswith(".json"))
        if not names:
            return Manifest()
        found = json.loads(self.store.read(f"manifests/{names[-1]}"))
        return Manifest(**{**found, "logs": tuple(found["logs"]), "tombs": tuple(found["tombs"])})

    def snapshot(self) -> Snapshot:
        return Snapshot(self.spark, self.spec, self.root, self.manifest(), self.segment_rows)

    def publish(self, manifest: Manifest) -> Snapshot:
        body = {"version": manifest.version, "next_generation": manifest.next_generation, "first_generation": manifest.first_generation, "rows": manifest.rows, "logs": manifest.logs, "tombs": manifest.tombs}
        self.store.create(f"manifests/{manifest.version:012d}.json", json.dumps(body))
        return Snapshot(self.spark, self.spec, self.root, manifest, self.segment_rows)

    def _folder(self, kind: str) -> str:
        return f"{kind}/{uuid.uuid4().hex}"

    def frame(self, records: list[dict]) -> DataFrame:
        """Records (id, vector, metadata) as a DataFrame in their order; wrong keys and types are refused."""
        from ..plans.predicates import coerce

        names, rows = self.spec.schema.names, []
        for place, r in enumerate(records):
            metadata = r.get("metadata", {})
            if set(metadata) != set(names):
                raise SchemaViolation(f"record {r.get('id')} has the columns {sorted(metadata)}, not {sorted(names)}")
            if len(r["vector"]) != self.spec.dimension:
                raise DimensionMismatch(self.spec.dimension, len(r["vector"]))
            if isinstance(r["id"], bool) or not isinstance(r["id"], int) or not 0 <= r["id"] < 1 << 63:
                raise SchemaViolation(f"id {r['id']!r} is no whole number below 2**63")
            for n in names:
                kind = self.spec.schema.type_of(n)
                if kind is ColumnType.F64 and not isinstance(metadata[n], float):
                    raise SchemaViolation(f"column '{n}' is f64, {metadata[n]!r} is not")
                coerce(kind, metadata[n], n)
            rows.append((place, r["id"], [float(x) for x in r["vector"]], *[metadata[n] for n in names]))
        schema = T.StructType([T.StructField("place", T.LongType()), T.StructField("id", T.LongType()), T.StructField("vector", T.ArrayType(T.FloatType())), *[T.StructField(n, k.spark) for n, k in self.spec.schema.columns]])
        return self.spark.createDataFrame(rows, schema)

    def validated(self, rows: DataFrame) -> DataFrame:
        """The rows with the log's types; one aggregation finds what breaks the schema."""
        names = self.spec.schema.names
        missing = [n for n in ("id", "vector", *names) if n not in rows.columns]
        extra = [n for n in rows.columns if n not in ("id", "vector", "place", *names)]
        if missing or extra:
            raise SchemaViolation(f"columns missing: {missing}, not declared: {extra}")
        wider = {("int", "bigint"), ("smallint", "bigint"), ("tinyint", "bigint"), ("float", "double"), ("array<double>", "array<float>")}
        wanted = {"id": "bigint", "vector": "array<float>"} | {n: k.spark.simpleString() for n, k in self.spec.schema.columns}
        for n, kind in wanted.items():
            have = rows.schema[n].dataType.simpleString()
            if have != kind and (have, kind) not in wider:
                raise SchemaViolation(f"column '{n}' is {kind}, not {have}")
        rows = rows.select(*(["place"] if "place" in rows.columns else []), *[F.col(f"`{n}`").cast(k).alias(n) for n, k in wanted.items()])
        bad = rows.agg(
            F.count_if(F.col("id").isNull() | (F.col("id") < 0)).alias("ids"),
            F.max(F.when(F.size("vector") != self.spec.dimension, F.size("vector"))).alias("dimension"),
            F.count_if(F.col("vector").isNull() | F.exists("vector", lambda x: x.isNull())).alias("vectors"),
            *[F.count_if(F.col(f"`{n}`").isNull()).alias(f"null {n}") for n in names],
        ).first()
        if bad["dimension"] is not None and bad["dimension"] >= 0:
            raise DimensionMismatch(self.spec.dimension, bad["dimension"])
        for what in bad.asDict():
            if what != "dimension" and bad[what]:
                raise SchemaViolation(f"{bad[what]} records without a proper value: {what}")
        return rows

    def _appended(self, manifest: Manifest, rows: DataFrame) -> Manifest:
        """Writes rows with dense generations in the order of `place`, or of their partitions."""
        if "place" in rows.columns:
            rows = rows.orderBy("place").drop("place")
        marked = rows.withColumn("mark", F.monotonically_increasing_id())
        part = F.shiftright("mark", 33)
        counts = {r["part"]: r["count"] for r in marked.groupBy(part.alias("part")).count().collect()}  # a row for each partition
        total, first = 0, {}
        for p in sorted(counts):
            first[p], total = total, total + counts[p]
        if not total:
            return manifest
        offsets = self.spark.createDataFrame([(p, manifest.next_generation + at) for p, at in first.items()], "part long, first long")
        numbered = marked.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("generation", F.col("first") + F.col("mark").bitwiseAND(F.lit((1 << 33) - 1)))
        folder = self._folder("log")
        fields = [f.name for f in self.spec.log_schema if f.name != "segment_no"]
        numbered.select(*[f"`{n}`" for n in fields]).write.option("maxRecordsPerFile", self.segment_rows).parquet(f"{self.root}/{folder}")
        return replace(manifest, version=manifest.version + 1, next_generation=manifest.next_generation + total, rows=manifest.rows + total, logs=(*manifest.logs, folder))

    def _deleted(self, snapshot: Snapshot, ids: DataFrame) -> Manifest:
        gone = snapshot.visible().select("id", "generation").join(ids.select(F.col("id").cast("long").alias("id")).distinct(), "id", "left_semi")
        folder = self._folder("tomb")
        gone.write.parquet(f"{self.root}/{folder}")
        return replace(snapshot.manifest, version=snapshot.manifest.version + 1, tombs=(*snapshot.manifest.tombs, folder))

    def ids(self, ids) -> DataFrame:
        return ids if isinstance(ids, DataFrame) else self.spark.createDataFrame([(int(i),) for i in ids], "id long")

    def insert(self, rows) -> Snapshot:
        """Appends records or a DataFrame; all of them are checked before any is seen."""
        with self.lock:
            frame = self.validated(rows if isinstance(rows, DataFrame) else self.frame(rows))
            before = self.manifest()
            after = self._appended(before, frame)
            return self.snapshot() if after is before else self.publish(after)

    def delete(self, ids) -> Snapshot:
        """Hides every current row of the ids; unknown ids are passed over."""
        with self.lock:
            return self.publish(self._deleted(self.snapshot(), self.ids(ids)))

    def update(self, rows) -> Snapshot:
        """Replaces the rows of the records' ids, in one version."""
        with self.lock:
            frame = self.validated(rows if isinstance(rows, DataFrame) else self.frame(rows))
            snapshot = self.snapshot()
            hidden = self._deleted(snapshot, frame.select("id"))
            added = self._appended(hidden, frame)
            return self.publish(replace(added, version=snapshot.manifest.version + 1))

    def insert_flat(self, ids: list[int], flat: list[float], names=(), kinds=(), values=()) -> Snapshot:
        """Rows from flat lists: dimension numbers and one text for each metadata column a row."""
        from ..functions.values import parse_literal

        n, dim = len(ids), self.spec.dimension
        if len(flat) != n * dim:
            raise DimensionMismatch(n * dim, len(flat))
        if len(names) != len(kinds) or len(values) != n * len(names):
            raise SchemaViolation("names, types and values do not match the rows")
        types = [ColumnType.parse(k) for k in kinds]
        width = len(names)
        return self.insert([
            {"id": i, "vector": flat[r * dim : (r + 1) * dim], "metadata": {c: parse_literal(k, values[r * width + j]) for j, (c, k) in enumerate(zip(names, types))}}
            for r, i in enumerate(ids)
        ])


class Catalog:
    """Tables by name; dropping one forgets its definition and leaves its data."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.tables: dict[str, VectorTable] = {}

    def create(self, name: str, dimension: int, metric: Metric | str = Metric.COSINE, schema: MetadataSchema = MetadataSchema(), segment_rows: int = SEGMENT_ROWS) -> VectorTable:
        spec = TableSpec(name, dimension, metric if isinstance(metric, Metric) else Metric.parse(metric), schema)
        if name in self.tables:
            raise SchemaViolation(f"table '{name}' exists")
        self.tables[name] = VectorTable(self.spark, spec, f"{self.root}/{uuid.uuid4().hex}", segment_rows)
        return self.tables[name]

    def open(self, name: str) -> VectorTable:
        if name not in self.tables:
            raise TableNotFound(name)
        return self.tables[name]

    def drop(self, name: str) -> None:
        self.open(name)
        del self.tables[name]

    def names(self) -> list[str]:
        return list(self.tables)

    def status(self) -> dict:
        each = {n: len(t.snapshot()) for n, t in self.tables.items()}
        return {"tables": len(each), "vectors": sum(each.values()), "by_table": each}
