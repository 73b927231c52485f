"""Metrics, column types, metadata schemas and table definitions."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import types as T

from .errors import SchemaViolation


class Metric(Enum):
    COSINE = "cosine"
    L2 = "l2"
    DOT = "dot"

    @classmethod
    def parse(cls, name: str) -> Metric:
        try:
            return cls(name.strip().lower())
        except ValueError:
            raise SchemaViolation(f"unknown metric '{name}': cosine, l2 or dot") from None


class ColumnType(Enum):
    BOOL = "bool"
    I64 = "i64"
    F64 = "f64"
    STRING = "string"

    @classmethod
    def parse(cls, name: str) -> ColumnType:
        try:
            return cls(name.strip().lower())
        except ValueError:
            raise SchemaViolation(f"unknown column type '{name}': bool, i64, f64 or string") from None

    @property
    def spark(self) -> T.DataType:
        return {"bool": T.BooleanType(), "i64": T.LongType(), "f64": T.DoubleType(), "string": T.StringType()}[self.value]


#: Columns of the log that no metadata column may be named after.
RESERVED = ("id", "vector", "generation", "segment_no", "distance")


def check_name(what: str, name: str) -> None:
    if not name.strip() or "\0" in name:
        raise SchemaViolation(f"{what} name must not be blank or hold a NUL")


@dataclass(frozen=True)
class MetadataSchema:
    """Ordered, uniquely named, typed columns; every record has every one of them."""

    columns: tuple[tuple[str, ColumnType], ...] = ()

    def __post_init__(self):
        seen = set()
        for name, kind in self.columns:
            check_name("column", name)
            if name in seen:
                raise SchemaViolation(f"column '{name}' is declared twice")
            if name in RESERVED:
                raise SchemaViolation(f"column '{name}' has a reserved name")
            if not isinstance(kind, ColumnType):
                raise SchemaViolation(f"column '{name}' has no column type")
            seen.add(name)

    @classmethod
    def of(cls, names: list[str], kinds: list[str]) -> MetadataSchema:
        if len(names) != len(kinds):
            raise SchemaViolation(f"{len(names)} column names but {len(kinds)} types")
        return cls(tuple((n, ColumnType.parse(k)) for n, k in zip(names, kinds)))

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.columns]

    def type_of(self, name: str) -> ColumnType:
        for n, kind in self.columns:
            if n == name:
                return kind
        raise SchemaViolation(f"unknown column '{name}'")


@dataclass(frozen=True)
class TableSpec:
    """What is fixed when a table is created."""

    name: str
    dimension: int
    metric: Metric
    schema: MetadataSchema = field(default_factory=MetadataSchema)

    def __post_init__(self):
        check_name("table", self.name)
        if self.dimension < 1:
            raise SchemaViolation("dimension must be greater than zero")

    @property
    def log_schema(self) -> T.StructType:
        metadata = [T.StructField(n, k.spark, False) for n, k in self.schema.columns]
        fixed = [T.StructField("id", T.LongType(), False), T.StructField("vector", T.ArrayType(T.FloatType(), False), False), T.StructField("generation", T.LongType(), False), T.StructField("segment_no", T.LongType(), True)]
        return T.StructType(fixed + metadata)


#: Rows that one call of search may return.
MAX_TOP_K = 1000


@dataclass(frozen=True)
class SearchOptions:
    """top_k from 1 to 1000; probes and ef_search are for index searches and have no effect on exact ones."""

    top_k: int = 10
    probes: int | None = None
    ef_search: int | None = None

    def __post_init__(self):
        if not 1 <= self.top_k <= MAX_TOP_K:
            raise SchemaViolation(f"top_k must be from 1 to {MAX_TOP_K}")
        if self.probes is not None and self.probes < 1:
            raise SchemaViolation("probes must be greater than zero")
