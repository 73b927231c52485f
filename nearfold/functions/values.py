"""Metadata literals, their inference, metadata as JSON, checksums, colours."""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import SchemaViolation
from ..types import ColumnType, MetadataSchema

I64_MIN, I64_MAX = -(1 << 63), (1 << 63) - 1


def parse_literal(kind: ColumnType, raw: str):
    """A text as a value of a column type; texts are trimmed, booleans are of any case."""
    text = raw.strip()
    if kind is ColumnType.STRING:
        return text
    try:
        if kind is ColumnType.BOOL:
            return {"true": True, "false": False}[text.lower()]
        if kind is ColumnType.I64:
            if not re.fullmatch(r"[+-]?[0-9]+", text) or not I64_MIN <= int(text) <= I64_MAX:
                raise ValueError
            return int(text)
        return float(text)
    except (KeyError, ValueError):
        raise SchemaViolation(f"'{raw}' is no {kind.value}") from None


def literal_column(kind: ColumnType, raw: Column) -> Column:
    """parse_literal over a column; null where it can't be parsed."""
    text = F.trim(raw)
    if kind is ColumnType.STRING:
        return text
    if kind is ColumnType.BOOL:
        return F.when(F.lower(text) == "true", True).when(F.lower(text) == "false", False)
    if kind is ColumnType.I64:
        return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("long"))
    return text.try_cast("double")


def infer_json_type(value) -> ColumnType:
    if isinstance(value, bool):
        return ColumnType.BOOL
    if isinstance(value, (int, float)):
        return ColumnType.I64 if float(value).is_integer() else ColumnType.F64
    return ColumnType.STRING


def infer_text_type(raw: str) -> ColumnType:
    text = raw.strip()
    if text in ("true", "false"):
        return ColumnType.BOOL
    if re.fullmatch(r"-?[0-9]+", text):
        return ColumnType.I64
    if re.fullmatch(r"-?[0-9]*\.[0-9]+", text):
        return ColumnType.F64
    return ColumnType.STRING


def coerce_scalar(raw: str):
    """A rule's text as a boolean, a number or a text."""
    text = raw.strip()
    if text in ("true", "false"):
        return text == "true"
    try:
        number = float(text)
    except ValueError:
        return text
    return int(number) if number.is_integer() and re.fullmatch(r"[+-]?[0-9]+", text) else number


def metadata_json(schema: MetadataSchema) -> Column:
    """All metadata as a JSON object whose keys are in alphabetical order; whole doubles have no fraction."""
    parts = []
    for name in sorted(schema.names):
        kind, c = schema.type_of(name), F.col(f"`{name}`")
        if kind is ColumnType.STRING:
            value = F.substring_index(F.to_json(F.array(c)), "[", -1)
            value = F.expr(f"substring(to_json(array(`{name}`)), 2, length(to_json(array(`{name}`))) - 2)")
        elif kind is ColumnType.F64:
            value = F.when((c == F.floor(c)) & (F.abs(c) < 1e15), F.floor(c).cast("string")).otherwise(c.cast("string"))
        else:
            value = c.cast("string")
        parts.append(F.concat(F.lit(json.dumps(name, ensure_ascii=False) + ":"), value))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def crc32(data: Column) -> Column:
    """The usual reflected CRC-32 of a binary column."""
    return F.crc32(data)


def colour_index(value: Column, colours: int = 10) -> Column:
    """A text's FNV-1a hash over its characters, modulo the number of colours."""
    codes = F.transform(F.split(value, ""), lambda c: F.ascii(c).cast("long"))
    step = lambda acc, c: (acc.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(value == "", F.lit(2166136261 % colours)).otherwise(F.aggregate(codes, F.lit(2166136261), step) % colours)


def is_finite_number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)
