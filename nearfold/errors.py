"""Errors: what the caller can put right, and what it can't."""

from __future__ import annotations


class VectorError(Exception):
    """Base of all errors of this library."""

    error_class = "operational"


class Busy(VectorError):
    error_class = "caller_fixable"

    def __init__(self):
        super().__init__("all search permits are taken; try again later")


class DimensionMismatch(VectorError):
    error_class = "caller_fixable"

    def __init__(self, expected: int, actual: int):
        super().__init__(f"dimension mismatch: the table has {expected}, got {actual}")
        self.expected, self.actual = expected, actual


class SchemaViolation(VectorError):
    error_class = "caller_fixable"

    def __init__(self, reason: str):
        super().__init__(f"schema violation: {reason}")
        self.reason = reason


class TableNotFound(VectorError):
    error_class = "caller_fixable"

    def __init__(self, name: str):
        super().__init__(f"table not found: {name}")
        self.name = name


class StorageError(VectorError):
    """A folder or file can't be read or written."""


class CorruptSegment(VectorError):
    def __init__(self, detail: str):
        super().__init__(f"corrupt segment: {detail}")
        self.detail = detail
