"""Predicates over metadata: a typed tree, its checks, its JSON form, and its compilation to a column.

The model has two truth values: a leaf over a missing value is false, and its negation true; a NaN equals nothing, is
unequal to everything and is in no order. Negations are pushed to the leaves, so that what can be pushed down to the
scan is; a negated leaf is `value is missing or not leaf`.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import SchemaViolation
from ..functions.values import I64_MAX, I64_MIN, coerce_scalar
from ..types import ColumnType, MetadataSchema

ORDERINGS = ("lt", "lte", "gt", "gte")
COMPARISONS = ("eq", "ne", *ORDERINGS)


@dataclass(frozen=True)
class Predicate:
    """A node: a comparison (value), `in` (values), `and` and `or` (children), `not` (one child)."""

    op: str
    column: str | None = None
    value: object = None
    values: tuple = ()
    children: tuple[Predicate, ...] = ()

    def __and__(self, other: Predicate) -> Predicate:
        return all_of(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return any_of(self, other)

    def __invert__(self) -> Predicate:
        return Predicate("not", children=(self,))


def compare(op: str, column: str, value) -> Predicate:
    if op not in COMPARISONS:
        raise SchemaViolation(f"unknown operator '{op}'")
    return Predicate(op, column, value)


def eq(column, value):
    return compare("eq", column, value)


def ne(column, value):
    return compare("ne", column, value)


def lt(column, value):
    return compare("lt", column, value)


def lte(column, value):
    return compare("lte", column, value)


def gt(column, value):
    return compare("gt", column, value)


def gte(column, value):
    return compare("gte", column, value)


def is_in(column, values):
    return Predicate("in", column, values=tuple(values))


def all_of(*children):
    return Predicate("and", children=tuple(children))


def any_of(*children):
    return Predicate("or", children=tuple(children))


def coerce(kind: ColumnType, value, column: str):
    """A literal as a value of the column's type; only whole numbers become doubles."""
    if kind is ColumnType.BOOL and isinstance(value, bool):
        return value
    if kind is ColumnType.I64 and isinstance(value, int) and not isinstance(value, bool) and I64_MIN <= value <= I64_MAX:
        return value
    if kind is ColumnType.F64 and isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value)
    if kind is ColumnType.STRING and isinstance(value, str):
        return value
    raise SchemaViolation(f"column '{column}' is {kind.value}, {value!r} is not")


def validate(predicate: Predicate, schema: MetadataSchema) -> None:
    """SchemaViolation for unknown columns, literals of another type, any comparison with a text, and orderings of booleans."""
    if predicate.op in ("and", "or", "not"):
        for child in predicate.children:
            validate(child, schema)
        return
    kind = schema.type_of(predicate.column)
    for value in predicate.values if predicate.op == "in" else (predicate.value,):
        if isinstance(value, str):
            raise SchemaViolation(f"texts can't be filtered on (column '{predicate.column}')")
        coerce(kind, value, predicate.column)
    if kind is ColumnType.STRING and predicate.op != "in":
        raise SchemaViolation(f"column '{predicate.column}' is a text and can't be filtered on")
    if kind is ColumnType.BOOL and predicate.op in ORDERINGS:
        raise SchemaViolation(f"booleans have no order (column '{predicate.column}')")


def _leaf(p: Predicate, kind: ColumnType, negated: bool) -> Column:
    c, double = F.col(f"`{p.column}`"), kind is ColumnType.F64
    if p.op == "in":
        values = [coerce(kind, v, p.column) for v in p.values]
        values = [v for v in values if not (double and math.isnan(v))]
        if not values:
            return F.lit(negated)
        inside = c.isin(values)
        return c.isNull() | ~inside if negated else inside
    value = coerce(kind, p.value, p.column)
    if double and math.isnan(value):  # nothing equals it or is ordered by it
        if p.op == "ne":
            return c.isNull() if negated else c.isNotNull()
        return F.lit(negated)
    plain = {"eq": c == value, "ne": c != value, "lt": c < value, "lte": c <= value, "gt": c > value, "gte": c >= value}[p.op]
    if not double:
        return c.isNull() | ~plain if negated else plain
    if p.op == "ne":
        return c.isNull() | ((c == value) & ~F.isnan(c)) if negated else plain | F.isnan(c)
    return c.isNull() | F.isnan(c) | ~plain if negated else plain & ~F.isnan(c)


def compile_predicate(p: Predicate, schema: MetadataSchema, negated: bool = False) -> Column:
    """The predicate as a boolean column in negation normal form."""
    if p.op == "not":
        return compile_predicate(p.children[0], schema, not negated)
    if p.op in ("and", "or"):
        parts = [compile_predicate(child, schema, negated) for child in p.children]
        both = (p.op == "and") != negated
        if not parts:
            return F.lit(both)
        return reduce((lambda a, b: a & b) if both else (lambda a, b: a | b), parts)
    return _leaf(p, schema.type_of(p.column), negated)


def from_json(text: str | None, schema: MetadataSchema) -> Predicate | None:
    """A predicate from its JSON form; null and blank mean none."""
    if text is None or not text.strip():
        return None
    try:
        tree = json.loads(text)
    except ValueError as e:
        raise SchemaViolation(f"the predicate is no JSON: {e}") from None
    return None if tree is None else _node(tree, schema)


def _node(tree, schema: MetadataSchema) -> Predicate:
    if not isinstance(tree, dict) or not isinstance(tree.get("op"), str):
        raise SchemaViolation("a predicate is an object with an op")
    op = tree["op"]
    if op in ("and", "or"):
        if not isinstance(tree.get("children"), list):
            raise SchemaViolation(f"'{op}' needs a list of children")
        return Predicate(op, children=tuple(_node(c, schema) for c in tree["children"]))
    if op == "not":
        if "child" not in tree:
            raise SchemaViolation("'not' needs a child")
        return Predicate(op, children=(_node(tree["child"], schema),))
    if op not in (*COMPARISONS, "in"):
        raise SchemaViolation(f"unknown operator '{op}'")
    if not isinstance(tree.get("column"), str):
        raise SchemaViolation(f"'{op}' needs a column")
    kind = schema.type_of(tree["column"])
    if op == "in":
        if not isinstance(tree.get("values"), list):
            raise SchemaViolation("'in' needs a list of values")
        return is_in(tree["column"], [coerce(kind, v, tree["column"]) for v in tree["values"]])
    if "value" not in tree:
        raise SchemaViolation(f"'{op}' needs a value")
    return compare(op, tree["column"], coerce(kind, tree["value"], tree["column"]))


def from_rules(rules: list[tuple[str, str, str]], root: str = "and", negate: bool = False) -> str | None:
    """The JSON form of rules (column, op, text of the value); values of `in` are parted by commas."""
    leaves = []
    for column, op, raw in rules:
        if not column.strip():
            raise SchemaViolation("every rule needs a column")
        if op == "in":
            leaves.append({"op": op, "column": column.strip(), "values": [coerce_scalar(v) for v in raw.split(",") if v.strip()]})
        else:
            leaves.append({"op": op, "column": column.strip(), "value": coerce_scalar(raw)})
    if not leaves:
        return None
    tree = leaves[0] if len(leaves) == 1 else {"op": root, "children": leaves}
    return json.dumps({"op": "not", "child": tree} if negate else tree)


def selectivity_categories(selectivity: float, categories: int) -> list[int] | None:
    """The categories 0 .. k - 1 that let about that share of rows through; none for all."""
    if selectivity >= 1 or categories == 0:
        return None
    return list(range(max(1, math.floor(selectivity * categories + 0.5))))


def selectivity_tiers(categories: int) -> list[float]:
    """Shares of one category each for every, a tenth, a hundredth and a thousandth of them."""
    return [1.0 / max(categories // d, 1) for d in (1, 10, 100, 1000)]
