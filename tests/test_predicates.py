import math
import random

import pytest

from nearfold.errors import SchemaViolation
from nearfold.plans import predicates as P
from nearfold.types import ColumnType, MetadataSchema

SCHEMA = MetadataSchema((("active", ColumnType.BOOL), ("rank", ColumnType.I64), ("ratio", ColumnType.F64), ("label", ColumnType.STRING)))


def holds(p, row) -> bool:
    """The semantics, row by row: two truth values, a missing value makes a leaf false."""
    if p.op == "and":
        return all(holds(c, row) for c in p.children)
    if p.op == "or":
        return any(holds(c, row) for c in p.children)
    if p.op == "not":
        return not holds(p.children[0], row)
    v = row[p.column]
    if v is None:
        return False
    if p.op == "in":
        return any(v == x for x in p.values)
    return {"eq": v == p.value, "ne": v != p.value, "lt": v < p.value, "lte": v <= p.value, "gt": v > p.value, "gte": v >= p.value}[p.op]


def random_tree(rng, depth=3):
    if depth and rng.random() < 0.6:
        op = rng.choice(["and", "or", "not"])
        n = 1 if op == "not" else rng.randrange(0, 4)
        return P.Predicate(op, children=tuple(random_tree(rng, depth - 1) for _ in range(n)))
    column = rng.choice(["active", "rank", "ratio"])
    value = {"active": lambda: rng.random() < 0.5, "rank": lambda: rng.randrange(6), "ratio": lambda: rng.choice([0.0, 0.5, 1.0, math.nan])}[column]
    ops = ["eq", "ne"] if column == "active" else list(P.COMPARISONS)
    if rng.random() < 0.2:
        return P.is_in(column, [value() for _ in range(rng.randrange(3))])
    return P.compare(rng.choice(ops), column, value())


def test_random_trees(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([True, False, None]), rng.choice([None, *range(6)]), rng.choice([None, 0.0, 0.5, 1.0, math.nan]), "x") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, active boolean, rank long, ratio double, label string").cache()
    trees = [random_tree(rng) for _ in range(120)]
    for t in trees:
        P.validate(t, SCHEMA)
    flags = df.select("id", *[P.compile_predicate(t, SCHEMA).alias(f"t{i}") for i, t in enumerate(trees)]).collect()
    for r in flags:
        row = dict(zip(("active", "rank", "ratio", "label"), rows[r["id"]][1:]))
        for i, t in enumerate(trees):
            assert bool(r[f"t{i}"]) == holds(t, row), (t, row)


@pytest.mark.parametrize("bad", [P.eq("nope", 1), P.eq("rank", True), P.eq("rank", 1.5), P.eq("label", "v"), P.lt("active", True), P.eq("active", 1), P.is_in("rank", [1, "a"]), P.eq("rank", 1 << 63)])
def test_refused(bad):
    with pytest.raises(SchemaViolation):
        P.validate(bad, SCHEMA)


def test_empty_in_of_texts_passes():
    P.validate(P.is_in("label", []), SCHEMA)


def test_json():
    text = '{"op":"and","children":[{"op":"gte","column":"rank","value":2},{"op":"not","child":{"op":"in","column":"ratio","values":[1,2.5]}}]}'
    assert P.from_json(text, SCHEMA) == P.gte("rank", 2) & ~P.is_in("ratio", [1.0, 2.5])
    assert P.from_json(None, SCHEMA) is None and P.from_json("  ", SCHEMA) is None
    for bad in ("{", "[]", '{"op":"xor"}', '{"op":"eq","column":"rank"}', '{"op":"eq","column":"rank","value":1.5}', '{"op":"in","column":"rank","value":1}', '{"op":"and"}', '{"op":"not"}'):
        with pytest.raises(SchemaViolation):
            P.from_json(bad, SCHEMA)


def test_rules():
    assert P.from_rules([]) is None
    assert P.from_json(P.from_rules([("rank", "gt", "3")], negate=True), SCHEMA) == ~P.gt("rank", 3)
    assert P.from_json(P.from_rules([("rank", "in", "1, 2"), ("active", "eq", "true")], "or"), SCHEMA) == P.any_of(P.is_in("rank", [1, 2]), P.eq("active", True))
    with pytest.raises(SchemaViolation):
        P.from_rules([(" ", "eq", "1")])


def test_tiers():
    assert P.selectivity_categories(1.0, 10) is None and P.selectivity_categories(0.5, 0) is None
    assert P.selectivity_categories(0.5, 4) == [0, 1] and P.selectivity_categories(0.001, 10) == [0]
    assert P.selectivity_tiers(1000) == [0.001, 0.01, 0.1, 1.0]
