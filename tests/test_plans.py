import itertools
import random

import numpy as np
import pytest

from gridloom.plans import predicate as P
from gridloom.plans.region import Region, Space

SPACE = Space(("a", "b"), (6, 5))
AXES = P.Axes(SPACE, {"a": np.array([3.0, 1.0, np.nan, 7.0, 1.0, 4.5]), "b": range(10, 15)})


def truth(t, a, b, v):
    """Three-valued truth of a predicate at a cell, NaN as Spark has it."""
    kind = t[0]
    if kind == "lit":
        return t[1]
    if kind == "not":
        x = truth(t[1], a, b, v)
        return None if x is None else not x
    if kind in ("and", "or", "xor"):
        x, y = truth(t[1], a, b, v), truth(t[2], a, b, v)
        if kind == "xor":
            return None if x is None or y is None else x != y
        stop = kind == "or"
        return stop if stop in (x, y) else None if None in (x, y) else not stop
    if kind == "case":
        return truth(t[2] if truth(t[1], a, b, v) else t[3], a, b, v)
    x = {"a": a, "b": b, "v": v}[t[2] if kind == "cmp" else t[1]]
    if x is None:
        return None
    if kind == "in":
        return True if any(y is not None and x == y for y in t[2]) else None if None in t[2] else False
    y = t[3]
    nx, ny = x != x, y != y
    return {"==": x == y or (nx and ny), "!=": not (x == y or (nx and ny)), "<": not nx and (ny or x < y), "<=": ny or x <= y, ">": (nx and not ny) or (not ny and x > y), ">=": nx or x >= y}[t[1]]


def random_predicate(rng, depth):
    if depth == 0 or rng.random() < 0.25:
        name = rng.choice("aabbv")
        values = [0, 1, 3.0, 4.5, 4.6, 7, 10, 11, 12.5, 14, 99, -1]
        r = P.col(name)
        if rng.random() < 0.25:
            return r.is_in(rng.sample(values, 3) + [None] * rng.randint(0, 1))
        if rng.random() < 0.1:
            return P.lit(rng.choice([True, False, None]))
        return r._cmp(rng.choice(["==", "!=", "<", "<=", ">", ">="]), rng.choice([*values, float("nan")] if name == "a" else values))
    x, y = random_predicate(rng, depth - 1), random_predicate(rng, depth - 1)
    return rng.choice([lambda: x & y, lambda: x | y, lambda: x ^ y, lambda: ~x, lambda: P.when(x, y, random_predicate(rng, depth - 1)), lambda: P.when(x, y)])()


def test_pruning_is_sound_under_any_nesting():
    rng = random.Random(12)
    for _ in range(2500):
        p = random_predicate(rng, 3)
        yes, no = ({*r.cells()} for r in p.regions(AXES))
        for i, j in itertools.product(range(6), range(5)):
            for v in (None, 0, 11, 99):
                x = truth(p.tree, float(AXES.values["a"][i]), 10 + j, v)
                assert x is None or (i, j) in (yes if x else no), p.tree
        assert P.Predicate.loads(p.dumps()).regions(AXES)[0].boxes == p.regions(AXES)[0].boxes


def test_planned_predicates_are_exact():
    for p in (P.col("a") > 2, ~(P.col("b") > 12), (P.col("a") == 1) ^ (P.col("b") < 12), P.col("b").between(11, 13, "none"), P.col("a").is_nan()):
        yes, no = p.regions(AXES)
        assert {*yes.cells()} | {*no.cells()} == {*Region.full(SPACE).cells()} and not {*yes.cells()} & {*no.cells()}


def test_region_algebra():
    rng = random.Random(1)

    def region():
        boxes = []
        for _ in range(rng.randint(0, 3)):
            box = []
            for n in SPACE.sizes:
                lo = rng.randrange(n)
                box.append((lo, rng.randint(lo + 1, n)))
            boxes.append(tuple(box))
        return Region(SPACE, tuple(boxes))

    for _ in range(500):
        x, y = region(), region()
        a, b = {*x.cells()}, {*y.cells()}
        assert {*x.union(y).cells()} == a | b and {*x.intersect(y).cells()} == a & b and {*x.difference(y).cells()} == a - b
        assert {*x.negate().cells()} == {*Region.full(SPACE).cells()} - a
        assert {*x.project(["b"]).cells()} == {(j,) for _, j in a}
        assert a <= {*x.coarsened().cells()}


def test_errors():
    from gridloom.plans.chunks import ChunkGrid, InvalidShard
    from gridloom.plans.predicate import UnsupportedLiteral

    with pytest.raises(UnsupportedLiteral):
        P.col("a") == {"x": 1}
    with pytest.raises(UnsupportedLiteral):
        P.col("a") < [1, 2]
    for shard in ((4, 3), (4,)):
        with pytest.raises(InvalidShard):
            ChunkGrid(("a", "b"), (8, 8), (2, 2), shard)
