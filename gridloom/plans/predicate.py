"""Predicates that are both Spark columns and plans over index space.

A predicate compiles to two regions: cells where it may be true and cells where
it may be false, each never too small (null is in neither).  NOT swaps them, AND
and OR meet and join them, so pruning stays sound under any nesting: what can't be
planned may be true and false everywhere.  Rows are always filtered again.
"""

from __future__ import annotations

import datetime as dt
import decimal
import json
import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .region import Region, Space

_FLIP = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "==": "==", "!=": "!="}


@dataclass(frozen=True)
class Axes:
    """The space and each dimension's coordinate values: an array, or a range of whole numbers (None: the index)."""

    space: Space
    values: dict[str, np.ndarray | range | None]
    #: Dimensions whose coordinates are known to rise; compared by binary search.
    rising: frozenset[str] = frozenset()

    def coords(self, dim: str) -> np.ndarray | range:
        found = self.values.get(dim)
        return range(self.space.sizes[self.space.dims.index(dim)]) if found is None else found


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])]


class UnsupportedLiteral(TypeError):
    """A column is compared with something that is no single value."""


#: What a column can be compared with.
LITERALS = (bool, int, float, str, bytes, dt.date, dt.datetime, dt.timedelta, decimal.Decimal, np.generic)


def literal(value, like: np.ndarray):
    """A literal as compared with coordinates of an array's type; None if it can't be."""
    kind = like.dtype.kind
    if kind == "M":
        if isinstance(value, (dt.datetime, dt.date)):
            if isinstance(value, dt.datetime) and value.tzinfo is not None:
                value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
            return np.datetime64(value, "us")
        return value.astype("datetime64[us]") if isinstance(value, np.datetime64) else None
    if kind == "m":
        if isinstance(value, dt.timedelta):
            return np.timedelta64(value, "us")
        return value.astype("timedelta64[us]") if isinstance(value, np.timedelta64) else None
    if kind in "iuf":
        return value if isinstance(value, (int, float, np.integer, np.floating)) and not isinstance(value, bool) else None
    if kind == "b":
        return value if isinstance(value, (bool, np.bool_)) else None
    if kind in "OUT":
        return value if isinstance(value, str) else None
    return None


def compare(values: np.ndarray, op: str, value) -> np.ndarray | None:
    """Where a comparison holds, as Spark has it: NaN equals NaN and is larger than all else."""
    value = literal(value, values)
    if value is None:
        return None
    if values.dtype.kind in "iu" and isinstance(value, float):
        if math.isnan(value) or math.isinf(value):
            return np.full(len(values), {"<": not value < 0, "<=": not value < 0, ">": value < 0, ">=": value < 0, "==": False, "!=": True}[op])
        # Whole numbers are compared with the whole numbers around a fraction, so that none is rounded.
        low = math.floor(value)
        if low != value:
            return {"<": values <= low, "<=": values <= low, ">": values > low, ">=": values > low, "==": np.zeros(len(values), bool), "!=": np.ones(len(values), bool)}[op]
        value = low
    if values.dtype.kind in "iu" and not np.iinfo(values.dtype).min <= value <= np.iinfo(values.dtype).max:
        above = value > 0
        return np.full(len(values), {"<": above, "<=": above, ">": not above, ">=": not above, "==": False, "!=": True}[op])
    if values.dtype.kind == "f":
        nan = np.isnan(values)
        if math.isnan(value):
            return {"<": ~nan, "<=": np.ones(len(values), bool), ">": np.zeros(len(values), bool), ">=": nan, "==": nan, "!=": ~nan}[op]
        # A narrow float is compared as a double.
        values = values.astype(np.float64)
        with np.errstate(invalid="ignore"):
            return {"<": values < value, "<=": values <= value, ">": (values > value) | nan, ">=": (values >= value) | nan, "==": values == value, "!=": values != value}[op]
    return {"<": values < value, "<=": values <= value, ">": values > value, ">=": values >= value, "==": values == value, "!=": values != value}[op]


class Predicate:
    """``tree`` is nested lists of plain values, so a predicate can be sent as text."""

    def __init__(self, tree: list):
        self.tree = tree

    def __and__(self, other: Predicate) -> Predicate:
        return Predicate(["and", self.tree, other.tree])

    def __or__(self, other: Predicate) -> Predicate:
        return Predicate(["or", self.tree, other.tree])

    def __xor__(self, other: Predicate) -> Predicate:
        return Predicate(["xor", self.tree, other.tree])

    def __invert__(self) -> Predicate:
        return Predicate(["not", self.tree])

    def __bool__(self):
        raise TypeError("use &, |, ^ and ~ on predicates")

    @property
    def column(self) -> Column:
        return _column(self.tree)

    @property
    def refs(self) -> set[str]:
        return _refs(self.tree)

    def regions(self, axes: Axes) -> tuple[Region, Region]:
        """Where the predicate may be true, and where it may be false."""
        return _regions(self.tree, axes)

    def dumps(self) -> str:
        return json.dumps(self.tree, default=_encode)

    @classmethod
    def loads(cls, text: str) -> Predicate:
        return cls(json.loads(text, object_hook=_decode))


def _encode(v):
    if isinstance(v, dt.datetime):
        return {"$": "datetime", "v": v.isoformat()}
    if isinstance(v, dt.date):
        return {"$": "date", "v": v.isoformat()}
    if isinstance(v, dt.timedelta):
        return {"$": "us", "v": v // dt.timedelta(microseconds=1)}
    if isinstance(v, np.generic):
        return v.item()
    raise TypeError(f"not a literal: {v!r}")


def _decode(d: dict):
    kind = d.get("$")
    if kind == "datetime":
        return dt.datetime.fromisoformat(d["v"])
    if kind == "date":
        return dt.date.fromisoformat(d["v"])
    return dt.timedelta(microseconds=d["v"]) if kind == "us" else d


class Ref:
    """A column, to build predicates from; ``field`` goes into structs."""

    def __init__(self, name: str):
        self.name = name

    def field(self, name: str) -> Ref:
        return Ref(f"{self.name}.{name}")

    def _cmp(self, op: str, value) -> Predicate:
        if isinstance(value, Ref):
            return Predicate(["cmp2", op, self.name, value.name])
        if not (value is None or isinstance(value, LITERALS)):
            raise UnsupportedLiteral(f"{self.name} {op} {type(value).__name__}")
        return Predicate(["cmp", op, self.name, value])

    def __eq__(self, v):  # type: ignore[override]
        return self._cmp("==", v)

    def __ne__(self, v):  # type: ignore[override]
        return self._cmp("!=", v)

    def __lt__(self, v):
        return self._cmp("<", v)

    def __le__(self, v):
        return self._cmp("<=", v)

    def __gt__(self, v):
        return self._cmp(">", v)

    def __ge__(self, v):
        return self._cmp(">=", v)

    __hash__ = None  # type: ignore[assignment]

    def between(self, low, high, closed: str = "both") -> Predicate:
        """``closed``: both, left, right or none."""
        a = self >= low if closed in ("both", "left") else self > low
        return a & (self <= high if closed in ("both", "right") else self < high)

    def is_in(self, values: Iterable) -> Predicate:
        return Predicate(["in", self.name, list(values)])

    def test(self, kind: str) -> Predicate:
        """null, not_null, nan, not_nan, finite or infinite."""
        return Predicate(["is", kind, self.name])

    def is_null(self):
        return self.test("null")

    def is_not_null(self):
        return self.test("not_null")

    def is_nan(self):
        return self.test("nan")

    def is_not_nan(self):
        return self.test("not_nan")

    def is_finite(self):
        return self.test("finite")

    def is_infinite(self):
        return self.test("infinite")


def col(name: str) -> Ref:
    return Ref(name)


def lit(value: bool | None) -> Predicate:
    return Predicate(["lit", value])


def sql(text: str, refs: Iterable[str] = ()) -> Predicate:
    """Any boolean SQL expression: filtered on, never planned; ``refs`` are the columns it reads."""
    return Predicate(["sql", text, list(refs)])


def any_of(items: Iterable[Predicate]) -> Predicate:
    return reduce(lambda a, b: a | b, items, lit(False))


def all_of(items: Iterable[Predicate]) -> Predicate:
    return reduce(lambda a, b: a & b, items, lit(True))


def when(p: Predicate, then: Predicate, otherwise: Predicate | None = None) -> Predicate:
    return Predicate(["case", p.tree, then.tree, (lit(None) if otherwise is None else otherwise).tree])


def _name(name: str) -> Column:
    return F.col(".".join(f"`{part}`" for part in name.split(".")))


def _column(t: list) -> Column:
    kind = t[0]
    if kind in ("cmp", "cmp2"):
        a, b = _name(t[2]), (F.lit(t[3]) if kind == "cmp" else _name(t[3]))
        return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[t[1]]
    if kind == "in":
        return _name(t[1]).isin(t[2]) if t[2] else F.lit(False)
    if kind == "is":
        c = _name(t[2])
        infinite = c.cast("double").isin(float("inf"), float("-inf"))
        return {"null": c.isNull(), "not_null": c.isNotNull(), "nan": F.isnan(c), "not_nan": ~F.isnan(c), "infinite": infinite, "finite": ~(infinite | F.isnan(c))}[t[1]]
    if kind == "lit":
        return F.lit(t[1]).cast("boolean")
    if kind == "sql":
        return F.expr(t[1])
    if kind == "not":
        return ~_column(t[1])
    if kind == "case":
        return F.when(_column(t[1]), _column(t[2])).otherwise(_column(t[3]))
    a, b = _column(t[1]), _column(t[2])
    return {"and": a & b, "or": a | b, "xor": a != b}[kind]


def _refs(t: list) -> set[str]:
    kind = t[0]
    if kind == "cmp":
        return {t[2]}
    if kind == "cmp2":
        return {t[2], t[3]}
    if kind == "in":
        return {t[1]}
    if kind == "is":
        return {t[2]}
    if kind == "sql":
        return set(t[2])
    return set().union(*[_refs(x) for x in t[1:] if isinstance(x, list)]) if kind != "lit" else set()


def _regions(t: list, axes: Axes) -> tuple[Region, Region]:
    kind = t[0]
    full, none = Region.full(axes.space), Region.empty(axes.space)
    if kind == "not":
        yes, no = _regions(t[1], axes)
        return no, yes
    if kind in ("and", "or", "xor"):
        (t1, f1), (t2, f2) = _regions(t[1], axes), _regions(t[2], axes)
        if kind == "and":
            out = t1.meet(t2), f1.union(f2)
        elif kind == "or":
            out = t1.union(t2), f1.meet(f2)
        else:
            out = t1.meet(f2).union(f1.meet(t2)), t1.meet(t2).union(f1.meet(f2))
        return out[0].coarsened(), out[1].coarsened()
    if kind == "case":
        (pt, _), (xt, xf), (yt, yf) = (_regions(x, axes) for x in t[1:])
        # The last branch is also taken where the condition is null, so it isn't narrowed.
        return pt.meet(xt).union(yt).coarsened(), pt.meet(xf).union(yf).coarsened()
    if kind == "lit":
        return {True: (full, none), False: (none, full), None: (none, none)}[t[1]]
    name = t[2] if kind in ("cmp", "is") else t[1]
    if kind in ("cmp", "in", "is") and name in axes.space.dims:
        values = axes.coords(name)
        size = len(values)
        along = lambda found: Region.along(axes.space, name, found).coarsened()
        if kind == "cmp":
            if t[3] is None:
                return none, none
            yes = _holds(values, t[1], t[3], name in axes.rising)
        elif kind == "in":
            each = [_holds(values, "==", v, name in axes.rising) for v in t[2] if v is not None]
            yes = None if any(e is None for e in each) else merged([r for e in each for r in e])
            if yes is not None and any(v is None for v in t[2]):
                # With a null in the list, what isn't found is null.
                return along(yes), none
        else:
            floats = isinstance(values, np.ndarray) and values.dtype.kind == "f"
            nan = runs(np.isnan(values)) if floats else []
            inf = runs(np.isinf(values)) if floats else []
            all_, odd = [(0, size)], merged(nan + inf)
            yes = {"null": [], "not_null": all_, "nan": nan, "not_nan": gaps(nan, size), "infinite": inf, "finite": gaps(odd, size)}[t[1]]
            if isinstance(values, np.ndarray) and values.dtype.kind in "mM" and t[1] in ("null", "not_null"):
                gone = runs(np.isnat(values))
                yes = gone if t[1] == "null" else gaps(gone, size)
        if yes is not None:
            return along(yes), along(gaps(yes, size))
    return full, full


def merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, without overlaps."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(found):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def gaps(found: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """What ordered ranges leave of 0 to ``size``."""
    ends = [0, *[x for r in found for x in r], size]
    return [(lo, hi) for lo, hi in zip(ends[::2], ends[1::2]) if lo < hi]


def _holds(values, op: str, value, rising: bool) -> list[tuple[int, int]] | None:
    """Where a comparison holds, as ranges of indices; None if it can't be told."""
    if isinstance(values, range):
        return _range_holds(values, op, value)
    mask = _searched(values, op, value) if rising else compare(values, op, value)
    return None if mask is None else runs(mask)


def _range_holds(values: range, op: str, value) -> list[tuple[int, int]] | None:
    """As compare, by arithmetic over consecutive whole numbers."""
    if not isinstance(value, (int, float, np.integer, np.floating)) or isinstance(value, bool):
        return None
    n, start = len(values), values.start
    if isinstance(value, float) and not math.isfinite(value):
        above = not value < 0
        return {"<": above, "<=": above, ">": not above, ">=": not above, "==": False, "!=": True}[op] and [(0, n)] or []
    below = min(max(math.ceil(value) - start, 0), n)
    upto = min(max(math.floor(value) + 1 - start, 0), n)
    found = {"<": [(0, below)], "<=": [(0, upto)], ">": [(upto, n)], ">=": [(below, n)], "==": [(below, upto)], "!=": [(0, below), (upto, n)]}[op]
    return [(lo, hi) for lo, hi in found if lo < hi]


def _searched(values: np.ndarray, op: str, value) -> np.ndarray | None:
    """As compare, by binary search in rising coordinates."""
    v = literal(value, values)
    if v is None or values.dtype.kind not in "iumM" or isinstance(v, float):
        return compare(values, op, value)
    left, right = np.searchsorted(values, v, "left"), np.searchsorted(values, v, "right")
    mask = np.zeros(len(values), bool)
    mask[{"<": slice(0, left), "<=": slice(0, right), ">": slice(right, None), ">=": slice(left, None), "==": slice(left, right), "!=": slice(left, right)}[op]] = True
    return ~mask if op == "!=" else mask


def from_sql(spark: SparkSession, text: str) -> Predicate:
    """A predicate from SQL text, by Spark's own parser: what it can't plan is kept as SQL."""
    parse = spark._jsparkSession.sessionState().sqlParser().parseExpression
    return Predicate(_from_catalyst(parse(text)))


def _from_catalyst(e) -> list:
    name = e.getClass().getSimpleName()
    kids = [e.children().apply(i) for i in range(e.children().size())]
    ops = {"EqualTo": "==", "LessThan": "<", "LessThanOrEqual": "<=", "GreaterThan": ">", "GreaterThanOrEqual": ">="}
    if name in ("And", "Or"):
        return [name.lower(), _from_catalyst(kids[0]), _from_catalyst(kids[1])]
    if name == "Not":
        return ["not", _from_catalyst(kids[0])]
    if name in ops:
        a, b = _attribute(kids[0]), _attribute(kids[1])
        if a and (v := _value(kids[1])):
            return ["cmp", ops[name], a, v[0]]
        if b and (v := _value(kids[0])):
            return ["cmp", _FLIP[ops[name]], b, v[0]]
        if a and b:
            return ["cmp2", ops[name], a, b]
    if name == "In" and (a := _attribute(kids[0])) and all(_value(k) for k in kids[1:]):
        return ["in", a, [_value(k)[0] for k in kids[1:]]]
    if name in ("IsNull", "IsNotNull") and (a := _attribute(kids[0])):
        return ["is", "null" if name == "IsNull" else "not_null", a]
    if name == "Literal" and (v := _value(e)) and (v[0] is None or isinstance(v[0], bool)):
        return ["lit", v[0]]
    refs: set[str] = set()
    _walk(e, lambda x: refs.add(a) if (a := _attribute(x)) else None)
    return ["sql", e.sql(), sorted(refs)]


def _walk(e, f: Callable) -> None:
    f(e)
    for i in range(e.children().size()):
        _walk(e.children().apply(i), f)


def _attribute(e) -> str | None:
    if e.getClass().getSimpleName() != "UnresolvedAttribute":
        return None
    parts = e.nameParts()
    return ".".join(parts.apply(i) for i in range(parts.size()))


def _value(e) -> tuple | None:
    """The Python value of a literal, in a tuple; None for anything else."""
    if e.getClass().getSimpleName() == "UnaryMinus" and (v := _value(e.children().apply(0))) and isinstance(v[0], (int, float)):
        return (-v[0],)
    if e.getClass().getSimpleName() != "Literal":
        return None
    kind, v = e.dataType().typeName(), e.value()
    if v is None:
        return (None,)
    if kind in ("integer", "long", "short", "byte", "double", "float", "boolean"):
        return (v,)
    if kind == "string":
        return (str(v.toString()),)
    if kind.startswith("decimal"):
        return (float(v.toString()),)
    if kind in ("timestamp", "timestamp_ntz"):
        return (dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=v),)
    if kind == "date":
        return (dt.date(1970, 1, 1) + dt.timedelta(days=v),)
    if kind.startswith("interval day") or kind.startswith("interval hour"):
        return (dt.timedelta(microseconds=v),)
    return None
