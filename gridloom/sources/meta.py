"""Metadata of a hierarchy of arrays, and the tidy schema that follows from it."""

from __future__ import annotations

import datetime as dt
import json
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import types as T

from .codecs import DTYPES
from .stores import Store, open_store

#: Names of time units, in nanoseconds.
UNITS = {
    "ns": 1, "nanosecond": 1, "nanoseconds": 1,
    "us": 1_000, "µs": 1_000, "microsecond": 1_000, "microseconds": 1_000,
    "ms": 1_000_000, "millisecond": 1_000_000, "milliseconds": 1_000_000,
    "s": 10**9, "sec": 10**9, "second": 10**9, "seconds": 10**9,
    "m": 60 * 10**9, "min": 60 * 10**9, "minute": 60 * 10**9, "minutes": 60 * 10**9,
    "h": 3600 * 10**9, "hr": 3600 * 10**9, "hour": 3600 * 10**9, "hours": 3600 * 10**9,
    "d": 86400 * 10**9, "day": 86400 * 10**9, "days": 86400 * 10**9,
}

_SPARK = {
    "bool": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float16": T.FloatType(), "float32": T.FloatType(), "float64": T.DoubleType(), "string": T.StringType(),
}


class UnknownName(KeyError):
    """A variable, dimension or group that isn't there."""


class DimensionMismatch(ValueError):
    """One dimension with different lengths in arrays that share it."""


@dataclass(frozen=True)
class Encoding:
    """How stored numbers become values: time (kind datetime or duration) or scale and offset."""

    kind: str | None = None
    unit_ns: int = 1
    epoch_us: int = 0
    scale: float = 1.0
    offset: float = 0.0
    fill: float | None = None

    @classmethod
    def of(cls, attrs: dict, dtype: str, decode_timedelta: bool = True) -> Encoding:
        units, kind = attrs.get("units"), str(attrs.get("dtype", ""))
        if isinstance(units, str) and (m := re.fullmatch(r"\s*(\S+)\s+since\s+(.+?)\s*", units)) and m[1].lower() in UNITS:
            epoch = _epoch(m[2])
            if epoch is not None:
                return cls("datetime", UNITS[m[1].lower()], epoch)
        marked = re.fullmatch(r"timedelta64\[(\w+)\]", kind)
        # A bare unit is a duration only where the values are whole or marked as durations: floats may be metres.
        if decode_timedelta and isinstance(units, str) and units.strip().lower() in UNITS and units.strip() != "m" and (marked or "int" in dtype):
            return cls("duration", UNITS[units.strip().lower()])
        if marked and marked[1] in UNITS:
            return cls("duration", UNITS[marked[1]])
        if "scale_factor" in attrs or "add_offset" in attrs:
            fill = attrs.get("_FillValue")
            return cls("scale", scale=float(attrs.get("scale_factor", 1.0)), offset=float(attrs.get("add_offset", 0.0)), fill=None if fill is None else float(fill))
        return cls()

    def decode(self, raw: np.ndarray) -> np.ndarray:
        """Values; times are microseconds, rounded down, and times that aren't finite are NaT."""
        if self.kind in ("datetime", "duration"):
            to = "M8[us]" if self.kind == "datetime" else "m8[us]"
            if raw.dtype.kind == "f":
                ok = np.isfinite(raw)
                us = np.floor(np.where(ok, raw, 0).astype("f8") * (self.unit_ns / 1000)).clip(-(2.0**62), 2.0**62).astype("i8") + self.epoch_us
                out = us.view(to).copy() if us.ndim else us.view(to)
                out[~ok] = np.array("NaT", to)
                return out
            us = raw.astype("i8")
            us = us // 1000 if self.unit_ns == 1 else us * (self.unit_ns // 1000)
            return (us + self.epoch_us).view(to)
        if self.kind == "scale":
            out = raw.astype("f8") * self.scale + self.offset
            if self.fill is not None:
                out[raw == self.fill] = np.nan
            return out
        return raw


def _epoch(text: str) -> int | None:
    text = text.strip().removesuffix("Z").removesuffix(" UTC").strip()
    for form in ("%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d"):
        try:
            return (dt.datetime.strptime(text, form) - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
        except ValueError:
            continue
    return None


@dataclass(frozen=True)
class ArrayMeta:
    path: str
    shape: tuple[int, ...]
    chunk: tuple[int, ...]
    shard: tuple[int, ...] | None
    dims: tuple[str, ...]
    dtype: str
    fill: object
    codecs: tuple[dict, ...]
    shard_conf: dict | None
    separator: str
    attrs: dict
    encoding: Encoding = field(default_factory=Encoding)

    @property
    def name(self) -> str:
        return self.path.rsplit("/", 1)[-1]

    @property
    def spark_type(self) -> T.DataType:
        if self.encoding.kind == "datetime":
            return T.TimestampNTZType()
        if self.encoding.kind == "duration":
            return T.DayTimeIntervalType(0, 3)
        if self.encoding.kind == "scale":
            return T.DoubleType()
        return _SPARK.get(self.dtype, T.BinaryType())

    @property
    def signature(self) -> tuple:
        return self.dims, self.shape, self.chunk, self.shard

    @property
    def numpy_dtype(self) -> np.dtype:
        return np.dtype(DTYPES.get(self.dtype, "O"))

    def key(self, index: tuple[int, ...]) -> str:
        return "/".join([self.path, "c"]) + "".join(self.separator + str(i) for i in index) if index else f"{self.path}/c"


@dataclass
class Group:
    path: str
    arrays: dict[str, ArrayMeta]
    children: dict[str, Group]
    attrs: dict

    def walk(self):
        yield self
        for c in self.children.values():
            yield from c.walk()


def _parse_array(path: str, doc: dict, options: dict) -> ArrayMeta:
    grid = doc["chunk_grid"]
    if grid["name"] != "regular":
        raise ValueError(f"{path}: chunk grid {grid['name']} isn't known")
    outer = tuple(grid["configuration"]["chunk_shape"])
    codecs, shard_conf, shard, chunk = doc["codecs"], None, None, outer
    if codecs and codecs[0]["name"] == "sharding_indexed":
        shard_conf, shard = codecs[0]["configuration"], outer
        chunk = tuple(shard_conf["chunk_shape"])
        codecs = shard_conf["codecs"]
    attrs = doc.get("attributes", {})
    shape = tuple(doc["shape"])
    dims = attrs.get("_ARRAY_DIMENSIONS") or [d if d is not None else f"dim_{i}" for i, d in enumerate(doc.get("dimension_names") or [None] * len(shape))]
    kind = doc["data_type"] if isinstance(doc["data_type"], str) else doc["data_type"].get("name", "other")
    encoding = doc.get("chunk_key_encoding", {"name": "default"})
    separator = encoding.get("configuration", {}).get("separator", "/")
    return ArrayMeta(path, shape, chunk, shard, tuple(dims), kind, doc.get("fill_value"), tuple(codecs), shard_conf, separator, attrs, Encoding.of(attrs, kind, options.get("decode_timedelta", True)))


def _tree(path: str, get, children, options: dict) -> Group:
    doc = get(path)
    group = Group(path, {}, {}, doc.get("attributes", {}))
    for name in children(path):
        at = f"{path}/{name}" if path else name
        child = get(at)
        if child is None:
            continue
        if child["node_type"] == "array":
            group.arrays[name] = _parse_array(at, child, options)
        else:
            group.children[name] = _tree(at, get, children, options)
    return group


def load(url: str, **options) -> GridMeta:
    """The metadata of a store, from its consolidated metadata or by walking it."""
    store = open_store(url)
    raw = store.get("zarr.json")
    if raw is None:
        raise FileNotFoundError(f"{url} has no zarr.json")
    root = json.loads(raw)
    if root["node_type"] == "array":
        array = _parse_array("", root, options)
        return GridMeta(url, Group("", {"": array}, {}, {}))
    inline = (root.get("consolidated_metadata") or {}).get("metadata")
    if inline:
        docs = {"": root, **inline}

        def below(path: str) -> list[str]:
            head = f"{path}/" if path else ""
            return list(dict.fromkeys(k[len(head) :].split("/")[0] for k in docs if k and k.startswith(head)))

        return GridMeta(url, _tree("", docs.get, below, options))

    def get(path: str):
        data = store.get(f"{path}/zarr.json" if path else "zarr.json")
        return json.loads(data) if data else None

    return GridMeta(url, _tree("", get, lambda p: store.children(p), options))


class GridMeta:
    """A hierarchy with its dimensions, coordinates and variables sorted out."""

    def __init__(self, url: str, root: Group):
        self.url, self.root = url, root
        self.dims: dict[str, int] = {}
        self.coords: dict[str, ArrayMeta] = {}
        self._sizes(root)

    def _sizes(self, group: Group) -> None:
        for a in group.arrays.values():
            for d, n in zip(a.dims, a.shape):
                if self.dims.setdefault(d, n) != n:
                    raise DimensionMismatch(f"{d} has lengths {self.dims[d]} and {n} ({a.path})")
            if self.is_coord(a):
                self.coords.setdefault(a.name, a)
        for c in group.children.values():
            self._sizes(c)

    @staticmethod
    def is_coord(a: ArrayMeta) -> bool:
        return len(a.dims) == 1 and a.name == a.dims[0]

    def auxiliary(self, group: Group) -> set[str]:
        """Names that this group's arrays list as coordinates."""
        names: set[str] = set()
        for a in group.arrays.values():
            listed = a.attrs.get("coordinates")
            if isinstance(listed, str):
                names |= set(listed.split())
        return names & set(group.arrays)

    def variables(self, group: Group) -> dict[str, ArrayMeta]:
        aux = self.auxiliary(group)
        return {n: a for n, a in group.arrays.items() if not self.is_coord(a) and n not in aux}

    def columns(self) -> dict[str, ArrayMeta]:
        """Arrays by the path of their column: variables and auxiliary coordinates of the root, variables of groups."""
        out = dict(self.variables(self.root))
        out |= {n: self.root.arrays[n] for n in self.root.arrays if n in self.auxiliary(self.root) and n not in self.dims}
        for g in self.root.walk():
            if g is not self.root:
                out |= {f"{g.path}/{n}": a for n, a in self.variables(g).items()}
        return out

    def dim_type(self, dim: str) -> T.DataType:
        return self.coords[dim].spark_type if dim in self.coords else T.LongType()

    def schema(self, variables: list[str] | None = None) -> T.StructType:
        """Dimensions, root variables, auxiliary coordinates, then one struct for each group."""
        fields = [T.StructField(d, self.dim_type(d)) for d in self.dims]
        names = self.columns()
        wanted = list(names) if variables is None else self.expand(variables)
        fields += [T.StructField(n, names[n].spark_type) for n in names if "/" not in n and n in wanted]

        def struct(group: Group) -> T.StructType:
            own = [T.StructField(n, a.spark_type) for n, a in self.variables(group).items() if f"{group.path}/{n}" in wanted]
            own += [T.StructField(n, s) for n, c in group.children.items() if (s := struct(c)).fields]
            return T.StructType(own)

        fields += [T.StructField(n, s) for n, c in self.root.children.items() if (s := struct(c)).fields]
        return T.StructType(fields)

    def expand(self, names: list[str]) -> list[str]:
        """Column paths of names: a group stands for all below it; a dot goes into a group."""
        known, out = self.columns(), []
        for n in names:
            n = n.replace(".", "/") if n not in known else n
            if n in self.dims:
                continue
            below = [k for k in known if k == n or k.startswith(f"{n}/")]
            if not below:
                raise UnknownName(n)
            out += below
        return list(dict.fromkeys(out))

    def store(self) -> Store:
        return open_store(self.url)
