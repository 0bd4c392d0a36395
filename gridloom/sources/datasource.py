"""The ``grid`` data source: one leaf of a store as a table.

Options: path; vars (column paths, comma-separated); where (a predicate as text);
maxChunks, maxChunkElements, batchRows, partitionRows, assumeSorted ("all", "none"
or dimensions), codec.alias.<name>, coordCacheEntries and chunkCacheEntries (what a
worker keeps, 0 for all; chunks only if given), within (boxes, see plans.region), index ("true": adds ``__i_<dim>`` columns).
A schema given by the caller restricts what is read.  Filters that Spark pushes
down prune chunks too; all are applied again by Spark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not

from ..plans.chunks import pack
from ..plans.predicate import Predicate
from ..plans.region import Box
from .meta import ArrayMeta, GridMeta, load

INDEX = "__i_"


def settings(options) -> dict:
    low = {k.lower(): v for k, v in dict(options).items()}
    rising = low.get("assumesorted", "none")
    return {
        "aliases": {k.removeprefix("codec.alias."): v for k, v in low.items() if k.startswith("codec.alias.")},
        "max_chunks": int(low["maxchunks"]) if "maxchunks" in low else None,
        "limit": int(low.get("maxchunkelements", 50_000_000)),
        "batch": int(low.get("batchrows", 50_000)),
        "part": int(low.get("partitionrows", 2_000_000)),
        "rising": rising if rising in ("all", "none") else tuple(x.strip() for x in rising.split(",")),
        "coord_entries": int(low.get("coordcacheentries", 256)),
        "chunk_entries": int(low["chunkcacheentries"]) if "chunkcacheentries" in low else None,
        "within": json.loads(low["within"]) if "within" in low else None,
        "index": low.get("index", "false") == "true",
        "decode_timedelta": low.get("decodetimedelta", "true") == "true",
    }


@dataclass
class Chunks(InputPartition):
    chunks: list[tuple[tuple[int, ...], Box]]


class GridDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "grid"

    def _meta(self) -> GridMeta:
        return load(self.options["path"], decode_timedelta=settings(self.options)["decode_timedelta"])

    def _names(self, meta: GridMeta) -> list[str]:
        if "vars" in self.options:
            return meta.expand([v for v in self.options["vars"].split(",") if v])
        return list(meta.columns())

    def schema(self) -> T.StructType:
        meta = self._meta()
        return leaf_schema(meta, self._names(meta), settings(self.options)["index"])

    def reader(self, schema: T.StructType) -> GridReader:
        return GridReader(dict(self.options), schema)


def leaf_schema(meta: GridMeta, names: list[str], index: bool) -> T.StructType:
    known = meta.columns()
    dims = list(dict.fromkeys(d for n in names for d in known[n].dims)) or list(meta.dims)
    fields = [T.StructField(d, meta.dim_type(d)) for d in dims]
    fields += [T.StructField(INDEX + d, T.LongType()) for d in dims if index]
    return T.StructType(fields + [T.StructField(n, known[n].spark_type) for n in names])


def _tree(f: Filter) -> list | None:
    ops = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
    if isinstance(f, Not):
        inner = _tree(f.child)
        return ["not", inner] if inner else None
    if isinstance(f, (IsNull, IsNotNull)):
        return ["is", "null" if isinstance(f, IsNull) else "not_null", ".".join(f.attribute)]
    if isinstance(f, In):
        return ["in", ".".join(f.attribute), list(f.value)]
    return ["cmp", ops[type(f)], ".".join(f.attribute), f.value] if type(f) in ops else None


class GridReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        from ..plans.scan import leaves_of

        self.options, self.columns, self.set = options, schema, settings(options)
        self.meta = load(options["path"], decode_timedelta=self.set["decode_timedelta"])
        known = self.meta.columns()
        self.names = [f.name for f in schema.fields if f.name in known]
        named = {f.name for f in schema.fields} | {f.name.removeprefix(INDEX) for f in schema.fields}
        leaves = [x for x in leaves_of(self.meta, self.names) if self.names or named & set(x[0].dims)]
        if "dims" in options:
            dims = tuple(options["dims"].split(",")) if options["dims"] else ()
            leaves = [x for x in leaves if x[0].dims == dims]
        if len(leaves) != 1:
            raise ValueError("these columns lie on different chunk grids: choose some by vars, or use gridloom.scan")
        self.grid, self.arrays = leaves[0]
        self.where = Predicate.loads(options["where"]) if options.get("where") else None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            tree = _tree(f)
            if tree:
                self.where = Predicate(tree) if self.where is None else self.where & Predicate(tree)
            yield f

    def partitions(self) -> list[Chunks]:
        from ..plans.chunks import TooManyChunks
        from ..plans.region import Region
        from ..plans.scan import axes_of

        axes = axes_of(self.meta, self.where.refs if self.where is not None else set(), self.set["rising"], self.set["aliases"])
        region = self.where.regions(axes)[0] if self.where is not None else Region.full(axes.space)
        if self.set["within"] is not None:
            region = region.intersect(Region.loads(axes.space, self.set["within"]))
        chunks = self.grid.select(region.project(self.grid.dims)) if self.grid.dims else ({} if region.is_empty else {(): ()})
        if self.set["max_chunks"] is not None and len(chunks) > self.set["max_chunks"]:
            raise TooManyChunks(f"{len(chunks)} chunks would be read, {self.set['max_chunks']} are allowed")
        return [Chunks(c) for c in pack(list(chunks.items()), self.grid, self.set["part"])] or [Chunks([])]

    def read(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.columns)
        for _, box in partition.chunks:
            yield from read_rows(self.meta, self.grid.dims, self.arrays, box, schema, self.set)


def arrow(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    if values.dtype == object:
        return pa.array(values.tolist(), kind)
    if values.dtype == np.float16:
        values = values.astype("f4")
    if pa.types.is_decimal(kind):
        return pa.array([int(v) for v in values.tolist()], kind)
    out = pa.array(np.ascontiguousarray(values))
    return out if out.type == kind else out.cast(kind)


def read_rows(meta: GridMeta, dims: tuple[str, ...], arrays: dict[str, ArrayMeta], box: Box, schema: pa.Schema, options: dict) -> Iterator[pa.RecordBatch]:
    """The cells of a box in row-major order, in batches."""
    from .reader import coordinate, read_box

    shape = tuple(hi - lo for lo, hi in box)
    cols = []
    for f in schema:
        if f.name in arrays:
            cols.append(read_box(meta.url, arrays[f.name], box, options["aliases"], options["limit"], options["chunk_entries"]).reshape(-1))
            continue
        dim = f.name.removeprefix(INDEX)
        at = dims.index(dim)
        lo, hi = box[at]
        own = coordinate(meta.url, meta.coords[dim], options["aliases"], options["coord_entries"])[lo:hi] if dim in meta.coords and f.name == dim else np.arange(lo, hi)
        cols.append(np.broadcast_to(own.reshape([-1 if i == at else 1 for i in range(len(dims))]), shape).reshape(-1))
    n = int(np.prod(shape, dtype=np.int64))
    for start in range(0, n, options["batch"]):
        part = [arrow(c[start : start + options["batch"]], f.type) for c, f in zip(cols, schema)]
        yield pa.RecordBatch.from_arrays(part, schema=schema) if cols else pa.RecordBatch.from_arrays([], names=[])
