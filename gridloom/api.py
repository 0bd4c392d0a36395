"""Scans of array stores."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators.combine import Part, combine, struct_wrap
from .operators.interp import interpolate_nd, touched
from .plans import predicate as P
from .plans.scan import plan
from .sources.datasource import INDEX, GridDataSource, leaf_schema, settings
from .sources.meta import UnknownName, load
from .sources.versions import resolve


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GridDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def _where(spark: SparkSession, where) -> P.Predicate | None:
    return P.from_sql(spark, where) if isinstance(where, str) else where


def grid_schema(path: str, variables: Iterable[str] | None = None) -> T.StructType:
    return load(path).schema(None if variables is None else list(variables))


def scan(spark: SparkSession, path: str, columns: Iterable[str] | None = None, where: P.Predicate | str | None = None, max_chunks: int | None = None, **options) -> DataFrame:
    """A store as a tidy table: one row for each element, a column for each dimension and variable.

    ``columns`` (dimensions, variables, groups, ``group.variable``) and ``where`` decide
    what is read; rows are filtered by ``where`` exactly.  Variables on other grids are
    joined on the indices of shared dimensions.  ``version`` names a branch or snapshot
    of a versioned store.
    """
    register(spark)
    if "version" in options:
        path = resolve(path, options.pop("version"))
    where = _where(spark, where)
    config = settings(options)
    meta = load(path, decode_timedelta=config["decode_timedelta"])
    asked = None if columns is None else list(columns)
    names = list(meta.columns()) if asked is None else meta.expand(asked)
    refs = where.refs if where is not None else set()
    read = list(dict.fromkeys([*names, *meta.expand(sorted(refs))]))
    leaves = plan(meta, read, where, max_chunks, config["rising"], config["aliases"], config["within"])
    several = len(leaves) > 1
    parts = []
    for leaf in leaves:
        schema = leaf_schema(meta, list(leaf.arrays), False) if leaf.arrays else T.StructType([T.StructField(d, meta.dim_type(d)) for d in leaf.grid.dims])
        dims = list(leaf.grid.dims)
        fields = [f for f in schema.fields if f.name in dims or f.name in leaf.arrays]
        if several:
            fields += [T.StructField(INDEX + d, T.LongType()) for d in dims]
        reader = spark.read.format("grid").options(**{k: str(v) for k, v in options.items()}).option("path", path).option("dims", ",".join(dims)).schema(T.StructType(fields))
        df = (reader.option("where", where.dumps()) if where is not None else reader).load()
        parts.append(Part(df, leaf.grid.dims, leaf.cells))
    df = combine(parts).drop(*[INDEX + d for d in meta.dims])
    df = struct_wrap(df, read)
    if where is not None:
        df = df.where(where.column)
    full = meta.schema(read)
    known = {f.name: f.dataType for f in full.fields}
    if asked is None:
        wanted = [f.name for f in meta.schema().fields if f.name in df.columns or f.name in meta.dims]
    else:
        wanted = asked
    out = []
    for n in wanted:
        top = n.replace("/", ".").split(".")[0]
        if n in df.columns:
            out.append(F.col(f"`{n}`"))
        elif n in meta.dims:
            out.append(F.lit(None).cast(known[n]).alias(n))
        elif top in df.columns and top != n:
            out.append(F.col(".".join(f"`{x}`" for x in n.replace("/", ".").split("."))).alias(n.replace("/", ".")))
        else:
            raise UnknownName(n)
    return df.select(*out)


def explain_chunks(spark: SparkSession, path: str, where: P.Predicate | str | None = None, columns: Iterable[str] | None = None, **options) -> DataFrame:
    """The chunks that a scan would read, one row each."""
    config = settings(options)
    meta = load(path)
    where = _where(spark, where)
    names = list(meta.columns()) if columns is None else meta.expand(list(columns))
    names = list(dict.fromkeys([*names, *meta.expand(sorted(where.refs if where is not None else set()))]))
    rows = []
    for leaf in plan(meta, names, where, config["max_chunks"], config["rising"], config["aliases"], config["within"]):
        for index, box in leaf.chunks.items():
            whole = leaf.grid.chunk_box(index)
            rows.append((list(leaf.grid.dims), sorted(leaf.arrays), list(index), [lo for lo, _ in whole], list(leaf.grid.chunk), [hi - lo for lo, hi in box], list(leaf.grid.shard_of(index)) if leaf.grid.shard else None, leaf.grid.total))
    return spark.createDataFrame(rows, "dims array<string>, variables array<string>, indices array<long>, origin array<long>, shape array<long>, touched array<long>, shard array<long>, total long")


def interpolate(spark: SparkSession, path: str, coords: list[str], values: list[str], targets: DataFrame, group_dims: Iterable[str] = (), where: P.Predicate | str | None = None, period: dict[str, float] | None = None, **options) -> DataFrame:
    """Values of a store interpolated at targets: only chunks that hold a corner of some target are read."""
    if "version" in options:
        path = resolve(path, options.pop("version"))
    others = [c for c in targets.columns if c in load(path).dims and c not in coords]
    columns = list(dict.fromkeys([*coords, *others, *group_dims, *values]))
    if where is not None:
        # A predicate may leave values of an axis out: brackets are then between those that are left, and it alone plans the chunks.
        return interpolate_nd(scan(spark, path, columns, where, **options), coords, values, targets, list(group_dims), period=period)
    within, axes = touched(path, coords, values, targets, period)
    source = scan(spark, path, columns, within=json.dumps(within), **options)
    return interpolate_nd(source, coords, values, targets, list(group_dims), period=period, axes=axes)


def explain_interpolation(spark: SparkSession, path: str, coords: list[str], values: list[str], targets: DataFrame, period: dict[str, float] | None = None, **options) -> DataFrame:
    """The chunks that ``interpolate`` would read, as in explain_chunks."""
    if "version" in options:
        path = resolve(path, options.pop("version"))
    within, _ = touched(path, coords, values, targets, period)
    return explain_chunks(spark, path, None, values, within=json.dumps(within), **options)


def iter_arrow(df: DataFrame, batch_size: int = 50_000) -> Iterator:
    """The rows as Arrow batches of up to ``batch_size`` rows, one partition of the result on the driver at a time."""
    import pyarrow as pa

    schema = df.limit(0).toArrow().schema

    def packed(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as out:
                    out.write_batch(batch.slice(start, batch_size))
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["ipc"])

    for row in df.mapInArrow(packed, "ipc binary").toLocalIterator(prefetchPartitions=True):
        for batch in pa.ipc.open_stream(row.ipc):
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, schema)], schema=schema)


def iter_batches(df: DataFrame, batch_size: int = 50_000, n_rows: int | None = None) -> Iterator:
    """The rows as pandas frames of up to ``batch_size`` rows, from Arrow batches."""
    for batch in iter_arrow(df if n_rows is None else df.limit(n_rows), batch_size):
        yield batch.to_pandas()


async def collect_async(df: DataFrame):
    """The rows as a pandas frame, without blocking the event loop: the job runs in a thread."""
    import asyncio

    return await asyncio.to_thread(df.toPandas)


def explain_json(path: str) -> str:
    """A summary of a store's metadata."""
    meta = load(path)
    return json.dumps({"dims": meta.dims, "columns": {n: {"dims": a.dims, "shape": a.shape, "chunk": a.chunk, "shard": a.shard, "dtype": a.dtype} for n, a in meta.columns().items()}})
