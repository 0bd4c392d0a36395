"""Multilinear interpolation on grids.

Every target is bracketed on each axis; the corners of its cell with a positive
weight are joined to the grid by their indices on the axes and summed.  Targets
outside an axis are clamped to its ends; on a periodic axis they wrap around.  A
value is NaN if one of its corners is NaN, null or not in the source.  Dimensions of
the source that the targets lack are kept: one result for each of their values.
Target columns that are dimensions of the source but no interpolated axis select
exactly; all other target columns are carried along.

Over a store, axes come from its metadata and coordinates, and only chunks that hold
a corner of some target are read: what reaches the driver are distinct chunk indices.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Values of an axis that are brought to the driver at most (axes are metadata of a grid).
MAX_AXIS = 1_000_000


def axis_values(source: DataFrame, name: str) -> np.ndarray:
    rows = source.select(name).where(F.col(name).isNotNull()).distinct().limit(MAX_AXIS + 1).toPandas()[name]
    if len(rows) > MAX_AXIS:
        raise ValueError(f"{name} has more than {MAX_AXIS} values")
    return np.sort(rows.to_numpy())


def _numbers(x) -> np.ndarray:
    """Coordinates as doubles: times as microseconds."""
    x = np.asarray(x)
    return x.astype("M8[us]").astype("i8").astype("f8") if x.dtype.kind == "M" else x.astype("m8[us]").astype("i8").astype("f8") if x.dtype.kind == "m" else x.astype("f8")


def brackets(axis: np.ndarray, at: np.ndarray, period: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices below and above each place, and the weight of the one above."""
    n = len(axis)
    if period is not None and n > 1:
        at = (at - axis[0]) % period + axis[0]
        long = np.append(axis, axis[0] + period)
    else:
        long = axis
        at = np.clip(at, axis[0], axis[-1])
    lo = np.clip(np.searchsorted(long, at, "right") - 1, 0, max(len(long) - 2, 0))
    hi = np.minimum(lo + 1, len(long) - 1)
    width = long[hi] - long[lo]
    with np.errstate(invalid="ignore", divide="ignore"):
        w = np.where(width > 0, (at - long[lo]) / np.where(width > 0, width, 1), 0.0)
    return lo, hi % n if period is not None else hi, w


def _placed(axes: list[tuple[np.ndarray, float | None]], places: DataFrame, names: list[str]) -> DataFrame:
    """``places`` with ``__k``, the axes' indices of each corner one after the other, and ``__w``, the corners' weights."""
    numbers = [(_numbers(axis), period) for axis, period in axes]
    d = len(axes)
    ends = np.array(list(np.ndindex(*[2] * d)), np.int64).reshape(-1, d)
    kind = T.StructType([T.StructField("k", T.ArrayType(T.LongType())), T.StructField("w", T.ArrayType(T.DoubleType()))])

    @F.pandas_udf(kind)
    def corners(at: pd.DataFrame) -> pd.DataFrame:
        found = [brackets(n, _numbers(at[c].to_numpy()), period) for (n, period), c in zip(numbers, at.columns)]
        # (targets, axes, ends), then (targets, corners, axes).
        index = np.stack([np.stack([lo, hi], -1) for lo, hi, _ in found], 1)[:, np.arange(d), ends]
        share = np.stack([np.stack([1 - w, w], -1) for _, _, w in found], 1)[:, np.arange(d), ends].prod(-1)
        return pd.DataFrame({"k": list(index.reshape(len(at), -1)), "w": list(share)})

    return places.withColumn("__c", corners(F.struct(*names))).select("*", F.col("__c.k").alias("__k"), F.col("__c.w").alias("__w")).drop("__c")


def _corner_rows(placed: DataFrame, d: int, columns: list) -> DataFrame:
    """One row for each corner that counts: the columns, ``__i_<axis>`` indices ``__k0``..., its weight and their number.

    A place that isn't a number has corners of weight NaN, so that its result is NaN.
    """
    counts = F.transform(F.filter(F.transform("__w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda c: (c["w"] > 0) | F.isnan(c["w"])), lambda c: c)
    rows = placed.withColumn("__all", counts).select(*columns, "__k", F.size("__all").alias("__n"), F.explode("__all").alias("__c"))
    return rows.select(*[c for c in rows.columns if c not in ("__k", "__c")], F.col("__c.w").alias("__weight"), *[F.get("__k", F.col("__c.i") * d + j).alias(f"__k{j}") for j in range(d)])


def _indexed(source: DataFrame, axes: list[np.ndarray], names: list[str]) -> DataFrame:
    """``source`` with its indices on the axes, ``__s0``..."""
    numbers = [_numbers(a) for a in axes]

    def of(j: int):
        @F.pandas_udf("long")
        def index(x: pd.Series) -> pd.Series:
            at = _numbers(x.to_numpy())
            place = np.clip(np.searchsorted(numbers[j], at), 0, len(numbers[j]) - 1)
            return pd.Series(np.where(numbers[j][place] == at, place, -1))

        return index

    return source.select("*", *[of(j)(F.col(c)).alias(f"__s{j}") for j, c in enumerate(names)])


def interpolate_nd(source: DataFrame, coords: list[str], values: list[str], targets: DataFrame, group_dims: list[str] = (), where=None, period: dict[str, float] | None = None, axes: dict[str, np.ndarray] | None = None) -> DataFrame:
    """One struct column ``interpolated`` for each target (and each value of ``group_dims``).

    ``axes`` gives the rising values of the coordinates where they are known; the others are gathered from the source.
    """
    if where is not None:
        source = source.where(getattr(where, "column", where))
    exact = [c for c in targets.columns if c in source.columns and c not in coords and c not in values]
    groups = [c for c in group_dims if c not in targets.columns]
    known = [(axes or {}).get(c) for c in coords]
    known = [axis_values(source, c) if axis is None else axis for c, axis in zip(coords, known)]
    for c, axis in zip(coords, known):
        if not len(axis):
            raise ValueError(f"{c} has no values")
    d = len(coords)
    marked = targets.withColumn("__target", F.monotonically_increasing_id())
    placed = _placed([(axis, (period or {}).get(c)) for c, axis in zip(coords, known)], marked, list(coords))
    keep = [c for c in targets.columns if c not in exact]
    cut = _corner_rows(placed, d, ["__target", *[F.col(c).alias(f"__t_{c}") for c in keep], *[F.col(c).alias(f"__e_{c}") for c in exact]])
    right = _indexed(source.select(*[F.col(c) for c in dict.fromkeys([*coords, *exact, *groups, *values])]), known, list(coords)).drop(*[c for c in coords if c not in groups])
    on = reduce(lambda a, b: a & b, [F.col(f"__k{j}") == F.col(f"__s{j}") for j in range(d)] + [F.col(f"__e_{c}") == right[c] for c in exact])
    met = cut.join(right, on, "inner" if groups else "left")
    nan = F.lit(float("nan"))
    sums = [F.when(F.count(F.col(v)) == F.first("__n"), F.sum(F.col("__weight") * F.col(v).cast("double"))).otherwise(nan).alias(v) for v in values]
    kept = [F.first(f"__t_{c}").alias(c) for c in keep] + [F.first(f"__e_{c}").alias(c) for c in exact]
    out = met.groupBy("__target", *groups).agg(*kept, *sums)
    return out.select(F.struct(*targets.columns, *groups, *values).alias("interpolated"))


def interpolate_geospatial(source: DataFrame, lat: str, lon: str, values: list[str], targets: DataFrame, group_dims: list[str] = (), where=None) -> DataFrame:
    """As interpolate_nd over latitude and longitude; longitudes wrap around at 360 degrees from the grid's first one."""
    return interpolate_nd(source, [lat, lon], values, targets, group_dims, where, {lon: 360.0})


#: Distinct chunks that targets may touch (chunks are metadata of a store).
MAX_CHUNKS = 1_000_000


def touched(path: str, coords: list[str], values: list[str], targets: DataFrame, period: dict[str, float] | None = None) -> tuple[dict, dict[str, np.ndarray]]:
    """The saved region of a store that holds the corners of the targets, by whole chunks, and the coordinates' axes.

    Target columns named as other dimensions of the store narrow the region to their values.
    """
    from ..plans.region import Region, Space
    from ..sources.meta import load
    from ..sources.reader import coordinate

    meta = load(path)
    arrays = [meta.columns()[n] for n in meta.expand(list(values))]
    exact = [d for d in targets.columns if d in meta.dims and d not in coords]
    dims = [*coords, *exact]
    raw = {d: coordinate(path, meta.coords[d]) if d in meta.coords else np.arange(meta.dims[d]) for d in dims}
    order = {d: np.argsort(raw[d], kind="stable") for d in dims}
    axes = {d: raw[d][order[d]] for d in dims}
    step = {d: min([a.chunk[a.dims.index(d)] for a in arrays if d in a.dims], default=meta.dims[d]) for d in dims}
    placed = _placed([(axes[d], (period or {}).get(d)) for d in coords], targets, list(coords))
    rows = _corner_rows(placed, len(coords), [*exact])
    if exact:
        rows = _indexed(rows, [axes[d] for d in exact], exact)
    ranks = [F.col(f"__k{j}") for j in range(len(coords))] + [F.col(f"__s{j}") for j in range(len(exact))]

    def chunk(d: str, rank) -> object:
        # Places in a rising axis are places in the store, or are looked up there.
        if np.array_equal(order[d], np.arange(len(order[d]))):
            return F.floor(rank / step[d])
        place = F.lit(len(order[d]) - 1) - rank if np.array_equal(order[d], np.arange(len(order[d]))[::-1]) else F.get(F.array(*[F.lit(int(x)) for x in order[d]]), rank)
        return F.floor(place / step[d])

    found = rows.where(reduce(lambda a, b: a & b, [r >= 0 for r in ranks])).select(*[chunk(d, r).alias(f"c{j}") for j, (d, r) in enumerate(zip(dims, ranks))]).distinct().limit(MAX_CHUNKS + 1).collect()
    if len(found) > MAX_CHUNKS:
        raise ValueError(f"the targets touch more than {MAX_CHUNKS} chunks")
    space = Space(tuple(dims), tuple(meta.dims[d] for d in dims))
    boxes = [tuple((int(c) * step[d], min((int(c) + 1) * step[d], meta.dims[d])) for d, c in zip(dims, r)) for r in sorted(found)]
    return Region(space, tuple(boxes)).coarsened().dumps(), {d: axes[d] for d in coords}
