"""Ordinary tables as virtual grids: chunk plans over key columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.chunks import ChunkGrid
from ..plans.predicate import Axes, Predicate
from ..plans.region import Region, Space


@dataclass(frozen=True)
class Axis:
    """A whole-number key column: its first value, how many values follow, and values in a chunk."""

    origin: int
    size: int
    chunk: int


class TableGrid:
    def __init__(self, df: DataFrame, axes: dict[str, Axis]):
        self.df, self.axes = df, axes

    @classmethod
    def measured(cls, df: DataFrame, chunks: dict[str, int]) -> TableGrid:
        """Axes from the smallest and largest keys (one pass that reads the key columns alone)."""
        ends = df.agg(*[f(c).alias(f"{c}_{n}") for c in chunks for n, f in (("lo", F.min), ("hi", F.max))]).first()
        return cls(df, {c: Axis(ends[f"{c}_lo"], ends[f"{c}_hi"] - ends[f"{c}_lo"] + 1, n) for c, n in chunks.items()})

    def region(self, where: Predicate) -> Region:
        """Cells where the predicate may be true."""
        space = Space(tuple(self.axes), tuple(a.size for a in self.axes.values()))
        return where.regions(Axes(space, {d: range(a.origin, a.origin + a.size) for d, a in self.axes.items()}))[0]

    def plan(self, where: Predicate) -> dict[tuple[int, ...], tuple]:
        """Chunks that hold such cells."""
        region = self.region(where)
        return ChunkGrid(region.space.dims, region.space.sizes, tuple(a.chunk for a in self.axes.values())).select(region)

    def explain(self, where: Predicate) -> DataFrame:
        """One row for each planned chunk: ``<dim>_chunk`` columns."""
        rows = [list(index) for index in self.plan(where)]
        return self.df.sparkSession.createDataFrame(rows, ", ".join(f"{d}_chunk long" for d in self.axes))

    def scan(self, where: Predicate, columns: list[str] | None = None) -> DataFrame:
        """The rows where the predicate holds; the planned bounds of each key are filters that reach the files.

        Bounds are planned over all whole numbers, so keys beyond an axis are found, and tests for null are not planned.
        """
        keys = range(-(1 << 62), (1 << 62) - 1)
        space = Space(tuple(self.axes), tuple(len(keys) for _ in self.axes))
        boxes = Predicate(_null_tests_unplanned(where.tree)).regions(Axes(space, {d: keys for d in self.axes}))[0].boxes
        df = self.df
        for i, d in enumerate(self.axes):
            if not boxes:
                return df.where(F.lit(False)).select(*(columns or df.columns))
            lo, hi = min(b[i][0] for b in boxes), max(b[i][1] for b in boxes)
            if lo > 0:
                df = df.where(F.col(d) >= keys[lo])
            if hi < len(keys):
                df = df.where(F.col(d) < keys[hi])
        return df.where(where.column).select(*(columns or df.columns))


def _null_tests_unplanned(tree: list) -> list:
    """The predicate with its tests for null as SQL, which may hold anywhere."""
    if tree[0] == "is" and tree[1] in ("null", "not_null"):
        name = ".".join(f"`{x}`" for x in tree[2].split("."))
        return ["sql", f"{name} IS {'' if tree[1] == 'null' else 'NOT '}NULL", [tree[2]]]
    return [_null_tests_unplanned(x) if isinstance(x, list) and tree[0] not in ("in", "sql") else x for x in tree]
