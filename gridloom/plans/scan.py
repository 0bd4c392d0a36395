"""Planning a scan: which leaves, which chunks of each."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..sources.meta import ArrayMeta, GridMeta
from ..sources.reader import coordinate
from .chunks import ChunkGrid, TooManyChunks
from .predicate import Axes, Predicate
from .region import Box, Region, Space


@dataclass
class Leaf:
    """Arrays read together: one chunk grid, one scan."""

    grid: ChunkGrid
    arrays: dict[str, ArrayMeta]
    chunks: dict[tuple[int, ...], Box]

    @property
    def cells(self) -> int:
        return sum(int(np.prod([hi - lo for lo, hi in b], dtype=np.int64)) for b in self.chunks.values())


def axes_of(meta: GridMeta, refs: set[str], rising: str | tuple[str, ...] = (), aliases: dict[str, str] | None = None) -> Axes:
    """The whole space; coordinates are only read for dimensions that a predicate names."""
    space = Space(tuple(meta.dims), tuple(meta.dims.values()))
    values = {d: coordinate(meta.url, meta.coords[d], aliases) if d in meta.coords and d in refs else None for d in meta.dims}
    known = frozenset(meta.dims if rising == "all" else () if rising == "none" else rising)
    return Axes(space, values, known)


def leaves_of(meta: GridMeta, names: list[str]) -> list[tuple[ChunkGrid, dict[str, ArrayMeta]]]:
    """Columns by chunk grid; without columns, the grids that no other one covers."""
    known, found = meta.columns(), {}
    for n in names:
        a = known[n]
        found.setdefault(a.signature, {})[n] = a
    if not names:
        for a in sorted(known.values(), key=lambda a: -len(a.dims)):
            if not any(set(a.dims) <= set(dims) for dims, *_ in found):
                found[a.signature] = {}
        for d, n in meta.dims.items():
            if not any(d in dims for dims, *_ in found):
                chunk = meta.coords[d].chunk if d in meta.coords else (n or 1,)
                found[((d,), (n,), chunk, None)] = {}
    return [(ChunkGrid(dims, shape, tuple(max(1, c) for c in chunk), shard), arrays) for (dims, shape, chunk, shard), arrays in found.items()]


def plan(meta: GridMeta, names: list[str], where: Predicate | None, max_chunks: int | None = None, rising=(), aliases=None, within: dict | None = None) -> list[Leaf]:
    """The leaves with the chunks where the predicate may hold, inside the saved region ``within``."""
    axes = axes_of(meta, where.refs if where is not None else set(), rising, aliases)
    region = where.regions(axes)[0] if where is not None else Region.full(axes.space)
    if within is not None:
        region = region.intersect(Region.loads(axes.space, within))
    out = [Leaf(grid, arrays, grid.select(region.project(grid.dims)) if grid.dims else ({} if region.is_empty else {(): ()})) for grid, arrays in leaves_of(meta, names)]
    total = sum(len(leaf.chunks) for leaf in out)
    if max_chunks is not None and total > max_chunks:
        raise TooManyChunks(f"{total} chunks would be read, {max_chunks} are allowed")
    return out
