"""From regions to chunks: which chunks of a leaf are read, and which part of each."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from .region import Box, Region


class TooManyChunks(ValueError):
    """More chunks than the caller allows would be read."""


class InvalidShard(ValueError):
    """A shard's shape isn't a multiple of its chunks'."""


@dataclass(frozen=True)
class ChunkGrid:
    """Arrays of one leaf: the same dimensions and the same chunk and shard shapes."""

    dims: tuple[str, ...]
    shape: tuple[int, ...]
    chunk: tuple[int, ...]
    shard: tuple[int, ...] | None = None

    def __post_init__(self):
        if not len(self.dims) == len(self.shape) == len(self.chunk) or any(c <= 0 for c in self.chunk):
            raise ValueError(f"not a chunk grid: {self}")
        if self.shard and (len(self.shard) != len(self.chunk) or any(s % c for s, c in zip(self.shard, self.chunk))):
            raise InvalidShard(f"a shard holds whole chunks only: {self}")

    def chunk_box(self, index: tuple[int, ...]) -> Box:
        return tuple((i * c, min((i + 1) * c, n)) for i, c, n in zip(index, self.chunk, self.shape))

    @property
    def total(self) -> int:
        out = 1
        for n, c in zip(self.shape, self.chunk):
            out *= -(-n // c)
        return out

    def select(self, region: Region) -> dict[tuple[int, ...], Box]:
        """Each chunk that the region touches, with the box around the touched cells."""
        found: dict[tuple[int, ...], Box] = {}
        for box in region.boxes:
            spans = [range(lo // c, (hi - 1) // c + 1) for (lo, hi), c in zip(box, self.chunk)]
            for index in product(*spans):
                part = tuple((max(lo, a), min(hi, b)) for (lo, hi), (a, b) in zip(box, self.chunk_box(index)))
                old = found.get(index)
                found[index] = part if old is None else tuple((min(x[0], y[0]), max(x[1], y[1])) for x, y in zip(old, part))
        return dict(sorted(found.items()))

    def shard_of(self, index: tuple[int, ...]) -> tuple[int, ...]:
        if not self.shard:
            return index
        return tuple(i * c // s for i, c, s in zip(index, self.chunk, self.shard))


def pack(chunks: list[tuple[tuple[int, ...], Box]], grid: ChunkGrid, rows: int) -> list[list[tuple[tuple[int, ...], Box]]]:
    """Chunks in parts of about ``rows`` cells; chunks of one shard stay together."""
    out: list[list] = []
    held, last = 0, None
    for index, box in sorted(chunks, key=lambda c: (grid.shard_of(c[0]), c[0])):
        n = 1
        for lo, hi in box:
            n *= hi - lo
        shard = grid.shard_of(index)
        if not out or (held + n > rows and (shard != last or not grid.shard)):
            out.append([])
            held = 0
        out[-1].append((index, box))
        held += n
        last = shard
    return out
