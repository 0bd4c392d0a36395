"""Putting leaves of different dimensions together again."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Leaves of up to so many bytes are broadcast to the leaf whose dimensions cover theirs; text counts as TEXT_BYTES.
BROADCAST_BYTES, TEXT_BYTES = 64 << 20, 256


@dataclass
class Part:
    """A leaf's rows; ``keys`` are the columns that tell its cells apart, one for each dimension."""

    df: DataFrame
    dims: tuple[str, ...]
    cells: int
    key: str = "__i_"

    def keys(self, dims) -> list[str]:
        return [self.key + d for d in dims]


def row_bytes(df: DataFrame) -> int:
    """About the bytes of a row of a leaf."""
    return 16 + sum(TEXT_BYTES if isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)) else 8 for f in df.schema.fields)


def grid_join(left: Part, right: Part) -> Part:
    """Full outer join on shared dimensions with coalesced keys and coordinates.

    Where the left side covers the right one's dimensions each cell there has a
    partner, so a left join gives the same and a small right side is broadcast.
    """
    shared = [d for d in left.dims if d in right.dims]
    keys = left.keys(shared)
    covered = set(right.dims) <= set(left.dims)
    other = right.df.withColumnsRenamed({d: f"__r_{d}" for d in shared if d not in keys})
    if covered:
        out = left.df.join(F.broadcast(other) if right.cells * row_bytes(other) <= BROADCAST_BYTES else other, on=keys, how="left")
        out = out.drop(*[f"__r_{d}" for d in shared])
    else:
        out = left.df.join(other, on=keys, how="full")
        out = out.withColumns({d: F.coalesce(F.col(f"`{d}`"), F.col(f"`__r_{d}`")) for d in shared if d not in keys}).drop(*[f"__r_{d}" for d in shared])
    return Part(out, tuple(dict.fromkeys([*left.dims, *right.dims])), max(left.cells, right.cells), left.key)


def diagonal_concat(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames by column name; what a frame lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def join_groups(parts: list[Part]) -> list[list[Part]]:
    """Leaves that share dimensions, directly or through others, together; the largest first."""
    groups: list[list[Part]] = []
    for p in sorted(parts, key=lambda p: (-len(p.dims), -p.cells)):
        near = [g for g in groups if any(set(p.dims) & set(q.dims) for q in g)]
        groups = [g for g in groups if g not in near] + [[q for g in near for q in g] + [p]]
    return groups


def join_tree(parts: list[Part]) -> Part:
    """One table of leaves that hang together.

    Leaves whose dimensions a larger one covers are joined to it first, so that they are looked up and never widen a
    full join.  What is left is split on the dimension that most leaves have: both sides are joined in themselves, and
    then with each other on all dimensions they share.
    """
    tops: list[Part] = []
    for p in sorted(parts, key=lambda p: (-len(p.dims), -p.cells)):
        home = next((i for i, t in enumerate(tops) if set(p.dims) <= set(t.dims)), None)
        if home is None:
            tops.append(p)
        else:
            tops[home] = grid_join(tops[home], p)
    if len(tops) == 1:
        return tops[0]
    counts = Counter(d for t in tops for d in t.dims)
    common = max(counts, key=lambda d: (counts[d], -list(counts).index(d)))
    inside = [t for t in tops if common in t.dims]
    outside = [t for t in tops if common not in t.dims]
    tree = reduce(grid_join, inside)
    for group in join_groups(outside):
        tree = grid_join(tree, join_tree(group))
    return tree


def combine(parts: list[Part]) -> DataFrame:
    """Leaves that share dimensions, directly or through others, are joined; groups that don't are concatenated."""
    return diagonal_concat([join_tree(g).df for g in join_groups(parts)])


def struct_wrap(df: DataFrame, names: list[str], separator: str = "/") -> DataFrame:
    """Columns named by paths become (nested) structs, after the other columns."""

    def build(prefix: str, below: list[str]) -> Column:
        fields, done = [], set()
        for n in below:
            head = n[len(prefix) :].split(separator)[0]
            if head in done:
                continue
            done.add(head)
            inner = [m for m in below if m.startswith(f"{prefix}{head}{separator}")]
            fields.append((build(f"{prefix}{head}{separator}", inner) if inner else F.col(f"`{n}`")).alias(head))
        return F.struct(*fields)

    paths = [n for n in names if separator in n]
    heads = list(dict.fromkeys(n.split(separator)[0] for n in paths))
    flat = [F.col(f"`{c}`") for c in df.columns if c not in paths]
    return df.select(*flat, *[build(f"{h}{separator}", [n for n in paths if n.startswith(f"{h}{separator}")]).alias(h) for h in heads])
