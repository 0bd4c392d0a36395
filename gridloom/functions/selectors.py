"""Sets of columns of a schema, combined like sets."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Selector:
    def __init__(self, choose: Callable[[T.StructType], list[str]]):
        self.choose = choose

    def __or__(self, other: Selector) -> Selector:
        return Selector(lambda s: [n for n in s.names if n in {*self.choose(s), *other.choose(s)}])

    def __and__(self, other: Selector) -> Selector:
        return Selector(lambda s: [n for n in self.choose(s) if n in other.choose(s)])

    def __sub__(self, other: Selector) -> Selector:
        return Selector(lambda s: [n for n in self.choose(s) if n not in other.choose(s)])

    def __xor__(self, other: Selector) -> Selector:
        return (self - other) | (other - self)

    def __invert__(self) -> Selector:
        return everything() - self

    def of(self, df: DataFrame) -> list[str]:
        return self.choose(df.schema)

    def select(self, df: DataFrame) -> DataFrame:
        return df.select(*[f"`{n}`" for n in self.of(df)])


def everything() -> Selector:
    return Selector(lambda s: list(s.names))


def empty() -> Selector:
    return Selector(lambda s: [])


def by_name(*names: str) -> Selector:
    def choose(s: T.StructType) -> list[str]:
        missing = [n for n in names if n not in s.names]
        if missing:
            raise KeyError(missing[0])
        return list(names)

    return Selector(choose)


def matches(pattern: str) -> Selector:
    return Selector(lambda s: [n for n in s.names if re.search(pattern, n)])


def by_dtype(*types: type[T.DataType]) -> Selector:
    return Selector(lambda s: [f.name for f in s.fields if isinstance(f.dataType, types)])


def by_index(*places: int) -> Selector:
    return Selector(lambda s: [s.names[i] for i in places])
