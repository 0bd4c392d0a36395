"""Window expressions, each over explicit partitions and order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def over(agg: Column, *by: str) -> Column:
    return agg.over(Window.partitionBy(*by))


def rank_average(c: str, *by: str) -> Column:
    """Rank with ties at the mean of their places."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, c))
    return F.rank().over(Window.partitionBy(*by).orderBy(c)) + (ties - 1) / 2.0


def rolling(agg, c: Column, n: int, by: list[str], order: list[str]) -> Column:
    """``agg`` over the last n rows, null before there are n of them."""
    w = Window.partitionBy(*by).orderBy(*order)
    frame = w.rowsBetween(1 - n, 0)
    return F.when(F.count(F.lit(1)).over(frame) == n, agg(c).over(frame))


def cumulative(agg, c: Column, by: list[str], order: list[str]) -> Column:
    return agg(c).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def shift(c: Column, n: int, by: list[str], order: list[str]) -> Column:
    w = Window.partitionBy(*by).orderBy(*order)
    return F.lag(c, n).over(w) if n >= 0 else F.lead(c, -n).over(w)


def diff(c: Column, n: int, by: list[str], order: list[str]) -> Column:
    return c - shift(c, n, by, order)


def is_unique(*cols: str) -> Column:
    return F.count(F.lit(1)).over(Window.partitionBy(*cols)) == 1


def is_duplicated(*cols: str) -> Column:
    return ~is_unique(*cols)


def is_first_distinct(cols: list[str], order: list[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*cols).orderBy(*order)) == 1


def is_last_distinct(cols: list[str], order: list[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*cols).orderBy(*[F.col(c).desc() for c in order])) == 1


def mark_first_distinct(df: DataFrame, cols: list[str], order: list[str], name: str, last: bool = False) -> DataFrame:
    """``df`` with whether each row is the first (or last) of its key in an order that tells rows apart.

    As is_first_distinct, but keys are aggregated before they are shuffled, so a hot key isn't sorted by one task.
    """
    ends = df.groupBy(*[F.col(c).alias(f"__k_{c}") for c in cols]).agg((F.max if last else F.min)(F.struct(*order)).alias("__end"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in cols])
    return df.join(ends, same).select(*df.columns, F.struct(*order).eqNullSafe(F.col("__end")).alias(name))
