"""Aggregates whose meaning needs more than one built-in function.

Order-dependent ones take the columns that order the rows; nothing depends on the
order in which chunks are read.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def n_unique(c: Column) -> Column:
    """Distinct values, null being one of them."""
    return F.countDistinct(c) + F.max(c.isNull().cast("long"))


def null_count(c: Column) -> Column:
    return F.count_if(c.isNull())


def first_by(c: Column, *order: str) -> Column:
    return F.min_by(c, F.struct(*order))


def last_by(c: Column, *order: str) -> Column:
    return F.max_by(c, F.struct(*order))


def first_non_null_by(c: Column, *order: str) -> Column:
    return F.min_by(c, F.when(c.isNotNull(), F.struct(*order)))


def last_non_null_by(c: Column, *order: str) -> Column:
    return F.max_by(c, F.when(c.isNotNull(), F.struct(*order)))


def item(c: Column) -> Column:
    """The only value; more or fewer are an error."""
    return F.when(F.count(F.lit(1)) == 1, F.max(c)).otherwise(F.raise_error(F.lit("item() needs one row")))


def implode(c: Column, *order: str) -> Column:
    """All values in order, as a list."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, c.alias("__v")))), lambda x: x["__v"])


def agg_groups(index: str) -> Column:
    """The row numbers of a group, in order."""
    return F.array_sort(F.collect_list(index))


def filtered(agg, c: Column, where: Column) -> Column:
    """``agg`` over the rows where a condition holds."""
    return agg(F.when(where, c))


def std(c: Column, ddof: int = 1) -> Column:
    return F.stddev_samp(c) if ddof == 1 else F.stddev_pop(c) if ddof == 0 else F.sqrt(var(c, ddof))


def var(c: Column, ddof: int = 1) -> Column:
    if ddof in (0, 1):
        return F.var_samp(c) if ddof else F.var_pop(c)
    return F.when(F.count(c) > ddof, F.var_pop(c) * F.count(c) / (F.count(c) - ddof))


def any_true(c: Column) -> Column:
    """Whether some value is true; false where there are none."""
    return F.coalesce(F.bool_or(c), F.lit(False))


def all_true(c: Column) -> Column:
    """Whether no value is false; true where there are none."""
    return F.coalesce(F.bool_and(c), F.lit(True))


def has_nulls(c: Column) -> Column:
    return F.count_if(c.isNull()) > 0


def is_empty() -> Column:
    return F.count(F.lit(1)) == 0


def is_sorted(c: Column, *order: str) -> Column:
    """Whether the values never fall in the order of other columns (lists: within a group that fits a row)."""
    values = implode(c, *order)
    return F.size(F.filter(values, lambda x, i: (i > 0) & (x < F.get(values, i - 1)))) == 0
