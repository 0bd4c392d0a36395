"""List and value helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def concat_list(*cols: str) -> Column:
    return F.array(*cols)


def list_len(c: Column) -> Column:
    return F.size(c)


def list_first(c: Column) -> Column:
    return F.get(c, F.lit(0))


def list_last(c: Column) -> Column:
    return F.try_element_at(c, F.lit(-1))


def gather(c: Column, at: Column) -> Column:
    return F.get(c, at)


def is_close(a: Column, b: Column, rel: float = 1e-9, absolute: float = 0.0) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def decode_time(raw: Column, unit_us: int, epoch: str = "1970-01-01") -> Column:
    """Whole units since an epoch as a time without zone."""
    base = F.unix_micros(F.lit(f"{epoch} 00:00:00").cast("timestamp"))
    return F.timestamp_micros(raw * F.lit(unit_us) + base).cast("timestamp_ntz")


def decode_packed(raw: Column, scale: float = 1.0, offset: float = 0.0, fill: float | None = None) -> Column:
    value = raw.cast("double") * F.lit(scale) + F.lit(offset)
    return value if fill is None else F.when(raw == F.lit(fill), F.lit(float("nan"))).otherwise(value)
