"""What the operators share: shared scratch tables and Arrow batches of texts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a Python task holds as objects at once (a longer text is a block of its own).
BLOCK_BYTES = 4 << 20
#: Bytes of an Arrow batch that goes to a Python task, where the session doesn't name any: rows alone bound none of long texts, and both sides hold a batch whole.
BATCH_BYTES, _BATCH = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes that a broadcast table may have.
BROADCAST_BYTES = 64 << 20
#: Functions of this subpackage that keep large tables in a worker, by name; a task keeps only what it uses.
_HELD: dict[str, Callable] = {}


def held(f: Callable) -> Callable:
    """``f`` with its last result kept for the tasks that a worker runs, until a task of another operator starts."""
    f = lru_cache(maxsize=1)(f)
    _HELD[f.__wrapped__.__module__] = f
    return f


def release_others(module: str) -> None:
    """Free the tables that tasks of other operators have left in this worker."""
    idle = [f for name, f in _HELD.items() if name != module and f.cache_info().currsize]
    for f in idle:
        f.cache_clear()
    if idle:
        gc.collect()


def task(run: Callable, module: str = "") -> Callable:
    """An Arrow function that gives its worker's free memory back to the system at its end, as workers stay for later tasks."""

    def with_room(batches: Iterator) -> Iterator:
        release_others(module)
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return with_room


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a local one only where it is unset and there is one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (found or f"{tempfile.gettempdir()}/gridloom-scratch").rstrip("/")


class Scratch:
    """Tables written to the shared folder; they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.kept: dict[str, DataFrame] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back; the returned frame has the path as ``scratch_path``."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back.scratch_path = path
        self.kept[path] = back
        return back

    def drop(self, *frames: DataFrame | None) -> None:
        """Delete tables that no later step reads."""
        for df in frames:
            if df is None or self.kept.pop(df.scratch_path, None) is None:
                continue
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def only(self, *frames: DataFrame) -> None:
        """Delete all tables but those that the result reads."""
        left = {df.scratch_path for df in frames}
        self.drop(*[df for path, df in self.kept.items() if path not in left])


def small(df: DataFrame, rows: int, size: Column | None = None, limit: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows and ``limit`` bytes, ``size`` being the bytes of one, so that it may be broadcast."""
    counted = df.select((F.lit(64) if size is None else size).cast("long").alias("size")).limit(rows + 1)
    n, held = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    return n <= rows and held <= limit


def bytes_of(*columns: str) -> Column:
    """Bytes of string or binary columns in a row."""
    return sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(64))


def row_key(doc_id: str, text: str) -> Column:
    """Equal for rows with equal ids and texts only."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("null")), F.lit("|"), F.coalesce(F.col(f"`{text}`"), F.lit("")))))


def text_blocks(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of a batch, each with its texts as bytes and about BLOCK_BYTES of them."""
    column = batch.column(text)
    column = column.cast(pa.large_binary()) if pa.types.is_large_string(column.type) else column.cast(pa.binary())
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > BLOCK_BYTES:
            yield batch.slice(start, i - start), column.slice(start, i - start).to_pylist()
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start), column.slice(start).to_pylist()


def bound_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches, unless it or the cluster's settings have a bound of their own."""
    if not spark.sparkContext.getConf().contains(_BATCH) and spark.conf.get(_BATCH, None) in (None, f"{64 << 20}b", "64MB"):
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def map_texts(
    df: DataFrame,
    text: str,
    keep: Iterable[str],
    fields: list[tuple[str, str | T.DataType]],
    work: Callable[[], Callable[[list[bytes | None]], list]],
) -> DataFrame:
    """``keep`` columns of ``df`` and new ``fields`` computed from whole texts.

    ``work()`` is called once for each task and gives a function from a list of
    texts (UTF-8 bytes or None) to one list or Arrow array for each field.  A
    kept column named as a new field gives way to the new one.
    """
    bound_batches(df.sparkSession)
    new = T.StructType([T.StructField(n, T._parse_datatype_string(t) if isinstance(t, str) else t) for n, t in fields])
    names = {n.lower() for n, _ in fields}
    keep = [c for c in dict.fromkeys(keep) if c.lower() not in names]
    source = df.select(*[df[f"`{c}`"] for c in keep], df[f"`{text}`"].alias("__text"))
    out = T.StructType([df.schema[c] for c in keep] + new.fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = work()
        for batch in batches:
            for part, texts in text_blocks(batch, "__text"):
                cols = [c if isinstance(c, pa.Array) else pa.array(c, a.type) for c, a in zip(f(texts), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + cols, names=[*keep, *arrow.names])

    return source.mapInArrow(task(run, work.__module__), out)
