"""A store that grows along one dimension, read as a stream.

The source's offset is the length of the growing dimension; each micro-batch
holds the rows of the new indices.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader

from ..plans.chunks import pack
from ..plans.region import Region, Space
from ..plans.scan import leaves_of
from ..sources.datasource import Chunks, leaf_schema, read_rows, settings
from ..sources.meta import load


#: How often metadata that doesn't hang together is read again, and the seconds before each time.
TRIES, PAUSE = 50, 0.1


class AppendedGrid(DataSource):
    @classmethod
    def name(cls) -> str:
        return "grid_appended"

    def schema(self) -> T.StructType:
        meta = load(self.options["path"])
        return leaf_schema(meta, meta.expand(self.options["vars"].split(",")), False)

    def streamReader(self, schema: T.StructType) -> AppendedReader:
        return AppendedReader(dict(self.options), schema)


class AppendedReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.columns = options, schema
        self.along = options["along"]

    def initialOffset(self) -> dict:
        return {"end": 0}

    def latestOffset(self) -> dict:
        # While the store is being written its arrays may have other lengths than their dimensions.
        for left in range(TRIES - 1, -1, -1):
            try:
                return {"end": load(self.options["path"]).dims[self.along]}
            except (ValueError, KeyError, FileNotFoundError):
                if not left:
                    raise
                time.sleep(PAUSE)

    def _leaf(self):
        meta = load(self.options["path"])
        names = meta.expand(self.options["vars"].split(","))
        leaves = leaves_of(meta, names)
        if len(leaves) != 1:
            raise ValueError("a stream reads variables of one chunk grid")
        return meta, *leaves[0]

    def partitions(self, start: dict, end: dict) -> list[Chunks]:
        _, grid, _ = self._leaf()
        region = Region.along(Space(grid.dims, grid.shape), self.along, [(start["end"], end["end"])])
        return [Chunks(c) for c in pack(list(grid.select(region).items()), grid, settings(self.options)["part"])] or [Chunks([])]

    def read(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        from ..sources.reader import clear_caches

        clear_caches()
        meta, grid, arrays = self._leaf()
        for _, box in partition.chunks:
            yield from read_rows(meta, grid.dims, arrays, box, to_arrow_schema(self.columns), settings(self.options))


def stream_appended(spark: SparkSession, path: str, variables: list[str], along: str) -> DataFrame:
    spark.dataSource.register(AppendedGrid)
    return spark.readStream.format("grid_appended").option("path", path).option("vars", ",".join(variables)).option("along", along).load()
