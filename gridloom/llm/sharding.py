"""Sharding by a hierarchical weighted hash tree.

Leaves (region, rack, shard) draw exponential arrival times from a hash of the
row's key and the leaf's path, scaled by the leaf's weight; a node's draw is the
earliest of its subtree, which is exponential with the subtree's weight.  A row
descends from the root to the child with the earliest draw at each level.  A
weight that changes moves rows only into or out of that leaf's subtree.  Each row
takes one hash for each leaf, and the plan grows with the tree: it is meant for up
to some hundred shards; for more, deal to groups of shards first and again within.

Defined results: null keys share one draw; a null text has no bytes (size 1,
CRC 0); equal rows are dealt alike and take neighbouring slots; an empty table
gives an empty result; other input columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Hash draws are 52-bit numbers, so that they are exact as doubles.
_DRAWS = 1 << 52


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0

    @property
    def path(self) -> str:
        return f"{self.region}/{self.rack}/{self.shard}"


def tree(shards: int, racks: int = 2, shards_per_rack: int = 4) -> list[Leaf]:
    """Shards 0, 1, ... fill racks, and racks fill regions; more shards only add leaves."""
    return [Leaf(i // (racks * shards_per_rack), i // shards_per_rack, i) for i in range(shards)]


def _draw(key: Column, leaf: Leaf) -> Column:
    digest = F.md5(F.concat(key, F.lit("/" + leaf.path)))
    unit = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(_DRAWS))
    return -F.log(unit) / F.lit(float(leaf.weight))


def descend(key: Column, leaves: list[Leaf]) -> Column:
    """The shard of a key: the child with the earliest draw at the region, rack and shard levels.

    Ties go to the child that comes first.
    """
    leaves = [x for x in leaves if x.weight > 0]
    if not leaves:
        raise ValueError("no leaf has a positive weight")
    draws = F.array(*[_draw(key, x) for x in leaves])
    at = {x: i for i, x in enumerate(leaves)}

    def choose(d: Column, groups: list[list[Leaf]], inner) -> Column:
        """The group with the earliest subtree draw, then ``inner`` within it."""
        earliest = [reduce(lambda a, b: F.least(a, b), [d[at[x]] for x in g]) for g in groups]
        out = inner(d, groups[-1])
        for i in range(len(groups) - 2, -1, -1):
            rest = reduce(lambda a, b: F.least(a, b), earliest[i + 1 :])
            out = F.when(earliest[i] <= rest, inner(d, groups[i])).otherwise(out)
        return out

    def split(items: list[Leaf], part) -> list[list[Leaf]]:
        found: dict = {}
        for x in items:
            found.setdefault(part(x), []).append(x)
        return list(found.values())

    def shards(d, items):
        return choose(d, [[x] for x in items], lambda _, g: F.lit(g[0].shard))

    def racks(d, items):
        return choose(d, split(items, lambda x: x.rack), shards)

    # The draws are bound once by transform; each level only compares them.
    return F.transform(F.array(draws), lambda d: choose(d, split(leaves, lambda x: x.region), racks))[0].cast("int")


def assign(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", leaves=tree) -> DataFrame:
    """key, size, text_crc32, shard, grown_shard and slot of every row.

    ``leaves(n)`` is the tree of n shards.  Slots are gapless in each shard and
    follow (key, text_crc32, size).
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    name = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null"))
    rows = docs.select(
        F.col(f"`{key}`").alias("k"),
        (F.octet_length(body) + F.lit(1)).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("crc"),
        name.alias("name"),
    )
    # Equal rows are counted, so that no group of copies is ever sorted as rows.
    same = rows.groupBy("k", "size", "crc", "name").agg(F.count(F.lit(1)).alias("copies"))
    dealt = same.select("k", "size", "crc", "copies", descend(F.col("name"), leaves(shards)).alias("shard"), descend(F.col("name"), leaves(shards + 1)).alias("grown"))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["shard", "k", "crc", "size"]
    # Ranges of the slot order; each part numbers its own rows, and parts are offset by the counts before them.
    dealt = scratch.keep(dealt.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "part").agg(F.sum("copies").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    local = Window.partitionBy("shard", "part").orderBy(F.col("k").asc_nulls_first(), "crc", "size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = dealt.withColumn("rank", F.coalesce(F.sum("copies").over(local), F.lit(0))).join(starts, ["shard", "part"])
    return numbered.select(
        F.col("k").alias(key),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        F.explode(F.sequence(F.col("start") + F.col("rank"), F.col("start") + F.col("rank") + F.col("copies") - 1)).alias("slot"),
        F.col("grown").alias("grown_shard"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"), 16)

