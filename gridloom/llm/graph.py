"""Connected components of links between nodes, by rounds of local contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, task


def local_roots(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each task's own edges (a, b) connect a node with."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}
        at = None

        def find(x):
            root = x
            while parent[root] != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for batch in batches:
            at = batch.schema.field("a").type
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                parent.setdefault(a, a)
                parent.setdefault(b, b)
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        for i in range(0, len(nodes), 20_000):
            part = nodes[i : i + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, at), pa.array([find(x) for x in part], at)], names=["node", "root"])

    return edges.select("a", "b").mapInArrow(task(run), f"node {kind}, root {kind}")


def components(edges: DataFrame, scratch: Scratch, rounds: int = 100) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); a component is named by its smallest node.

    In each round every task joins what its own edges connect and hands on one root
    for each node, so a node has at most one root from each task.  Roots of one node
    are the edges of the next round, and the node is written down with its smallest
    root; the largest node of a component is never a root, so rounds end.  At the end
    the written levels are followed from the last to the first.  No node's links
    are ever gathered.
    """
    levels: list[DataFrame] = []
    now = edges
    for _ in range(rounds):
        level = scratch.keep(
            local_roots(now).groupBy("node").agg(F.min("root").alias("to"), F.collect_set("root").alias("roots")).select("node", "to", F.array_remove("roots", F.col("to")).alias("others"))
        )
        levels.append(level)
        now = level.select(F.explode("others").alias("a"), F.col("to").alias("b"))
        if now.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    found = levels[-1].select("node", F.col("to").alias("component"))
    for level in levels[-2::-1]:
        upper = found.withColumnsRenamed({"node": "to", "component": "upper"})
        found = level.select("node", "to").join(upper, "to", "left").select("node", F.coalesce("upper", "to").alias("component"))
    out = scratch.keep(found)
    scratch.drop(*levels)
    return out
