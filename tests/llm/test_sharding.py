import hashlib
import math
import zlib
from collections import Counter, defaultdict

from gridloom.llm import sharding

from .conftest import documents


def brute(key, leaves):
    def draw(x):
        h = hashlib.md5(f"{key}/{x.path}".encode()).hexdigest()[:13]
        return -math.log((int(h, 16) + 0.5) / (1 << 52)) / x.weight

    return min(leaves, key=draw).shard


def test_assign(spark):
    rows = [(i, f"text {i % 50} é", "s") for i in range(600)] + [(7, "same", "s")] * 30 + [(None, None, None)] * 2 + [(5, "", "s")]
    df = documents(spark, rows).selectExpr("*", "'x' as shard", "0 as slot")
    out = sharding.assign(df, 16).collect()
    assert len(out) == len(rows)
    slots = defaultdict(list)
    for r in out:
        name = "null" if r.doc_id is None else str(r.doc_id)
        assert r.shard == brute(name, sharding.tree(16)) and r.grown_shard == brute(name, sharding.tree(17))
        assert r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t, _ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want
    assert sharding.assign(df.limit(0), 16).count() == 0


def test_weights_confine_movement(spark):
    from pyspark.sql import functions as F

    before = sharding.tree(12)
    after = [sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 1.0) for x in before]
    df = spark.range(2000).select(sharding.descend(F.col("id").cast("string"), before).alias("a"), sharding.descend(F.col("id").cast("string"), after).alias("b"))
    moved = df.where("a <> b").collect()
    assert moved and all(r.b == 5 for r in moved)
    share = df.where("b = 5").count() / 2000
    assert abs(share - 3 / 14) < 0.04
