import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import gridloom as g
from gridloom.functions import selectors
from gridloom.operators.combine import Part, combine
from gridloom.operators.interp import interpolate_nd
from gridloom.sources.table_grid import Axis, TableGrid
from gridloom.sources.writer import GridWriter


def test_interpolation_over_times_with_gaps(spark):
    t0 = dt.datetime(2025, 2, 1, 16)
    rows = [(t0 + dt.timedelta(hours=h), x, 10.0 * h + x) for h in range(3) for x in (0.0, 2.0) if (h, x) != (2, 2.0)]
    grid = spark.createDataFrame(rows, "time timestamp_ntz, x double, v double")
    places = [(0, t0 + dt.timedelta(minutes=30), 1.0), (1, t0, 2.0), (2, t0 + dt.timedelta(hours=9), 0.0), (3, t0 + dt.timedelta(minutes=90), 1.0)]
    at = spark.createDataFrame(places, "label long, time timestamp_ntz, x double")
    out = {r.interpolated.label: r.interpolated.v for r in interpolate_nd(grid, ["time", "x"], ["v"], at).collect()}
    assert math.isclose(out[0], 6.0) and out[1] == 2.0 and out[2] == 20.0 and math.isnan(out[3])


def test_interpolation_restricts_the_source(spark):
    grid = spark.range(5).select(F.col("id").cast("double").alias("x"), (F.col("id") * F.col("id")).cast("double").alias("v"))
    at = spark.createDataFrame([(1.5,)], "x double")
    out = interpolate_nd(grid, ["x"], ["v"], at, where=(g.col("x") == 0) | (g.col("x") == 4)).first().interpolated
    assert out.v == 6.0


def test_combine_shares_and_concatenates(spark):
    a = spark.range(6).select((F.col("id") % 3).alias("__i_x"), F.floor(F.col("id") / 3).alias("__i_y"), F.col("id").alias("v")).withColumn("x", F.col("__i_x") * 10).withColumn("y", F.col("__i_y"))
    b = spark.range(3).select(F.col("id").alias("__i_x"), (F.col("id") * 10).alias("x"), F.col("id").alias("w"))
    c = spark.range(2).select(F.col("id").alias("__i_z"), F.col("id").alias("z"), F.col("id").alias("u"))
    out = combine([Part(a, ("x", "y"), 6), Part(b, ("x",), 3), Part(c, ("z",), 2)])
    rows = out.collect()
    assert len(rows) == 8 and sorted(r.w for r in rows if r.w is not None) == [0, 0, 1, 1, 2, 2]
    assert sum(r.u is not None for r in rows) == 2


def test_table_grid_filters_reach_the_scan(spark, tmp_path):
    spark.range(10_000).selectExpr("id as k", "id % 7 as j").write.parquet(f"{tmp_path}/t")
    grid = TableGrid.measured(spark.read.parquet(f"{tmp_path}/t"), {"k": 100, "j": 2})
    assert grid.axes == {"k": Axis(0, 10_000, 100), "j": Axis(0, 7, 2)}
    df = grid.scan((g.col("k") > 500) & ((g.col("k") < 600) | (g.col("k") == 700)))
    assert df.count() == 100
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(k,501)" in plan and "LessThan(k,701)" in plan
    assert grid.scan(g.lit(False)).count() == 0


def test_selectors(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], "a int, b double, ab string")
    m, f = selectors.matches("a"), selectors.by_index(1)
    assert (m | f).of(df) == ["a", "b", "ab"] and (m & f).of(df) == [] and (m - selectors.by_name("ab")).of(df) == ["a"]
    assert (~m).of(df) == ["b"] and (m ^ selectors.everything()).of(df) == ["b"] and selectors.empty().of(df) == []
    with pytest.raises(KeyError):
        selectors.by_name("zz").of(df)


def test_stream_of_an_appended_grid(spark, tmp_path):
    from gridloom.streaming import stream_appended

    root = str(tmp_path / "s")

    def write(n):
        w = GridWriter(root)
        w.array("time", np.arange(n), ["time"], (2,))
        w.array("v", np.arange(n * 3, dtype="f8").reshape(n, 3), ["time", "x"], (2, 3))
        w.consolidate()

    write(2)
    q = stream_appended(spark, root, ["v"], "time").writeStream.format("memory").queryName("grown").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        assert spark.table("grown").count() == 6
        write(5)
        q.processAllAvailable()
        assert sorted(r.v for r in spark.table("grown").collect()) == [float(i) for i in range(15)]
    finally:
        q.stop()


def test_table_grid_finds_what_the_predicate_finds(spark):
    """Null keys and keys beyond the axis too, for random predicates."""
    rng = random.Random(4)
    keys = [None, -3, 0, 5, 7, 42, 49, 50, 99, 100, 150, 200, 10**15]
    df = spark.createDataFrame([(k, j) for k in keys for j in (None, 1, 2)], "k long, j long").cache()
    grid = TableGrid(df, {"k": Axis(0, 100, 10), "j": Axis(0, 2, 1)})

    def predicate(depth):
        c, n = (g.col("k"), rng.choice([-5, 5, 50, 99, 150])) if rng.random() < 0.7 else (g.col("j"), rng.choice([0, 1, 2]))
        if depth == 0 or rng.random() < 0.3:
            return rng.choice([lambda: c < n, lambda: c >= n, lambda: c == n, lambda: c != n, lambda: c.is_null(), lambda: c.is_not_null(), lambda: c.is_in([n, 7, None]), lambda: g.lit(True)])()
        a, b = predicate(depth - 1), predicate(depth - 1)
        return rng.choice([lambda: a & b, lambda: a | b, lambda: a ^ b, lambda: ~a, lambda: g.when(a, b, predicate(0))])()

    for where in [g.col("k").is_null(), g.col("k") < 50, g.col("k") >= 150, g.col("k").is_null() | (g.col("k") == 5), *(predicate(2) for _ in range(30))]:
        assert sorted(map(str, grid.scan(where).collect())) == sorted(map(str, df.where(where.column).collect())), where.tree


def test_leaves_in_a_chain(spark):
    def leaf(dims, sizes, name):
        df = spark.range(1)
        for d, n in zip(dims, sizes):
            df = df.crossJoin(spark.range(n).select(F.col("id").alias(f"__i_{d}"), (F.col("id") * 10).alias(d)))
        return Part(df.drop("id").withColumn(name, sum(F.col(f"__i_{d}") * 7**i for i, d in enumerate(dims))), dims, int(math.prod(sizes)))

    out = combine([leaf(("a", "b"), (3, 2), "p"), leaf(("c", "d"), (4, 5), "r"), leaf(("b", "c"), (2, 4), "q"), leaf(("b",), (2,), "s"), leaf(("c", "b"), (4, 2), "u")])
    rows = out.collect()
    assert len(rows) == 3 * 2 * 4 * 5
    for r in rows:
        a, b, c, d = (r[x] // 10 for x in "abcd")
        assert (r.p, r.q, r.r, r.s, r.u) == (a + 7 * b, b + 7 * c, c + 7 * d, b, c + 7 * b)


def test_wide_regions_meet_quickly():
    where = g.col("a").is_in(list(range(0, 8000, 2))) & g.col("b").is_in(list(range(0, 8000, 2)))
    from gridloom.plans.predicate import Axes
    from gridloom.plans.region import Space

    space = Space(("a", "b"), (8000, 8000))
    yes, _ = where.regions(Axes(space, {"a": range(8000), "b": range(8000)}))
    assert 0 < len(yes.boxes) <= 4096
    assert all(any(lo <= i < hi and lo2 <= j < hi2 for (lo, hi), (lo2, hi2) in yes.boxes) for i, j in [(0, 0), (4000, 2), (7998, 7998)])


def test_stream_waits_for_a_writer(tmp_path):
    """Metadata in the middle of being written is read again."""
    import json
    import threading

    from gridloom.streaming.append import AppendedReader

    root = tmp_path / "s"
    w = GridWriter(str(root))
    w.array("time", np.arange(2), ["time"])
    w.array("v", np.arange(4.0), ["time"], (2,))
    whole = {n: (root / n / "zarr.json").read_text() for n in ("time", "v")}
    reader = AppendedReader({"path": str(root), "vars": "v", "along": "time"}, None)
    short = json.loads(whole["time"]) | {"shape": [4]}
    timer = threading.Timer(0.4, lambda: (root / "time" / "zarr.json").write_text(json.dumps(short)))
    timer.start()
    assert reader.latestOffset() == {"end": 4}
    timer.join()
