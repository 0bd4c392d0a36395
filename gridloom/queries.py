"""Queries over the tables of a data folder, one for each operator, with their SQL."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import api
from .functions import lists, selectors
from .operators import aggregates as A
from .operators import windows as W
from .operators.combine import Part, combine, diagonal_concat, grid_join, struct_wrap
from .operators.interp import interpolate_geospatial, interpolate_nd
from .plans.predicate import all_of, any_of, col, from_sql, lit, when
from .sources.stores import scratch_url
from .sources.table_grid import Axis, TableGrid
from .sources.versions import commit
from .sources.writer import PLAIN, GridWriter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Scans, projection, limits.


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def scan_project(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def scan_limit_sorted(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_orderkey BETWEEN 100 AND 4000 AND l_linenumber IN (1, 3, 5) GROUP BY 1, 2")
def grid_aggregate(spark, d):
    """A pruned scan of lineitem as a grid of (order, line), then an aggregate."""
    grid = TableGrid(t(spark, d, "lineitem"), {"l_orderkey": Axis(0, 10**12, 1000), "l_linenumber": Axis(0, 16, 4)})
    rows = grid.scan(col("l_orderkey").between(100, 4000) & col("l_linenumber").is_in([1, 3, 5]))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


# Predicates: each is planned over the key grid and applied to the rows.

_KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]


def _lines(spark, d, where) -> DataFrame:
    grid = TableGrid(t(spark, d, "lineitem"), {"l_orderkey": Axis(0, 10**12, 4096), "l_linenumber": Axis(0, 64, 2)})
    return grid.scan(where, _KEYS)


_L = "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE "
_PREDICATES: dict[str, tuple] = {
    "filter_eq": (lambda: col("l_orderkey") == 7, "l_orderkey = 7"),
    "filter_ne": (lambda: col("l_linenumber") != 1, "l_linenumber <> 1"),
    "filter_lt": (lambda: col("l_orderkey") < 500, "l_orderkey < 500"),
    "filter_range": (lambda: (col("l_orderkey") >= 100) & (col("l_orderkey") < 900), "l_orderkey >= 100 AND l_orderkey < 900"),
    "filter_between": (lambda: col("l_orderkey").between(50, 250, "left"), "l_orderkey >= 50 AND l_orderkey < 250"),
    "filter_is_in": (lambda: col("l_orderkey").is_in([1, 5, 9, 77, 1000]), "l_orderkey IN (1, 5, 9, 77, 1000)"),
    "filter_fraction": (lambda: col("l_orderkey") < 15.5, "l_orderkey < 15.5"),
    "filter_or": (lambda: (col("l_orderkey") < 100) | (col("l_linenumber") == 7), "l_orderkey < 100 OR l_linenumber = 7"),
    "filter_or_unplanned": (lambda: (col("l_orderkey") < 100) | (col("l_partkey") < 20), "l_orderkey < 100 OR l_partkey < 20"),
    "filter_xor": (lambda: (col("l_orderkey") < 300) ^ (col("l_linenumber") <= 2), "(l_orderkey < 300) <> (l_linenumber <= 2)"),
    "filter_not": (lambda: ~(col("l_orderkey") > 300), "NOT l_orderkey > 300"),
    "filter_not_unplanned": (lambda: ~col("l_partkey").is_in([1, 2, 3]), "l_partkey NOT IN (1, 2, 3)"),
    "filter_hole": (lambda: (col("l_orderkey") < 500) & ~((col("l_orderkey") >= 100) & (col("l_orderkey") < 400)), "l_orderkey < 500 AND NOT (l_orderkey >= 100 AND l_orderkey < 400)"),
    "filter_any_horizontal": (lambda: any_of([col("l_orderkey") == 3, col("l_linenumber") == 6, col("l_partkey") == 11]), "l_orderkey = 3 OR l_linenumber = 6 OR l_partkey = 11"),
    "filter_all_horizontal": (lambda: all_of([col("l_orderkey") < 1000, col("l_linenumber") >= 3, col("l_partkey") > 50]), "l_orderkey < 1000 AND l_linenumber >= 3 AND l_partkey > 50"),
    "filter_case_bool": (lambda: when(col("l_orderkey") < 200, col("l_linenumber") == 1, col("l_linenumber") == 2), "CASE WHEN l_orderkey < 200 THEN l_linenumber = 1 ELSE l_linenumber = 2 END"),
    "filter_columns": (lambda: col("l_orderkey") > col("l_partkey"), "l_orderkey > l_partkey"),
    "filter_literal_true": (lambda: lit(True) & (col("l_orderkey") < 20), "l_orderkey < 20"),
    "filter_literal_false": (lambda: lit(False) | (col("l_orderkey") == 4), "l_orderkey = 4"),
}


def _predicate(name: str, make, text: str) -> None:
    def run(spark, d):
        return _lines(spark, d, make())

    run.__name__ = name
    QUERIES[name], SQL[name] = run, _L + text


for _name, (_make, _text) in _PREDICATES.items():
    _predicate(_name, _make, _text)


@query(_L + "20 > l_orderkey AND l_linenumber IN (1, 2)")
def filter_reversed_literal(spark, d):
    return _lines(spark, d, from_sql(spark, "20 > l_orderkey AND l_linenumber IN (1, 2)"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
def filter_timestamp(spark, d):
    where = (col("o_orderdate") >= dt.datetime(1995, 3, 1)) & (col("o_orderdate") < dt.datetime(1996, 1, 1))
    return t(spark, d, "orders").where(where.column).select("o_orderkey")


@query("SELECT event_id FROM events WHERE ts - (SELECT min(ts) FROM events) < INTERVAL 3 DAY")
def filter_duration(spark, d):
    events = t(spark, d, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    first = events.agg(F.min("ts").alias("first"))
    age = events.join(F.broadcast(first), how="left").withColumn("age", F.col("ts") - F.col("first"))
    return age.where((col("age") < dt.timedelta(days=3)).column).select("event_id")


_GAPS = "(SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 7 = 0 THEN 'Infinity'::DOUBLE WHEN event_id % 11 = 0 THEN '-Infinity'::DOUBLE ELSE value END AS value FROM events)"


def _with_gaps(spark, d):
    """Events of which some values are null, NaN or infinite."""
    k = F.col("event_id")
    odd = F.when(k % 3 == 0, F.lit(None)).when(k % 5 == 0, F.lit(float("nan"))).when(k % 7 == 0, F.lit(float("inf"))).when(k % 11 == 0, F.lit(float("-inf"))).otherwise(F.col("value"))
    return t(spark, d, "events").select("event_id", odd.alias("value"))


@query(f"SELECT event_id, value IS NULL AS no_value, coalesce(isnan(value), false) AS nan_value FROM {_GAPS} WHERE value IS NULL OR isnan(value)")
def filter_null_nan(spark, d):
    v = col("value")
    return _with_gaps(spark, d).where((v.is_null() | v.is_nan()).column).select("event_id", v.is_null().column.alias("no_value"), F.coalesce(v.is_nan().column, F.lit(False)).alias("nan_value"))


@query(f"SELECT event_id FROM {_GAPS} WHERE value IS NOT NULL AND NOT isnan(value)")
def filter_not_null_not_nan(spark, d):
    v = col("value")
    return _with_gaps(spark, d).where((v.is_not_null() & v.is_not_nan()).column).select("event_id")


@query(f"SELECT event_id, value > 0 AS above FROM {_GAPS} WHERE isinf(value)")
def filter_infinite(spark, d):
    return _with_gaps(spark, d).where(col("value").is_infinite().column).select("event_id", (F.col("value") > 0).alias("above"))


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, CASE WHEN l_orderkey % 4 > 0 THEN l_linenumber END AS line FROM lineitem) WHERE line IS NULL OR line = 3")
def filter_null_keys(spark, d):
    """Null keys, and keys beyond the declared axis, are found by a scan of a table as a grid."""
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 4 > 0, F.col("l_linenumber")).alias("line"))
    return TableGrid(lines, {"line": Axis(0, 2, 1)}).scan(col("line").is_null() | (col("line") == 3), ["l_orderkey", "l_linenumber"])


@query("SELECT event_id FROM events WHERE isfinite(value) AND value > 1")
def filter_finite(spark, d):
    return t(spark, d, "events").where((col("value").is_finite() & (col("value") > 1)).column).select("event_id")


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'")
def filter_struct_field(spark, d):
    wrapped = t(spark, d, "customer").select("c_custkey", F.struct("c_name", "c_acctbal", F.struct("c_mktsegment").alias("deep")).alias("g"))
    where = (col("g").field("c_acctbal") > 5000) & (col("g").field("deep").field("c_mktsegment") == "BUILDING")
    return wrapped.where(where.column).select("c_custkey", F.col("g.c_name").alias("c_name"))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_retailprice END AS price FROM part")
def when_null(spark, d):
    return t(spark, d, "part").select("p_partkey", F.when((col("p_size") > 25).column, F.col("p_retailprice")).alias("price"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN CASE WHEN p_retailprice > 1200 THEN 'fine' ELSE 'plain' END ELSE 'large' END AS kind FROM part")
def when_chain(spark, d):
    size, price = F.col("p_size"), F.col("p_retailprice")
    return t(spark, d, "part").select("p_partkey", F.when(size < 10, "small").when(size < 30, F.when(price > 1200, "fine").otherwise("plain")).otherwise("large").alias("kind"))


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, l_quantity = max(l_quantity) OVER (PARTITION BY l_orderkey) AS top FROM lineitem) WHERE top")
def filter_over(spark, d):
    top = F.col("l_quantity") == W.over(F.max("l_quantity"), "l_orderkey")
    return t(spark, d, "lineitem").withColumn("top", top).where("top").select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate = (SELECT min(o_orderdate) FROM orders)")
def filter_aggregate(spark, d):
    """An aggregate inside a filter is one over all rows."""
    orders = t(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return orders.join(F.broadcast(orders.agg(F.min("o_orderdate").alias("o_orderdate"))), "o_orderdate", "left_semi").select("o_orderkey")


# Chunk plans over dense integer grids.


def _plan(spark, where, b: bool = False):
    axes = {"a": Axis(0, 70, 10)} | ({"b": Axis(0, 50, 10)} if b else {})
    return TableGrid(spark.range(1), axes).explain(where)


_A = "SELECT DISTINCT a // 10 AS a_chunk FROM range(70) r(a) WHERE "
_AB = "SELECT DISTINCT a // 10 AS a_chunk, b // 10 AS b_chunk FROM range(70) r(a), range(50) s(b) WHERE "


@query(_A + "a >= 15 AND a < 42")
def chunk_plan_1d(spark, d):
    return _plan(spark, (col("a") >= 15) & (col("a") < 42))


@query(_AB + "a < 20 AND b >= 31")
def chunk_plan_2d(spark, d):
    return _plan(spark, (col("a") < 20) & (col("b") >= 31), True)


@query(_AB + "a = 15 OR b IN (3, 44)")
def chunk_plan_or(spark, d):
    return _plan(spark, (col("a") == 15) | col("b").is_in([3, 44]), True)


@query(_AB + "a < 40 AND NOT (a >= 10 AND a < 30 AND b >= 10 AND b < 20)")
def chunk_plan_hole(spark, d):
    return _plan(spark, (col("a") < 40) & ~(col("a").between(10, 30, "left") & col("b").between(10, 20, "left")), True)


@query(_A + "a >= 69 OR a < 1")
def chunk_plan_edge(spark, d):
    return _plan(spark, (col("a") >= 69) | (col("a") < 1))


@query(_AB + "(a < 20) <> (b < 20)")
def chunk_plan_xor(spark, d):
    return _plan(spark, (col("a") < 20) ^ (col("b") < 20), True)


@query("SELECT DISTINCT a // 10 AS a_chunk FROM range(70) r(a)")
def chunk_plan_unknown(spark, d):
    return _plan(spark, (col("a") == 15) | (col("other") > 3))


# Joins of grids.


def _part(df: DataFrame, dims: tuple[str, ...], cells: int) -> Part:
    return Part(df, dims, cells, key="")


@query("SELECT l_orderkey AS k, l_linenumber, l_quantity, o_totalprice FROM lineitem FULL JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey IS NOT NULL")
def grid_broadcast_lower_rank(spark, d):
    """A variable of one dimension beside one of two: every cell of the larger grid keeps its row."""
    lines = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_quantity")
    orders = t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_totalprice")
    return grid_join(_part(lines, ("k", "l_linenumber"), 1 << 40), _part(orders, ("k",), 1 << 40)).df


@query("SELECT coalesce(a.k, b.k) AS k, a.x, a.n, b.y, b.m FROM (SELECT l_partkey AS k, l_linenumber AS x, count(*) AS n FROM lineitem GROUP BY 1, 2) a FULL JOIN (SELECT p_partkey AS k, p_size AS y, p_retailprice AS m FROM part) b ON a.k = b.k")
def grid_full_join(spark, d):
    """Grids that share one dimension and have one more each."""
    left = t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("k"), F.col("l_linenumber").alias("x")).agg(F.count("*").alias("n"))
    right = t(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("y"), F.col("p_retailprice").alias("m"))
    return combine([_part(left, ("k", "x"), 2), _part(right, ("k", "y"), 1)])


@query("SELECT r_regionkey, r_name, NULL::BIGINT AS p_partkey, NULL::INTEGER AS p_size FROM region UNION ALL SELECT NULL, NULL, p_partkey, p_size FROM part")
def diagonal_concat_tables(spark, d):
    return diagonal_concat([t(spark, d, "region").select("r_regionkey", "r_name"), t(spark, d, "part").select("p_partkey", "p_size")])


@query("SELECT r_regionkey AS region, r_name, NULL AS supplier, NULL AS s_name FROM region UNION ALL SELECT NULL, NULL, s_suppkey, s_name FROM supplier")
def independent_groups(spark, d):
    region = t(spark, d, "region").select(F.col("r_regionkey").alias("region"), "r_name")
    supplier = t(spark, d, "supplier").select(F.col("s_suppkey").alias("supplier"), "s_name")
    return combine([_part(region, ("region",), 5), _part(supplier, ("supplier",), 9)])


@query("SELECT n_nationkey, r_name AS r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def struct_wrap_groups(spark, d):
    joined = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    flat = joined.select("n_nationkey", F.col("r_name").alias("region/r_name"), F.col("n_name").alias("region/nation/n_name"))
    wrapped = struct_wrap(flat, flat.columns)
    return wrapped.select("n_nationkey", F.col("region.r_name").alias("r_name"), F.col("region.nation.n_name").alias("n_name"))


@query("SELECT vec_id, (i - 1)::BIGINT AS dim, embedding[i]::DOUBLE AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def array_to_tidy(spark, d):
    rows = t(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "value"))
    return rows.select("vec_id", F.col("dim").cast("long").alias("dim"), F.col("value").cast("double").alias("value"))


@query("SELECT l_orderkey, count(*) AS n, list(l_partkey ORDER BY l_linenumber, l_partkey)[1] AS first_part, list(l_partkey ORDER BY l_linenumber, l_partkey)[-1] AS last_part FROM lineitem GROUP BY 1")
def tidy_to_array(spark, d):
    rows = t(spark, d, "lineitem").groupBy("l_orderkey").agg(A.implode(F.col("l_partkey"), "l_linenumber", "l_partkey").alias("parts"))
    return rows.select("l_orderkey", lists.list_len(F.col("parts")).cast("long").alias("n"), lists.list_first(F.col("parts")).alias("first_part"), lists.list_last(F.col("parts")).alias("last_part"))


# Encodings.


@query("SELECT o_orderkey, o_orderdate::TIMESTAMP AS decoded FROM orders")
def cf_time_decode(spark, d):
    orders = t(spark, d, "orders").select("o_orderkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("raw"))
    return orders.select("o_orderkey", lists.decode_time(F.col("raw"), 1).alias("decoded"))


@query("SELECT p_partkey, round(round(p_retailprice * 100)::BIGINT * 0.01::DOUBLE + 5.0::DOUBLE, 6) AS price FROM part")
def cf_scale_offset(spark, d):
    packed = t(spark, d, "part").select("p_partkey", F.round(F.col("p_retailprice") * 100).cast("long").alias("raw"))
    return packed.select("p_partkey", F.round(lists.decode_packed(F.col("raw"), 0.01, 5.0, -1), 6).alias("price"))


# Aggregates.


@query("SELECT o_orderstatus, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(avg(o_totalprice), 4) AS mean, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders GROUP BY 1")
def agg_basic(spark, d):
    p = F.col("o_totalprice")
    return t(spark, d, "orders").groupBy("o_orderstatus").agg(F.min(p).alias("lo"), F.max(p).alias("hi"), F.round(F.avg(p), 4).alias("mean"), F.round(F.sum(p), 2).alias("total"), F.count("*").alias("n"))


@query("SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sd0, round(var_samp(l_quantity), 6) AS v, round(var_pop(l_quantity), 6) AS v0, median(l_quantity) AS med FROM lineitem GROUP BY 1")
def agg_std_var_median(spark, d):
    q = F.col("l_quantity")
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(A.std(q), 6).alias("sd"), F.round(A.std(q, 0), 6).alias("sd0"), F.round(A.var(q), 6).alias("v"), F.round(A.var(q, 0), 6).alias("v0"), F.median(q).alias("med"))


@query("SELECT event_type, count(DISTINCT v) + max(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS n FROM (SELECT event_type, CASE WHEN user_id % 3 > 0 THEN user_id END AS v FROM events) GROUP BY 1")
def agg_n_unique(spark, d):
    events = t(spark, d, "events").select("event_type", F.when(F.col("user_id") % 3 > 0, F.col("user_id")).alias("v"))
    return events.groupBy("event_type").agg(A.n_unique(F.col("v")).alias("n"))


@query("SELECT l_orderkey, first(v ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, v) FILTER (v IS NOT NULL) AS first_v, last(v ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, v) FILTER (v IS NOT NULL) AS last_v FROM (SELECT *, CASE WHEN l_quantity > 5 THEN l_quantity END AS v FROM lineitem) GROUP BY 1")
def agg_first_last(spark, d):
    v = F.when(F.col("l_quantity") > 5, F.col("l_quantity"))
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return t(spark, d, "lineitem").groupBy("l_orderkey").agg(A.first_non_null_by(v, *order).alias("first_v"), A.last_non_null_by(v, *order).alias("last_v"))


@query("SELECT l_returnflag, round(sum(l_quantity) FILTER (l_discount > 0.05), 4) AS q, count(*) FILTER (l_tax < 0.02) AS n FROM lineitem GROUP BY 1")
def agg_filtered(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(A.filtered(F.sum, F.col("l_quantity"), F.col("l_discount") > 0.05), 4).alias("q"), A.filtered(F.count, F.lit(1), F.col("l_tax") < 0.02).alias("n"))


@query("SELECT event_type, count(*) FILTER (v IS NULL) AS n FROM (SELECT event_type, CASE WHEN value > 1 THEN value END AS v FROM events) GROUP BY 1")
def agg_null_count(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(A.null_count(F.when(F.col("value") > 1, F.col("value"))).alias("n"))


@query("SELECT o_orderkey, max(o_totalprice) AS only FROM orders GROUP BY 1")
def agg_item(spark, d):
    return t(spark, d, "orders").groupBy("o_orderkey").agg(A.item(F.col("o_totalprice")).alias("only"))


@query("SELECT n_regionkey, len(g)::BIGINT AS n, g[1] AS lowest, g[-1] AS highest FROM (SELECT n_regionkey, list(i ORDER BY i) AS g FROM (SELECT n_regionkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation) GROUP BY 1)")
def agg_groups(spark, d):
    """The row numbers of each group."""
    rows = t(spark, d, "nation").withColumn("i", (F.row_number().over(Window.orderBy("n_nationkey")) - 1).cast("long"))
    return rows.groupBy("n_regionkey").agg(A.agg_groups("i").alias("g")).select("n_regionkey", F.size("g").cast("long").alias("n"), F.get("g", F.lit(0)).alias("lowest"), F.element_at("g", -1).alias("highest"))


@query("SELECT l_orderkey, bool_and(coalesce(l_quantity >= before, true)) AS rising FROM (SELECT l_orderkey, l_quantity, lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS before FROM lineitem) GROUP BY 1")
def agg_is_sorted(spark, d):
    return t(spark, d, "lineitem").groupBy("l_orderkey").agg(A.is_sorted(F.col("l_quantity"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").alias("rising"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, abs(l_discount - l_tax) <= greatest(0.25::DOUBLE * greatest(abs(l_discount), abs(l_tax)), 0.001::DOUBLE) AS near FROM lineitem")
def is_close(spark, d):
    near = lists.is_close(F.col("l_discount"), F.col("l_tax"), 0.25, 0.001)
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", near.alias("near"))


# Windows.

_W = "PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"
_BY, _ORDER = ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def _win(spark, d, **cols):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *[c.alias(n) for n, c in cols.items()])


_WK = "SELECT l_orderkey, l_linenumber, l_partkey, "


@query(_WK + "round(sum(l_quantity) OVER (PARTITION BY l_orderkey), 4) AS total, round(avg(l_quantity) OVER (PARTITION BY l_orderkey), 6) AS mean FROM lineitem")
def win_sum_mean_over(spark, d):
    return _win(spark, d, total=F.round(W.over(F.sum("l_quantity"), "l_orderkey"), 4), mean=F.round(W.over(F.avg("l_quantity"), "l_orderkey"), 6))


@query(_WK + "rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_orderkey, l_quantity) - 1) / 2.0 AS r FROM lineitem")
def win_rank_over(spark, d):
    return _win(spark, d, r=W.rank_average("l_quantity", "l_orderkey"))


@query(_WK + f"CASE WHEN count(*) OVER w = 3 THEN round(avg(l_quantity) OVER w, 6) END AS m, CASE WHEN count(*) OVER w = 3 THEN round(sum(l_quantity) OVER w, 4) END AS s FROM lineitem WINDOW w AS ({_W} ROWS 2 PRECEDING)")
def win_rolling(spark, d):
    q = F.col("l_quantity")
    return _win(spark, d, m=F.round(W.rolling(F.avg, q, 3, _BY, _ORDER), 6), s=F.round(W.rolling(F.sum, q, 3, _BY, _ORDER), 4))


@query(_WK + f"round(sum(l_quantity) OVER w, 4) AS s, max(l_quantity) OVER w AS hi, min(l_quantity) OVER w AS lo FROM lineitem WINDOW w AS ({_W} ROWS UNBOUNDED PRECEDING)")
def win_cumulative(spark, d):
    q = F.col("l_quantity")
    return _win(spark, d, s=F.round(W.cumulative(F.sum, q, _BY, _ORDER), 4), hi=W.cumulative(F.max, q, _BY, _ORDER), lo=W.cumulative(F.min, q, _BY, _ORDER))


@query(_WK + f"lag(l_quantity) OVER w AS before, lead(l_quantity) OVER w AS after, l_quantity - lag(l_quantity) OVER w AS change FROM lineitem WINDOW w AS ({_W})")
def win_shift_diff(spark, d):
    q = F.col("l_quantity")
    return _win(spark, d, before=W.shift(q, 1, _BY, _ORDER), after=W.shift(q, -1, _BY, _ORDER), change=W.diff(q, 1, _BY, _ORDER))


@query("SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_partkey, l_suppkey) = 1 AS uniq, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) = 1 AS first_of FROM lineitem")
def win_unique_first(spark, d):
    lines = t(spark, d, "lineitem").withColumn("uniq", W.is_unique("l_partkey", "l_suppkey"))
    first = W.mark_first_distinct(lines, ["l_returnflag"], ["l_orderkey", *_ORDER], "first_of")
    return first.select("l_orderkey", "l_linenumber", "l_partkey", "uniq", "first_of")


@query("SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_partkey, l_linenumber) > 1 AS again, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) = 1 AS last_of FROM lineitem")
def win_duplicated_last(spark, d):
    return _win(spark, d, again=W.is_duplicated("l_partkey", "l_linenumber"), last_of=W.is_last_distinct(["l_partkey"], ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity"]))


# Lists, structs, casts, strings, selectors.


@query("SELECT o_orderkey, list_value(o_custkey, o_orderkey)[1] + list_value(o_custkey, o_orderkey)[2] AS s, 2::BIGINT AS n FROM orders")
def concat_list(spark, d):
    both = t(spark, d, "orders").select("o_orderkey", lists.concat_list("o_custkey", "o_orderkey").alias("l"))
    return both.select("o_orderkey", (lists.gather(F.col("l"), F.lit(0)) + lists.list_last(F.col("l"))).alias("s"), lists.list_len(F.col("l")).cast("long").alias("n"))


@query("SELECT p_partkey, p_size + 1 AS bigger, abs(p_retailprice - 1500) AS away, p_retailprice::BIGINT AS whole FROM (SELECT p_partkey, p_size, p_retailprice FROM part) WHERE true")
def cast_arith_abs(spark, d):
    part = t(spark, d, "part")
    return part.select("p_partkey", (F.col("p_size") + 1).alias("bigger"), F.abs(F.col("p_retailprice") - 1500).alias("away"), F.rint("p_retailprice").cast("long").alias("whole"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 0")
def struct_ops(spark, d):
    wrapped = t(spark, d, "customer").select("c_custkey", F.struct("c_name", "c_acctbal").alias("s"))
    return wrapped.where("s.c_acctbal > 0").select("c_custkey", F.col("s").getField("c_name").alias("c_name"), F.col("s.c_acctbal").alias("c_acctbal"))


@query("SELECT p_partkey, upper(p_brand) AS brand FROM part WHERE p_type LIKE '%ROM%' OR starts_with(p_name, 'red')")
def string_post_filter(spark, d):
    return t(spark, d, "part").where(F.col("p_type").contains("ROM") | F.col("p_name").startswith("red")).select("p_partkey", F.upper("p_brand").alias("brand"))


@query("SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem")
def selector_regex(spark, d):
    return selectors.matches("key$").select(t(spark, d, "lineitem"))


@query("SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def selector_dtype(spark, d):
    return selectors.by_dtype(T.DoubleType).select(t(spark, d, "lineitem"))


@query("SELECT o_orderkey, o_custkey FROM orders")
def selector_algebra(spark, d):
    s = (selectors.matches("^o_") - selectors.by_dtype(T.StringType, T.DoubleType, T.TimestampType, T.TimestampNTZType)) & selectors.everything()
    return s.select(t(spark, d, "orders"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def selector_index_xor(spark, d):
    """Columns by place, what only one of two selectors has, and nothing."""
    s = (selectors.by_index(0, 1, 3) ^ selectors.by_index(2, 3)) | selectors.empty()
    return s.select(t(spark, d, "orders"))


@query("SELECT p_partkey, p_size * 2 AS doubled FROM part")
def udf_vectorised(spark, d):
    """An opaque Python function, run on Arrow batches."""

    @F.pandas_udf("int")
    def doubled(x: pd.Series) -> pd.Series:
        return x * 2

    return t(spark, d, "part").select("p_partkey", doubled("p_size").alias("doubled"))


# Interpolation.


def _grid2(spark):
    """A 6 x 5 grid with v = 3x + 2y + xy."""
    x, y = F.col("id") % 6 * 2.0, F.floor(F.col("id") / 6) * 3.0
    return spark.range(30).select(x.alias("x"), y.cast("double").alias("y"), (x * 3 + y * 2 + x * y).cast("double").alias("v"))


def _places(spark, d):
    return t(spark, d, "part").select("p_partkey", (F.col("p_size") % 11 / 1.1).alias("x"), (F.col("p_partkey") % 14 - 1.0).alias("y"))


def _flat(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.col(f"interpolated.{n}").alias(n) for n in names])


@query("SELECT p_partkey, round(2 * x + 1, 6) AS v FROM (SELECT p_partkey, least(greatest(p_size / 3.0, 0), 18) AS x FROM part)")
def interp_1d(spark, d):
    grid = spark.range(7).select((F.col("id") * 3.0).alias("x"), (F.col("id") * 6.0 + 1).alias("v"))
    at = t(spark, d, "part").select("p_partkey", (F.col("p_size") / 3.0).alias("x"))
    return _flat(interpolate_nd(grid, ["x"], ["v"], at), "p_partkey", "v").withColumn("v", F.round("v", 6))


@query("SELECT p_partkey, round(3 * x + 2 * y + x * y, 6) AS v FROM (SELECT p_partkey, least(p_size % 11 / 1.1, 10) AS x, least(greatest(p_partkey % 14 - 1.0, 0), 12) AS y FROM part)")
def interp_2d(spark, d):
    """Bilinear, with places outside the grid clamped to its border."""
    return _flat(interpolate_nd(_grid2(spark), ["x", "y"], ["v"], _places(spark, d)), "p_partkey", "v").withColumn("v", F.round("v", 6))


@query("SELECT p_partkey, g, round((3 * x + 2 * y + x * y) * g, 6) AS v FROM (SELECT p_partkey, least(p_size % 11 / 1.1, 10) AS x, least(greatest(p_partkey % 14 - 1.0, 0), 12) AS y FROM part), (SELECT unnest([1, 2, 3])::BIGINT AS g)")
def interp_group_dim(spark, d):
    """A dimension that the targets lack stays: one result for each of its values."""
    grid = _grid2(spark).select("x", "y", F.explode(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda g: F.struct(g.cast("long").alias("g"), (g * F.col("v")).alias("v")))).alias("s")).select("x", "y", "s.g", "s.v")
    return _flat(interpolate_nd(grid, ["x", "y"], ["v"], _places(spark, d), ["g"]), "p_partkey", "g", "v").withColumn("v", F.round("v", 6))


@query("SELECT p_partkey, g, round(2.0 * x * g, 6) AS v FROM (SELECT p_partkey, (p_partkey % 3)::BIGINT AS g, p_size % 5 / 2.0 AS x FROM part)")
def interp_exact(spark, d):
    """A target column that is a dimension but no axis selects exactly."""
    grid = spark.range(15).select((F.col("id") % 5).cast("double").alias("x"), F.floor(F.col("id") / 5).cast("long").alias("g")).withColumn("v", 2.0 * F.col("x") * F.col("g"))
    at = t(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 3).cast("long").alias("g"), (F.col("p_size") % 5 / 2.0).alias("x"))
    return _flat(interpolate_nd(grid, ["x"], ["v"], at), "p_partkey", "g", "v").withColumn("v", F.round("v", 6))


@query(
    "SELECT p_partkey, round((1 - w) * ((i % 8) * (i % 8)) + w * (((i + 1) % 8) * ((i + 1) % 8)) + lat, 6) AS v FROM (SELECT p_partkey, lat, floor(l / 45.0)::BIGINT AS i, l / 45.0 - floor(l / 45.0) AS w"
    " FROM (SELECT p_partkey, p_size % 9 * 10.0 - 40 AS lat, ((p_partkey * 7 % 720 - 360.0) % 360 + 360) % 360 AS l FROM part))"
)
def geo_wrap_neighbors(spark, d):
    """Longitudes wrap around from 315 to 0 degrees."""
    cells = spark.range(40)
    grid = cells.select((F.floor(F.col("id") / 8) * 20.0 - 40).cast("double").alias("lat"), (F.col("id") % 8 * 45.0).alias("lon"), ((F.col("id") % 8) * (F.col("id") % 8) + F.floor(F.col("id") / 8) * 20.0 - 40).cast("double").alias("v"))
    at = t(spark, d, "part").select("p_partkey", (F.col("p_size") % 9 * 10.0 - 40).alias("lat"), (F.col("p_partkey") * 7 % 720 - 360.0).alias("lon"))
    return _flat(interpolate_geospatial(grid, "lat", "lon", ["v"], at), "p_partkey", "v").withColumn("v", F.round("v", 6))


@query(
    "SELECT p_partkey, round((1 - w) * (i * i) + w * (((i + 1) % 8) * ((i + 1) % 8)) + lat, 6) AS v FROM (SELECT p_partkey, lat, floor(l / 45.0)::BIGINT AS i, l / 45.0 - floor(l / 45.0) AS w"
    " FROM (SELECT p_partkey, p_size % 9 * 10.0 - 40 AS lat, (p_partkey * 7 % 360 + 180.0) % 360 AS l FROM part))"
)
def geo_signed(spark, d):
    """A grid of longitudes from -180 to 135 degrees, and places from 0 to 360."""
    column, row = F.col("id") % 8, F.floor(F.col("id") / 8)
    grid = spark.range(40).select((row * 20.0 - 40).cast("double").alias("lat"), (column * 45.0 - 180).alias("lon"), (column * column + row * 20.0 - 40).cast("double").alias("v"))
    at = t(spark, d, "part").select("p_partkey", (F.col("p_size") % 9 * 10.0 - 40).alias("lat"), (F.col("p_partkey") * 7 % 360).cast("double").alias("lon"))
    return _flat(interpolate_geospatial(grid, "lat", "lon", ["v"], at), "p_partkey", "v").withColumn("v", F.round("v", 6))


@query("SELECT user_id, hour, round(total, 4) AS total, round(sum(total) OVER (PARTITION BY user_id ORDER BY hour), 4) AS running FROM (SELECT user_id, date_part('hour', ts)::INTEGER AS hour, sum(value) AS total FROM events GROUP BY 1, 2)")
def event_grid(spark, d):
    """Events as a grid of (user, hour), with a running total."""
    cells = t(spark, d, "events").groupBy("user_id", F.hour("ts").alias("hour")).agg(F.sum("value").alias("total"))
    return cells.select("user_id", "hour", F.round("total", 4).alias("total"), F.round(F.sum("total").over(Window.partitionBy("user_id").orderBy("hour")), 4).alias("running"))


@query("SELECT l_returnflag, bool_or(l_quantity > 49) AS any_big, bool_and(l_quantity > 0) AS all_pos, count(*) FILTER (l_tax IS NULL) > 0 AS nulls, count(*) = 0 AS nothing FROM lineitem GROUP BY 1")
def agg_bool(spark, d):
    q = F.col("l_quantity")
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(A.any_true(q > 49).alias("any_big"), A.all_true(q > 0).alias("all_pos"), A.has_nulls(F.col("l_tax")).alias("nulls"), A.is_empty().alias("nothing"))


@query("SELECT l_orderkey, list_sum(list_transform(list(l_quantity), lambda x: x * 2)) AS doubled, count(*) AS n FROM lineitem GROUP BY 1")
def list_eval(spark, d):
    rows = t(spark, d, "lineitem").groupBy("l_orderkey").agg(A.implode(F.col("l_quantity"), "l_linenumber", "l_partkey").alias("q"))
    return rows.select("l_orderkey", F.aggregate(F.transform("q", lambda x: x * 2), F.lit(0.0), lambda a, x: a + x).alias("doubled"), F.size("q").cast("long").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey LIMIT 50")
def sort_by_top_k(spark, d):
    order = [F.desc("l_quantity"), "l_orderkey", "l_linenumber", "l_partkey"]
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").orderBy(*order).limit(50)


# Stores: the same arrays, written once for a session, are scanned in several ways.


def _arrays(w: GridWriter) -> None:
    """time x lead x y (x), with packed, sharded, text and grouped variables and two chunk layouts."""
    time, lead, y, x = 4, 3, 10, 12
    w.array("time", np.arange(time) * 6, ["time"], attrs={"units": "hours since 2024-01-01"})
    w.array("lead", np.arange(lead), ["lead"], attrs={"units": "hours"})
    w.array("y", np.arange(y) * 0.5, ["y"])
    w.array("x", np.arange(x)[::-1] * 10, ["x"], (5,))
    cells = np.arange(time * lead * y * x, dtype="f8").reshape(time, lead, y, x)
    w.array("temperature", cells, ["time", "lead", "y", "x"], (2, 2, 4, 5), attrs={"coordinates": "lat"})
    w.array("precipitation", cells.astype("i4"), ["time", "lead", "y", "x"], (1, 3, 5, 4), (2, 3, 10, 8), [*PLAIN, {"name": "zstd"}, {"name": "crc32c"}], attrs={"scale_factor": 0.25, "add_offset": 1.0, "_FillValue": 7})
    w.array("surface", cells[0, 0] * 2, ["y", "x"], (3, 7), codecs=[{"name": "transpose", "configuration": {"order": [1, 0]}}, *PLAIN, {"name": "gzip"}])
    w.array("lat", cells[0, 0] / 4, ["y", "x"], (4, 5))
    w.group("soil")
    w.array("soil/depth", np.arange(y, dtype="f4") / 2, ["y"])
    w.group("soil/deep")
    w.array("soil/deep/name", np.array([f"layer {i}" for i in range(y)], object), ["y"], (4,))
    w.consolidate()


@lru_cache(maxsize=4)
def _store(root: str) -> str:
    url = f"{root}/gridloom-store-{uuid.uuid4().hex}"
    commit(url, _arrays)
    return url


_CELLS = """
WITH c AS (
  SELECT TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (6 * i) AS "time", j, k * 0.5 AS y, (11 - l) * 10 AS x, i, l, k,
         (((i * 3 + j) * 10 + k) * 12 + l)::DOUBLE AS v, (k * 12 + l)::DOUBLE AS s
  FROM range(4) a(i), range(3) b(j), range(10) e(k), range(12) f(l))
"""


def _scan(spark, columns, where=None):
    return api.scan(spark, _store(scratch_url(spark)), columns, where, version="main")


@query(_CELLS + 'SELECT "time", y::DOUBLE AS y, x::BIGINT AS x, v AS temperature FROM c WHERE "time" >= TIMESTAMP \'2024-01-01 12:00\' AND j = 1 AND y BETWEEN 1 AND 3 AND NOT (x > 30 AND x < 90)')
def store_box(spark, d):
    where = (col("time") >= dt.datetime(2024, 1, 1, 12)) & (col("lead") == dt.timedelta(hours=1)) & col("y").between(1, 3) & ~((col("x") > 30) & (col("x") < 90))
    return _scan(spark, ["time", "y", "x", "temperature"], where)


@query(_CELLS + "SELECT i::BIGINT AS i, j::BIGINT AS j, y::DOUBLE AS y, x::BIGINT AS x, v AS temperature, CASE WHEN v = 7 THEN NULL ELSE v * 0.25 + 1 END AS precipitation, s * 2 AS surface, s / 4 AS lat FROM c WHERE x < 50")
def store_mixed_grids(spark, d):
    """Variables of two chunk layouts and of lower rank, joined on shared dimensions."""
    df = _scan(spark, ["time", "lead", "y", "x", "temperature", "precipitation", "surface", "lat"], col("x") < 50)
    hours = lambda c: F.floor(c / 3600).cast("long")
    i = hours(F.unix_micros(F.col("time").cast("timestamp")) / 1e6 - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp")) / 1e6) / 6
    j = F.extract(F.lit("HOUR"), F.col("lead")).cast("long")
    rain = F.when(~F.isnan("precipitation"), F.col("precipitation"))
    return df.select(i.cast("long").alias("i"), j.alias("j"), "y", "x", "temperature", rain.alias("precipitation"), "surface", "lat")


@query("SELECT k * 0.5::DOUBLE AS y, (k / 2.0)::DOUBLE AS depth, 'layer ' || k AS name FROM range(10) e(k) WHERE k >= 4")
def store_groups(spark, d):
    """Groups are structs; a predicate goes into them."""
    df = _scan(spark, ["y", "soil"], col("soil").field("depth") >= 2.0)
    return df.select("y", F.col("soil.depth").cast("double").alias("depth"), F.col("soil.deep.name").alias("name")).distinct()


@query(_CELLS + "SELECT DISTINCT i // 2 AS time_chunk, k // 4 AS y_chunk, l // 5 AS x_chunk FROM c WHERE (\"time\" = TIMESTAMP '2024-01-01 18:00' OR x = 110) AND y < 2")
def store_chunks(spark, d):
    """The planned chunks of one variable, without its lead dimension."""
    from .sources.versions import resolve

    path = resolve(_store(scratch_url(spark)), "main")
    plan = api.explain_chunks(spark, path, ((col("time") == dt.datetime(2024, 1, 1, 18)) | (col("x") == 110)) & (col("y") < 2), ["temperature"])
    return plan.select(F.get("indices", F.lit(0)).alias("time_chunk"), F.get("indices", F.lit(2)).alias("y_chunk"), F.get("indices", F.lit(3)).alias("x_chunk")).distinct()


@query(_CELLS + "SELECT count(*) AS n, sum(v) AS total FROM c WHERE v > 700 OR y = 4.5")
def store_unplanned(spark, d):
    """What can't be planned is filtered all the same, also under OR."""
    return _scan(spark, ["temperature"], "temperature > 700 OR y = 4.5").agg(F.count("*").alias("n"), F.sum("temperature").alias("total"))


def _points(spark, d, columns: int) -> DataFrame:
    """Places on the store's y and x, the latter falling, in its first rows only."""
    return t(spark, d, "part").select("p_partkey", (F.col("p_size") % 7 * 0.4).alias("y"), (F.col("p_partkey") % columns * 15.0).alias("x"))


@query("SELECT p_partkey, round((2 * (p_size % 7 * 0.8 * 12 + 11 - p_partkey % 8 * 1.5))::DOUBLE, 6) AS surface FROM part")
def interp_store(spark, d):
    """Interpolated over a store, of which only the chunks that hold a bracket are read."""
    out = api.interpolate(spark, _store(scratch_url(spark)), ["y", "x"], ["surface"], _points(spark, d, 8), version="main")
    return _flat(out, "p_partkey", "surface").withColumn("surface", F.round("surface", 6))


@query("SELECT p_partkey, i::BIGINT AS i, j::BIGINT AS j, round(((i * 3 + j) * 120 + p_size % 7 * 0.8 * 12 + 11 - p_partkey % 8 * 1.5)::DOUBLE, 6) AS v FROM part, range(4) a(i), range(3) b(j)")
def interp_store_groups(spark, d):
    """Dimensions of the store that the places lack stay."""
    out = api.interpolate(spark, _store(scratch_url(spark)), ["y", "x"], ["temperature"], _points(spark, d, 8), ["time", "lead"], version="main")
    i = (F.unix_micros(F.col("time").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 21_600_000_000
    return _flat(out, "p_partkey", "time", "lead", "temperature").select("p_partkey", i.cast("long").alias("i"), F.extract(F.lit("HOUR"), F.col("lead")).cast("long").alias("j"), F.round("temperature", 6).alias("v"))


@query(
    "WITH p AS (SELECT p_size % 7 * 0.8 AS k, 11 - p_partkey % 3 * 1.5 AS l FROM part), y AS (SELECT floor(k) AS k, l FROM p UNION SELECT ceil(k), l FROM p), c AS (SELECT k, floor(l) AS l FROM y UNION SELECT k, ceil(l) FROM y)"
    " SELECT DISTINCT k::BIGINT // 4 AS y_chunk, l::BIGINT // 5 AS x_chunk FROM c"
)
def interp_chunks(spark, d):
    """The chunks of a 4-D variable that interpolation at some places would read, without its other dimensions."""
    plan = api.explain_interpolation(spark, _store(scratch_url(spark)), ["y", "x"], ["temperature"], _points(spark, d, 3), version="main")
    return plan.select(F.get("indices", F.lit(2)).alias("y_chunk"), F.get("indices", F.lit(3)).alias("x_chunk")).distinct()


def _odd_arrays(w: GridWriter) -> None:
    """A coordinate in no order, a dimension without coordinate, and three leaves in a chain."""
    u, v, z, q = 9, 6, 4, 5
    w.array("u", np.arange(u) * 4 % 9 * 10, ["u"], (4,))
    w.array("v", np.arange(v) * 1.5, ["v"])
    w.array("q", np.arange(q) + 100, ["q"])
    w.array("uv", np.arange(u * v, dtype="f8").reshape(u, v), ["u", "v"], (2, 4))
    w.array("vz", np.arange(v * z, dtype="f8").reshape(v, z), ["v", "z"], (3, 3))
    w.array("zq", np.arange(z * q, dtype="f8").reshape(z, q), ["z", "q"], (2, 5))
    w.consolidate()


@lru_cache(maxsize=4)
def _odd_store(root: str) -> str:
    url = f"{root}/gridloom-odd-{uuid.uuid4().hex}"
    commit(url, _odd_arrays)
    return url


def _odd(spark, columns, where=None):
    return api.scan(spark, _odd_store(scratch_url(spark)), columns, where, version="main")


@query("SELECT (i * 4 % 9 * 10)::BIGINT AS u, j * 1.5::DOUBLE AS v, (i * 6 + j)::DOUBLE AS uv FROM range(9) a(i), range(6) b(j) WHERE i * 4 % 9 * 10 BETWEEN 20 AND 50 AND j > 2")
def store_unsorted_coordinate(spark, d):
    """A box over a coordinate that neither rises nor falls."""
    return _odd(spark, ["u", "v", "uv"], col("u").between(20, 50) & (col("v") > 3.0))


@query("SELECT j * 1.5::DOUBLE AS v, k::BIGINT AS z, (j * 4 + k)::DOUBLE AS vz FROM range(6) b(j), range(4) c(k) WHERE k >= 2 AND j < 3")
def store_index_only(spark, d):
    """A dimension without a coordinate has its indices as values."""
    return _odd(spark, ["v", "z", "vz"], (col("z") >= 2) & (col("v") < 4.5))


@query("SELECT (i * 4 % 9 * 10)::BIGINT AS u, j * 1.5::DOUBLE AS v, k::BIGINT AS z, (l + 100)::BIGINT AS q, (i * 6 + j)::DOUBLE AS uv, (j * 4 + k)::DOUBLE AS vz, (k * 5 + l)::DOUBLE AS zq FROM range(9) a(i), range(6) b(j), range(4) c(k), range(5) e(l)")
def store_chain(spark, d):
    """Leaves over (u, v), (v, z) and (z, q), joined on what neighbours share."""
    return _odd(spark, ["u", "v", "z", "q", "uv", "vz", "zq"])
