import datetime as dt

import numpy as np
import pytest

import gridloom as g
from gridloom.plans.chunks import TooManyChunks
from gridloom.sources import codecs
from gridloom.sources.meta import load
from gridloom.sources.writer import PLAIN, GridWriter


@pytest.fixture(scope="module")
def store(tmp_path_factory):
    """A 3-D and a 2-D variable of different chunks, dimensions of 7 x 5 x 3 chunks."""
    root = str(tmp_path_factory.mktemp("store") / "s")
    w = GridWriter(root)
    a, b, c = 14, 10, 6
    for n, size in (("a", a), ("b", b), ("c", c)):
        w.array(n, np.arange(size), [n])
    i, j, k = np.meshgrid(np.arange(a), np.arange(b), np.arange(c), indexing="ij")
    data = (i * 10000 + j * 100 + k).astype("f8")
    w.array("data", data, ["a", "b", "c"], (2, 2, 2), attrs={"coordinates": "lat"})
    w.array("surface", data[0] + 0.5, ["b", "c"], (3, 4))
    w.array("lat", data[0] / 7, ["b", "c"], (2, 2))
    w.consolidate()
    return root, data


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_full_scan(spark, store):
    root, data = store
    out = rows(g.scan(spark, root))
    want = [(i, j, k, data[i, j, k], data[0, j, k] + 0.5, data[0, j, k] / 7) for i in range(14) for j in range(10) for k in range(6)]
    assert g.scan(spark, root).columns == ["a", "b", "c", "data", "surface", "lat"]
    assert out == sorted(want)


@pytest.mark.parametrize(
    "where, chunks",
    [
        (g.col("a") == 3, 15),
        (g.col("a") < 4, 30),
        ((g.col("a") < 4) & (g.col("b") < 4), 12),
        ((g.col("a") < 4) & (g.col("b") < 4) & (g.col("c") < 4), 8),
        ((g.col("a") == 3) & (g.col("b") == 3) & (g.col("c") == 3), 1),
        ((g.col("a") == 0) | (g.col("a") == 13), 30),
        ((g.col("a") < 4) & ~((g.col("b") >= 2) & (g.col("b") < 4)), 24),
        (g.col("data") > 5, 105),
        (~g.col("data").is_in([1.0]), 105),
        ((g.col("a") == 3) | (g.col("data") > 50), 105),
        (g.lit(False), 0),
        (g.col("a").is_in([0, 1, 5]), 30),
        (g.col("a") < 3.5, 30),
        (g.col("a") >= -1, 105),
        ("a < 4 AND 3 > b", 12),
        ("a IN (0, 13) OR NOT (c >= 2)", 55),
    ],
)
def test_chunks_and_rows(spark, store, where, chunks):
    root, _ = store
    plan = g.explain_chunks(spark, root, where, ["data"]).where("size(dims) = 3")
    assert plan.count() == chunks
    got = g.scan(spark, root, ["a", "b", "c", "data"], where)
    full = g.scan(spark, root, ["a", "b", "c", "data"])
    assert rows(got) == rows(full.where(where if isinstance(where, str) else where.column))


def test_limits_projection_dims(spark, store):
    root, _ = store
    with pytest.raises(TooManyChunks):
        g.scan(spark, root, ["data"], g.col("a") < 4, max_chunks=10)
    assert g.scan(spark, root, ["surface", "b"]).columns == ["surface", "b"]
    assert g.scan(spark, root, ["surface"]).count() == 60
    assert g.scan(spark, root, ["a", "c"]).count() == 14 * 10 * 6
    with pytest.raises(KeyError):
        g.scan(spark, root, ["nothing"])
    assert [len(x) for x in g.iter_batches(g.scan(spark, root, ["surface"]), 25)] == [25, 25, 10]


def test_pushdown(spark, store):
    root, _ = store
    g.register(spark)
    df = spark.read.format("grid").option("path", root).option("vars", "data").option("maxChunks", 15).load()
    assert df.where("a = 3").count() == 60


def test_groups_types_and_encodings(spark, tmp_path):
    root = str(tmp_path / "s")
    w = GridWriter(root)
    w.array("time", np.arange(4, dtype="i4") * 6, ["time"], attrs={"units": "hours since 2024-01-01"})
    w.array("lead", np.arange(3), ["lead"], attrs={"units": "hours"})
    packed = np.array([[0, 1, 2], [3, -9, 5], [6, 7, 8], [9, 10, 11]], "i2")
    w.array("t", packed, ["time", "lead"], (3, 2), attrs={"scale_factor": 0.5, "add_offset": 10.0, "_FillValue": -9})
    w.group("g")
    w.group("g/h")
    w.array("g/h/label", np.array([f"r{i}é" for i in range(4)], object), ["time"], (3,))
    w.array("g/u", np.array([2**63 + 1, 0, 5, 7], "u8"), ["time"])
    w.array("z", np.array([1.5, 2.5]), ["station"])
    w.consolidate()
    df = g.scan(spark, root)
    assert df.columns == ["time", "lead", "station", "t", "z", "g"]
    out = {(r.time, r.lead): r for r in df.where("station IS NULL").collect()}
    assert len(out) == 12
    first = out[dt.datetime(2024, 1, 1, 6), dt.timedelta(hours=0)]
    assert first.t == 11.5 and first.g.u == 0 and first.g.h.label == "r1é"
    assert np.isnan(out[dt.datetime(2024, 1, 1, 6), dt.timedelta(hours=1)].t)
    assert out[dt.datetime(2024, 1, 1), dt.timedelta(hours=2)].g.u == 2**63 + 1
    assert sorted(r.z for r in df.where("z IS NOT NULL").collect()) == [1.5, 2.5]
    when = (g.col("time") >= dt.datetime(2024, 1, 1, 12)) & (g.col("lead") == dt.timedelta(hours=1))
    assert g.explain_chunks(spark, root, when, ["t"]).count() == 2
    assert sorted(r.t for r in g.scan(spark, root, ["t"], when).collect()) == [13.5, 15.0]
    assert g.scan(spark, root, ["g.h.label"], g.col("g").field("u") == 5).collect()[0][0] == "r2é"


CODECS = [
    PLAIN,
    [{"name": "bytes", "configuration": {"endian": "big"}}],
    [*PLAIN, {"name": "gzip"}],
    [*PLAIN, {"name": "zlib"}],
    [*PLAIN, {"name": "zstd"}, {"name": "crc32c"}],
    [{"name": "transpose", "configuration": {"order": [1, 0]}}, *PLAIN],
    [{"name": "bitround", "configuration": {"keepbits": 40}}, *PLAIN],
    [{"name": "vendor.fixedscaleoffset", "configuration": {"scale": 10, "offset": 1, "dtype": "<f8", "astype": "<i4"}}, *PLAIN],
]


@pytest.mark.parametrize("codec", CODECS)
@pytest.mark.parametrize("shard", [None, (4, 6)])
def test_codecs_and_shards(spark, tmp_path, codec, shard):
    root = str(tmp_path / "s")
    values = np.arange(35, dtype="f8").reshape(5, 7) / 2
    values[2:4, 3:6] = 0
    w = GridWriter(root)
    alias = {"vendor.fixedscaleoffset": "fixedscaleoffset"}
    if codec[0]["name"].startswith("vendor"):
        import gridloom.sources.writer as writer

        plain, writer.encode = writer.encode, lambda a, c, _=None: codecs.encode(a, c, alias)
    try:
        w.array("v", values, ["y", "x"], (2, 3), shard, codec)
    finally:
        if codec[0]["name"].startswith("vendor"):
            writer.encode = plain
    df = g.scan(spark, root, ["y", "x", "v"], **{"codec.alias.vendor.fixedscaleoffset": "fixedscaleoffset"})
    got = np.zeros((5, 7))
    for r in df.collect():
        got[r.y, r.x] = r.v
    assert np.allclose(got, values)
    assert load(root).dims == {"y": 5, "x": 7}


def test_blosc():
    import struct

    import pyarrow as pa

    data = np.arange(2000, dtype="<i4")
    shuffled = data.view("u1").reshape(-1, 4).T.tobytes()
    parts = [pa.compress(shuffled[i * 2000 : (i + 1) * 2000], "zstd").to_pybytes() for i in range(4)]
    body = b"".join(struct.pack("<I", len(p)) + p for p in parts)
    frame = bytes([2, 1, 1 | 4 << 5, 4]) + struct.pack("<III", 8000, 8000, 20 + len(body)) + struct.pack("<I", 20) + body
    assert codecs.blosc_decode(frame) == data.tobytes()
    assert codecs.crc32c(b"123456789") == 0xE3069283


def test_a_store_written_again_is_read_again(spark, tmp_path):
    root = str(tmp_path / "again")

    def write(first):
        w = GridWriter(root)
        w.array("x", np.arange(6) + first, ["x"], (4,))
        w.array("v", np.arange(6, dtype="f8") + first, ["x"], (3,), (6,))
        w.consolidate()

    write(0)
    options = {"chunkCacheEntries": 10, "coordCacheEntries": 1}
    assert rows(g.scan(spark, root, where=g.col("x") >= 4, **options)) == [(4, 4.0), (5, 5.0)]
    write(100)
    assert rows(g.scan(spark, root, where=g.col("x") >= 104, **options)) == [(104, 104.0), (105, 105.0)]
    assert rows(g.scan(spark, root, **options))[0] == (100, 100.0)


def test_caches_are_bounded():
    from gridloom.sources.reader import Cache

    c, made = Cache(2), []
    for k in (1, 2, 1, 3, 1, 2):
        c.get((k,), [()], lambda k=k: made.append(k))
    assert made == [1, 2, 3, 2] and len(c.held) == 2
    c.get((9,), [None], lambda: made.append(9))
    assert len(c.held) == 2
    for k in range(5):
        c.get((k,), [()], lambda: 0, 0)
    assert len(c.held) == 5


def test_interpolation_reads_the_chunks_of_its_targets(spark, store):
    root, data = store
    at = spark.createDataFrame([(2.5, 3.0), (3.0, 3.5)], "a double, b double")
    chunks = g.explain_interpolation(spark, root, ["a", "b"], ["data"], at)
    assert sorted({(r.indices[0], r.indices[1]) for r in chunks.collect()}) == [(1, 1), (1, 2)] and chunks.count() == 6
    out = {(r.a, r.b, r.c): r.data for r in g.interpolate(spark, root, ["a", "b"], ["data"], at, ["c"]).select("interpolated.*").collect()}
    assert len(out) == 12 and out[2.5, 3.0, 4] == 25304.0 and out[3.0, 3.5, 0] == 30350.0
    exact = g.interpolate(spark, root, ["b"], ["surface"], spark.createDataFrame([(4.5, 2), (1.0, 99)], "b double, c long")).select("interpolated.*").collect()
    got = {r.c: r.surface for r in exact}
    assert got[2] == 452.5 and np.isnan(got[99])
    cut = g.interpolate(spark, root, ["b"], ["surface"], spark.createDataFrame([(3.0, 0)], "b double, c long"), where=(g.col("b") == 0) | (g.col("b") == 9))
    assert abs(cut.first().interpolated.surface - 300.5) < 1e-9


def test_arrow_batches(spark, store):
    root, _ = store
    batches = list(g.iter_arrow(g.scan(spark, root, ["b", "surface"]), 25))
    assert sum(b.num_rows for b in batches) == 60 and max(b.num_rows for b in batches) <= 25 and batches[0].schema.names == ["b", "surface"]


def test_store_over_http(spark, store):
    """A store that isn't a local folder: nothing can be listed, and what is read isn't cached."""
    import functools
    import http.server
    import threading

    root, data = store
    quiet = type("Quiet", (http.server.SimpleHTTPRequestHandler,), {"log_message": lambda *a: None})
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(quiet, directory=root))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_address[1]}"
        out = rows(g.scan(spark, url, ["a", "b", "c", "data"], (g.col("a") == 3) & (g.col("c") < 2)))
        assert out == [(3, j, k, data[3, j, k]) for j in range(10) for k in range(2)]
        with pytest.raises(KeyError):
            g.scan(spark, url, ["nothing"])
    finally:
        server.shutdown()


def test_unknown_struct_fields(spark, store):
    root, _ = store
    with pytest.raises(KeyError):
        g.scan(spark, root, ["data"], g.col("data").field("x") > 1)
