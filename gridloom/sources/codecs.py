"""Chunk codecs: bytes to arrays and back.

Names may be aliased (``aliases={"vendor.bitround": "bitround"}``), so that codecs
stored under a vendor's name are read by the plain one.
"""

from __future__ import annotations

import gzip
import struct
import zlib
from functools import lru_cache

import numpy as np

#: Numpy types of the format's data types.
DTYPES = {
    "bool": "?", "int8": "i1", "int16": "i2", "int32": "i4", "int64": "i8", "uint8": "u1", "uint16": "u2", "uint32": "u4", "uint64": "u8",
    "float16": "f2", "float32": "f4", "float64": "f8",
}


class UnsupportedCodec(ValueError):
    pass


@lru_cache(maxsize=1)
def _crc_table() -> list[int]:
    """The reflected table of the Castagnoli polynomial."""
    out = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (0x82F63B78 if i & 1 else 0)
        out.append(i)
    return out


def crc32c(data: bytes) -> int:
    table, crc = _crc_table(), 0xFFFFFFFF
    for b in data:
        crc = (crc >> 8) ^ table[(crc ^ b) & 0xFF]
    return crc ^ 0xFFFFFFFF


def blosc_decode(data: bytes) -> bytes:
    """A Blosc frame whose inner codec is zstd, lz4, snappy or zlib, with or without byte shuffle."""
    import pyarrow as pa

    _, _, flags, width = data[:4]
    nbytes, block, _ = struct.unpack("<III", data[4:16])
    if flags & 2:
        return data[16 : 16 + nbytes]
    if flags & 4:
        raise UnsupportedCodec("bit shuffle")
    kind = {1: "lz4_raw", 2: "snappy", 3: "zlib", 4: "zstd"}.get(flags >> 5)
    if kind is None:
        raise UnsupportedCodec("blosclz")
    blocks = -(-nbytes // block)
    starts = struct.unpack(f"<{blocks}I", data[16 : 16 + 4 * blocks])
    out = bytearray()
    for n, at in enumerate(starts):
        size = min(block, nbytes - n * block)
        # Blocks are split into one stream for each byte of an item unless told otherwise.
        streams = width if not flags & 16 and size == block and width <= 16 and size % width == 0 and size // width >= 128 else 1
        raw = bytearray()
        for _ in range(streams):
            (n_in,) = struct.unpack("<I", data[at : at + 4])
            part, want = data[at + 4 : at + 4 + n_in], size // streams
            at += 4 + n_in
            raw += part if n_in == want else zlib.decompress(part) if kind == "zlib" else pa.decompress(part, want, kind).to_pybytes()
        if flags & 1 and width > 1:
            whole = size // width * width
            raw = np.frombuffer(bytes(raw[:whole]), np.uint8).reshape(width, -1).T.tobytes() + bytes(raw[whole:])
        out += raw
    return bytes(out)


def vlen_decode(data: bytes, text: bool) -> np.ndarray:
    (n,) = struct.unpack("<I", data[:4])
    at, out = 4, np.empty(n, object)
    for i in range(n):
        (size,) = struct.unpack("<I", data[at : at + 4])
        raw = data[at + 4 : at + 4 + size]
        out[i] = raw.decode() if text else raw
        at += 4 + size
    return out


def vlen_encode(values: np.ndarray) -> bytes:
    raw = [v.encode() if isinstance(v, str) else bytes(v) for v in values.ravel()]
    return struct.pack("<I", len(raw)) + b"".join(struct.pack("<I", len(r)) + r for r in raw)


def _name(codec: dict, aliases: dict[str, str]) -> str:
    name = codec["name"]
    name = aliases.get(name, name)
    return name.rsplit(".", 1)[-1]


def _dtype(codec: dict, dtype: np.dtype) -> np.dtype:
    endian = codec.get("configuration", {}).get("endian", "little")
    return dtype.newbyteorder(">" if endian == "big" else "<")


def normal_dtype(text: str) -> np.dtype:
    """Type names of the fixedscaleoffset codec: numpy codes or the format's own names."""
    return np.dtype(DTYPES.get(text, text))


def decode(data: bytes, codecs: list[dict], dtype: np.dtype, shape: tuple[int, ...], aliases: dict[str, str]) -> np.ndarray:
    """The array of one chunk (or inner chunk) from its bytes."""
    import pyarrow as pa

    arrays = {"transpose", "bitround", "fixedscaleoffset"}
    first = [c for c in codecs if _name(c, aliases) in arrays]
    # What the array codecs make of shape and type decides what the bytes are.
    stored_shape, stored_dtype, undo = shape, dtype, []
    for c in first:
        name, conf = _name(c, aliases), c.get("configuration", {})
        if name == "transpose":
            order = tuple(conf["order"])
            stored_shape = tuple(stored_shape[i] for i in order)
            undo.append(lambda x, o=order: x.transpose(np.argsort(o)))
        elif name == "fixedscaleoffset":
            to = normal_dtype(conf.get("dtype", dtype.str))
            stored_dtype = normal_dtype(conf.get("astype", conf.get("dtype", dtype.str)))
            undo.append(lambda x, s=conf.get("scale", 1), o=conf.get("offset", 0), t=to: (x.astype("f8") / s + o).astype(t))
    for c in reversed([c for c in codecs if c not in first]):
        name, conf = _name(c, aliases), c.get("configuration", {})
        if name == "gzip":
            data = gzip.decompress(data)
        elif name == "zlib":
            data = zlib.decompress(data)
        elif name == "zstd":
            import zstandard

            data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
        elif name == "blosc":
            data = blosc_decode(data)
        elif name == "crc32c":
            body, (sent,) = data[:-4], struct.unpack("<I", data[-4:])
            if crc32c(body) != sent:
                raise ValueError("a chunk's checksum is wrong")
            data = body
        elif name in ("bytes", "endian"):
            array = np.frombuffer(data, _dtype(c, stored_dtype))
            array = array.astype(stored_dtype.newbyteorder("=")).reshape(stored_shape)
        elif name in ("vlen-utf8", "vlen-bytes"):
            array = vlen_decode(data, name == "vlen-utf8").reshape(stored_shape)
        else:
            raise UnsupportedCodec(name)
    for f in reversed(undo):
        array = f(array)
    del pa
    return array


def encode(array: np.ndarray, codecs: list[dict], aliases: dict[str, str] | None = None) -> bytes:
    import zstandard

    data = b""
    for c in codecs:
        name, conf = _name(c, aliases or {}), c.get("configuration", {})
        if name == "transpose":
            array = array.transpose(conf["order"])
        elif name == "bitround":
            bits = {4: 23, 8: 52, 2: 10}[array.dtype.itemsize] - conf["keepbits"]
            if bits > 0:
                raw = array.astype(array.dtype.newbyteorder("=")).view(f"u{array.dtype.itemsize}")
                one = raw.dtype.type(1)
                half = (one << raw.dtype.type(bits - 1)) - one
                raw = (raw + half + ((raw >> raw.dtype.type(bits)) & one)) & ~((one << raw.dtype.type(bits)) - one)
                array = raw.view(array.dtype)
        elif name == "fixedscaleoffset":
            to = normal_dtype(conf.get("astype", conf.get("dtype", array.dtype.str)))
            array = np.around((array - conf.get("offset", 0)) * conf.get("scale", 1)).astype(to)
        elif name in ("bytes", "endian"):
            data = np.ascontiguousarray(array).astype(_dtype(c, array.dtype)).tobytes()
        elif name in ("vlen-utf8", "vlen-bytes"):
            data = vlen_encode(array)
        elif name == "gzip":
            data = gzip.compress(data, conf.get("level", 5), mtime=0)
        elif name == "zlib":
            data = zlib.compress(data, conf.get("level", 5))
        elif name == "zstd":
            data = zstandard.ZstdCompressor(level=conf.get("level", 3)).compress(data)
        elif name == "crc32c":
            data += struct.pack("<I", crc32c(data))
        else:
            raise UnsupportedCodec(name)
    return data
