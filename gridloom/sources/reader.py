"""Reading chunks and whole coordinate arrays."""

from __future__ import annotations

from collections import OrderedDict

import numpy as np

from .codecs import decode
from .meta import ArrayMeta
from .stores import Store, open_store


class ChunkTooLarge(ValueError):
    pass


def fill_array(meta: ArrayMeta, shape: tuple[int, ...]) -> np.ndarray:
    """A chunk that isn't stored: all fill values."""
    fill = meta.fill
    if meta.dtype == "string":
        return np.full(shape, fill or "", object)
    if meta.numpy_dtype == object:
        out = np.empty(shape, object)
        out.fill(bytes(fill or []))
        return out
    if isinstance(fill, str):
        fill = {"NaN": np.nan, "Infinity": np.inf, "-Infinity": -np.inf}.get(fill, np.nan)
    return np.full(shape, 0 if fill is None else fill, meta.numpy_dtype)


class Cache:
    """The last ``entries`` values asked for in this process (0: all of them), by keys that change when the objects read are written again."""

    def __init__(self, entries: int):
        self.entries, self.held = entries, OrderedDict()

    def get(self, key: tuple, stamps: list[tuple | None], make, entries: int | None = None):
        """The value of ``make``; it isn't kept if a store can't tell its objects' stamps."""
        if any(s is None for s in stamps):
            return make()
        key = (*key, tuple(stamps))
        if key in self.held:
            self.held.move_to_end(key)
            return self.held[key]
        value = self.held[key] = make()
        limit = self.entries if entries is None else entries
        while limit and len(self.held) > limit:
            self.held.popitem(last=False)
        return value


#: Coordinates, indexes of shards, and decoded chunks; the last are kept only where a scan asks for it.
_COORDS, _SHARDS, _CHUNKS = Cache(256), Cache(4096), Cache(4096)


def _shard_index(url: str, key: str, chunks: int, at_end: bool, checked: bool) -> np.ndarray | None:
    """(offset, length) of every inner chunk of a shard."""
    size = 16 * chunks + 4 * checked

    def read():
        data = open_store(url).part(key, -size if at_end else 0, size)
        return None if data is None else np.frombuffer(data[: 16 * chunks], "<u8").reshape(-1, 2)

    return _SHARDS.get((url, key, chunks, at_end, checked), [open_store(url).stamp(key)], read)


_MISSING = np.uint64(0xFFFFFFFFFFFFFFFF)


def read_chunk(url: str, meta: ArrayMeta, index: tuple[int, ...], aliases: dict[str, str] | None = None, limit: int = 50_000_000, cached: int | None = None) -> np.ndarray:
    """One (inner) chunk at its nominal shape, raw; with ``cached``, so many chunks are kept (0: all)."""
    if int(np.prod(meta.chunk, dtype=np.int64)) > limit:
        raise ChunkTooLarge(f"{meta.path}: a chunk of {meta.chunk} has more than {limit} elements")
    store, aliases = open_store(url), aliases or {}

    def read():
        data = _inner(store, url, meta, index) if meta.shard else store.get(meta.key(index).lstrip("/"))
        if data is None:
            return fill_array(meta, meta.chunk)
        return decode(data, list(meta.codecs), meta.numpy_dtype, meta.chunk, aliases)

    if cached is None:
        return read()
    outer = tuple(i * c // s for i, c, s in zip(index, meta.chunk, meta.shard)) if meta.shard else index
    return _CHUNKS.get((url, meta.path, str(meta), index, tuple(sorted(aliases.items()))), [store.stamp(meta.key(outer).lstrip("/"))], read, cached)


def _inner(store: Store, url: str, meta: ArrayMeta, index: tuple[int, ...]) -> bytes | None:
    per = tuple(s // c for s, c in zip(meta.shard, meta.chunk))
    outer, inner = tuple(i // p for i, p in zip(index, per)), tuple(i % p for i, p in zip(index, per))
    checked = any(c["name"] == "crc32c" for c in meta.shard_conf.get("index_codecs", []))
    key = meta.key(outer).lstrip("/")
    table = _shard_index(url, key, int(np.prod(per)), meta.shard_conf.get("index_location", "end") == "end", checked)
    if table is None:
        return None
    offset, length = table[np.ravel_multi_index(inner, per)]
    return None if offset == _MISSING else store.part(key, int(offset), int(length))


def read_box(url: str, meta: ArrayMeta, box: tuple[tuple[int, int], ...], aliases: dict[str, str] | None = None, limit: int = 50_000_000, cached: int | None = None) -> np.ndarray:
    """Decoded values of a box, from however many chunks it lies over."""
    shape = tuple(hi - lo for lo, hi in box)
    if not meta.shape:
        return meta.encoding.decode(read_chunk(url, meta, (), aliases, limit, cached).reshape(1)).reshape(())
    out = None
    spans = [range(lo // c, -(-hi // c)) for (lo, hi), c in zip(box, meta.chunk)]
    for index in np.ndindex(*[len(s) for s in spans]):
        at = tuple(s[i] for s, i in zip(spans, index))
        chunk = read_chunk(url, meta, at, aliases, limit, cached)
        src, dst = [], []
        for i, c, (lo, hi) in zip(at, meta.chunk, box):
            a, b = max(lo, i * c), min(hi, (i + 1) * c)
            src.append(slice(a - i * c, b - i * c))
            dst.append(slice(a - lo, b - lo))
        part = chunk[tuple(src)]
        if out is None:
            out = np.empty(shape, part.dtype)
        out[tuple(dst)] = part
    return meta.encoding.decode(out if out is not None else np.empty(shape, meta.numpy_dtype))


def coordinate(url: str, meta: ArrayMeta, aliases: dict[str, str] | None = None, entries: int | None = None) -> np.ndarray:
    """All values of a 1-D array, remembered in this process until one of its objects is written again."""
    store, named = open_store(url), tuple(sorted((aliases or {}).items()))
    step = meta.shard or meta.chunk
    stamps = [store.stamp(meta.key((i,)).lstrip("/")) for i in range(-(-meta.shape[0] // max(1, step[0])))]
    return _COORDS.get((url, meta.path, str(meta), named), stamps, lambda: read_box(url, meta, ((0, meta.shape[0]),), dict(named)), entries)


def cache_stats() -> dict[str, int]:
    return {"coordinates": len(_COORDS.held), "shard_indexes": len(_SHARDS.held), "chunks": len(_CHUNKS.held)}


def clear_caches() -> None:
    for c in (_COORDS, _SHARDS, _CHUNKS):
        c.held.clear()
    open_store.cache_clear()
