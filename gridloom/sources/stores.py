"""Byte stores: local paths and every address that pyarrow's file systems open."""

from __future__ import annotations

import os
from functools import lru_cache


class Store:
    """Objects under a root, by key."""

    def get(self, key: str) -> bytes | None:
        raise NotImplementedError

    def part(self, key: str, start: int, length: int) -> bytes | None:
        """A byte range; a negative start counts from the end."""
        data = self.get(key)
        if data is None:
            return None
        start = start if start >= 0 else len(data) + start
        return data[start : start + length]

    def stamp(self, key: str) -> tuple | None:
        """What changes when an object is written again (empty for a missing object), or None if that can't be told."""
        return None

    def children(self, key: str) -> list[str]:
        raise NotImplementedError

    def put(self, key: str, data: bytes) -> None:
        raise NotImplementedError


class LocalStore(Store):
    def __init__(self, root: str):
        self.root = root

    def _path(self, key: str) -> str:
        return os.path.join(self.root, key) if key else self.root

    def get(self, key):
        try:
            with open(self._path(key), "rb") as f:
                return f.read()
        except (FileNotFoundError, IsADirectoryError, NotADirectoryError):
            return None

    def part(self, key, start, length):
        try:
            with open(self._path(key), "rb") as f:
                f.seek(start, os.SEEK_END if start < 0 else os.SEEK_SET)
                return f.read(length)
        except FileNotFoundError:
            return None

    def stamp(self, key):
        try:
            s = os.stat(self._path(key))
        except (FileNotFoundError, NotADirectoryError):
            return ()
        return s.st_size, s.st_mtime_ns, s.st_ino

    def children(self, key):
        try:
            return sorted(e.name for e in os.scandir(self._path(key)) if e.is_dir())
        except FileNotFoundError:
            return []

    def put(self, key, data):
        path = self._path(key)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(f"{path}.part", "wb") as f:
            f.write(data)
        os.replace(f"{path}.part", path)


class ArrowStore(Store):
    """s3://, gs://, abfs://, hdfs:// and the like."""

    def __init__(self, root: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(root)

    def get(self, key):
        try:
            with self.fs.open_input_stream(f"{self.root}/{key}") as f:
                return f.read()
        except FileNotFoundError:
            return None

    def part(self, key, start, length):
        try:
            with self.fs.open_input_file(f"{self.root}/{key}") as f:
                return f.read_at(length, start if start >= 0 else f.size() + start)
        except FileNotFoundError:
            return None

    def stamp(self, key):
        info = self.fs.get_file_info(f"{self.root}/{key}")
        return (info.size, info.mtime_ns) if info.is_file else ()

    def children(self, key):
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/{key}".rstrip("/"), allow_not_found=True))
        return sorted(i.base_name for i in found if i.type == fs.FileType.Directory)

    def put(self, key, data):
        path = f"{self.root}/{key}"
        self.fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with self.fs.open_output_stream(path) as f:
            f.write(data)


class HttpStore(Store):
    """Read-only, with consolidated metadata only: there is no listing."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def get(self, key):
        from urllib.error import HTTPError
        from urllib.request import urlopen

        try:
            with urlopen(f"{self.root}/{key}") as f:
                return f.read()
        except HTTPError as e:
            if e.code == 404:
                return None
            raise

    def children(self, key):
        return []


@lru_cache(maxsize=64)
def open_store(url: str) -> Store:
    scheme = url.split("://", 1)[0] if "://" in url else "file"
    if scheme == "file":
        return LocalStore(url.removeprefix("file://"))
    return HttpStore(url) if scheme in ("http", "https") else ArrowStore(url)


def scratch_url(spark) -> str:
    """A folder that all executors share: ``spark.checkpoint.dir``, or a local one where it is unset."""
    import tempfile

    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (found or f"{tempfile.gettempdir()}/gridloom-scratch").rstrip("/")
