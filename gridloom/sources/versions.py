"""Versions of a store: immutable snapshots and branches that point to them.

A versioned store has ``snapshots/<id>/``, each a whole store, and
``refs/<branch>.json`` with the snapshot's id and its parent.  A scan with
``version=`` reads one snapshot, whatever is committed meanwhile.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from .stores import open_store
from .writer import GridWriter


class UnknownVersion(KeyError):
    """Neither a branch nor a snapshot."""


def commit(url: str, write: Callable[[GridWriter], None], branch: str = "main") -> str:
    """Write a new snapshot and move the branch to it once it is whole; gives the snapshot's id."""
    store, new = open_store(url), uuid.uuid4().hex
    old = store.get(f"refs/{branch}.json")
    write(GridWriter(f"{url}/snapshots/{new}"))
    parent = json.loads(old)["snapshot"] if old else None
    store.put(f"refs/{branch}.json", json.dumps({"snapshot": new, "parent": parent}).encode())
    return new


def resolve(url: str, version: str) -> str:
    """The path of a branch's or snapshot's store."""
    store = open_store(url)
    ref = store.get(f"refs/{version}.json")
    name = json.loads(ref)["snapshot"] if ref else version
    if store.get(f"snapshots/{name}/zarr.json") is None:
        raise UnknownVersion(version)
    return f"{url}/snapshots/{name}"
