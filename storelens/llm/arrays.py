"""Sorted arrays in the shared folder, memory-mapped by workers.

A writing task puts each named array of a shard into one file; only files named in the rows of successful tasks are
used, so a task that ran twice or was lost leaves nothing behind that is read.  Readers map files on a shared mount
directly; a shard in another store is fetched once into the worker's own scratch folder and mapped there.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import lru_cache

import numpy as np

ALIGN = 64


def save(folder: str, arrays: dict[str, np.ndarray]) -> str:
    """Write a shard; returns its address (file, then name:type:offset:length of each array)."""
    from pyarrow import fs
    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.arrays"
    store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (
        fs.LocalFileSystem(), path)
    store.create_dir(os.path.dirname(at), recursive=True)
    parts, offset = [], 0
    with store.open_output_stream(at, buffer_size=1 << 20) as out:
        for name, a in arrays.items():
            parts.append(f"{name}:{a.dtype.str}:{offset}:{len(a)}")
            raw = np.ascontiguousarray(a).view(np.uint8)
            pad = -len(raw) % ALIGN
            out.write(raw)
            out.write(b"\0" * pad)
            offset += len(raw) + pad
    return ";".join([path, *parts])


@lru_cache(maxsize=8192)
def _local(path: str) -> str:
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" not in path:
        return path
    from pyarrow import fs
    store, at = fs.FileSystem.from_uri(path)
    out = os.path.join(_scratch(), os.path.basename(at))
    with store.open_input_stream(at) as src, open(out + ".part", "wb") as dst:
        while block := src.read(1 << 22):
            dst.write(block)
    os.replace(out + ".part", out)
    return out


@lru_cache(maxsize=1)
def _scratch() -> str:
    return tempfile.mkdtemp(prefix="arrays-")


@lru_cache(maxsize=8192)
def load(address: str) -> dict[str, np.ndarray]:
    path, *parts = address.split(";")
    out = {}
    for p in parts:
        name, kind, offset, n = p.rsplit(":", 3)
        out[name] = np.memmap(_local(path), np.dtype(kind), "r", int(offset), (int(n),)) if int(n) else np.empty(
            0, np.dtype(kind))
    return out


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted key in sorted ``keys``; -1 where it is not there."""
    if len(keys) == 0:
        return np.full(len(wanted), -1)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, -1)
