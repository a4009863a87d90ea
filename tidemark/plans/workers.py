"""What Python workers share: hashing, memory, files of the shared folder."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs

_U = np.uint64
#: Multipliers of the 64-bit finalizer used by ``mix64`` (fixed values).
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Deterministic 64-bit mixing of unsigned integers, the same on every machine."""
    x = x.astype(np.uint64) + _U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


#: The C library's way to return freed memory, where it has one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns memory that a task has freed to the system: its worker waits for the next task while the executor needs the room."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a shared folder's URI."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)
