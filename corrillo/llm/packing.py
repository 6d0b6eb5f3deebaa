"""Numbers packed for the network: byte planes under zstandard, sorted keys as differences."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(values: np.ndarray) -> bytes:
    """A one-dimensional array of integers, as byte planes."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, dtype: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(planes.reshape(size, len(planes) // size).T).view(dtype).reshape(-1)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def split_by_range(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of `parts` equal ranges of 64-bit keys begins in the sorted array `keys`, and its end."""
    width = (1 << 64) // parts + 1
    return np.append(np.searchsorted(keys, np.array([i * width for i in range(parts)], np.uint64)), len(keys))
