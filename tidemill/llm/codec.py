"""Sorted 64-bit hashes and counts as compact bytes, to be shuffled in large rows."""

from __future__ import annotations

import struct

import numpy as np

_CHECK = np.uint64(0xFF)


def packed(h: np.ndarray) -> bytes:
    """Sorted fingerprints as differences of their keys, in planes of bytes, and check bytes."""
    key = h >> np.uint64(8)
    d = np.diff(key, prepend=key[:1])
    width = max(1, (int(d.max()).bit_length() + 7) // 8) if len(d) else 1
    planes = d.view(np.uint8).reshape(-1, 8)[:, :width].T
    return struct.pack("<IBQ", len(h), width, int(key[0]) if len(h) else 0) + planes.tobytes() + (h & _CHECK).astype(np.uint8).tobytes()


def unpacked(b: bytes) -> np.ndarray:
    n, width, first = struct.unpack_from("<IBQ", b)
    at = struct.calcsize("<IBQ")
    d = np.zeros((n, 8), np.uint8)
    d[:, :width] = np.frombuffer(b, np.uint8, n * width, at).reshape(width, n).T
    key = np.cumsum(d.view(np.uint64).ravel()) + np.uint64(first)
    return (key << np.uint64(8)) | np.frombuffer(b, np.uint8, n, at + n * width).astype(np.uint64)


def cuts(h: np.ndarray, segments: int) -> np.ndarray:
    """Where sorted fingerprints pass from one segment to the next."""
    bounds = (np.arange(1, segments).astype(object) << 64) // segments
    return np.concatenate([[0], np.searchsorted(h, np.array([int(x) for x in bounds], np.uint64)), [len(h)]])


def counted(n: np.ndarray) -> bytes:
    """Counts as single bytes, those of 255 and more apart."""
    big = n >= 255
    return struct.pack("<I", len(n)) + np.where(big, 255, n).astype(np.uint8).tobytes() + n[big].astype(np.int64).tobytes()


def uncounted(b: bytes) -> np.ndarray:
    (n,) = struct.unpack_from("<I", b)
    out = np.frombuffer(b, np.uint8, n, 4).astype(np.int64)
    out[out == 255] = np.frombuffer(b, np.int64, -1, 4 + n)
    return out
