"""Compressed bitmaps of 64-bit ids, one container for each block of 65,536 ids.

A container is bytes: its kind and the ids' low 16 bits, as a sorted array, as
runs, or as a plain bitmap, whichever is shortest.
"""

from __future__ import annotations

import numpy as np

BLOCK_BITS = 16
_ARRAY, _BITMAP, _RUNS = b"a", b"b", b"r"
_BITMAP_BYTES = (1 << BLOCK_BITS) // 8


def encode(low: np.ndarray) -> bytes:
    """A container of ids within a block; repeats count once."""
    ids = np.unique(np.asarray(low, dtype=np.uint16))
    if not len(ids):
        return _ARRAY
    cuts = np.flatnonzero(np.diff(ids.astype(np.int32)) != 1)
    begins = ids[np.concatenate([[0], cuts + 1])]
    ends = ids[np.concatenate([cuts, [len(ids) - 1]])]
    size = min(2 * len(ids), 4 * len(begins), _BITMAP_BYTES)
    if size == 4 * len(begins) and len(begins) * 2 < len(ids):
        return _RUNS + np.stack([begins, ends], axis=1).astype("<u2").tobytes()
    if size == 2 * len(ids):
        return _ARRAY + ids.astype("<u2").tobytes()
    bits = np.zeros(1 << BLOCK_BITS, np.uint8)
    bits[ids] = 1
    return _BITMAP + np.packbits(bits, bitorder="little").tobytes()


def decode(container: bytes) -> np.ndarray:
    """The sorted ids of a container."""
    kind, data = container[:1], container[1:]
    if kind == _ARRAY:
        return np.frombuffer(data, "<u2")
    if kind == _BITMAP:
        return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")).astype(np.uint16)
    runs = np.frombuffer(data, "<u2").reshape(-1, 2).astype(np.int64)
    lengths = runs[:, 1] - runs[:, 0] + 1
    first = np.repeat(runs[:, 0] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return (first + np.arange(lengths.sum())).astype(np.uint16)


def union(containers: list[bytes]) -> bytes:
    """The ids that any of the containers of one block holds."""
    if len(containers) == 1:
        return containers[0]
    return encode(np.concatenate([decode(c) for c in containers]))


def cardinality(container: bytes) -> int:
    """Exact number of ids, without decoding."""
    kind, data = container[:1], container[1:]
    if kind == _ARRAY:
        return len(data) // 2
    if kind == _BITMAP:
        return int(np.bitwise_count(np.frombuffer(data, np.uint64)).sum())
    runs = np.frombuffer(data, "<u2").reshape(-1, 2).astype(np.int64)
    return int((runs[:, 1] - runs[:, 0] + 1).sum())


def among(container: bytes, low: np.ndarray) -> np.ndarray:
    """Which of some ids of its block are in the container."""
    kind, data = container[:1], container[1:]
    low = np.asarray(low, dtype=np.int64)
    if kind == _BITMAP:
        return (np.frombuffer(data, np.uint8)[low >> 3] >> (low & 7) & 1).astype(bool)
    values = np.frombuffer(data, "<u2").astype(np.int64)
    begins, ends = (values, values) if kind == _ARRAY else (values[0::2], values[1::2])
    if not len(begins):
        return np.zeros(len(low), bool)
    at = np.searchsorted(begins, low, side="right") - 1
    return (at >= 0) & (low <= ends[np.maximum(at, 0)])
