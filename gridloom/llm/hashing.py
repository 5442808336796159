"""Vectorised hashing of words and word shingles in NumPy."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Fixed values of XXH64.
P1, P2, P3, P4, P5 = (U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def _round(acc, lane):
    return _rotl(acc + lane * P2, 31) * P1


def mix(x: np.ndarray) -> np.ndarray:
    """XXH64's final mixing of 64-bit values."""
    x = (x ^ (x >> U(33))) * P2
    x = (x ^ (x >> U(29))) * P3
    return x ^ (x >> U(32))


def xxh64(buffer: bytes, start: np.ndarray, length: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of many slices of one buffer."""
    padded = buffer + bytes(8)
    n = len(buffer)
    byte = np.frombuffer(padded, np.uint8)
    lane8 = np.ndarray((n + 1,), "<u8", padded, 0, (1,))
    lane4 = np.ndarray((n + 1,), "<u4", padded, 0, (1,))
    seed_ = U(seed)
    with np.errstate(over="ignore"):
        h = np.full(len(start), seed_ + P5, U)
        at = start.astype(np.int64, copy=True)
        left = length.astype(np.int64, copy=True)
        long = np.flatnonzero(left >= 32)
        if len(long):
            v = [np.full(len(long), x, U) for x in (seed_ + P1 + P2, seed_ + P2, seed_, seed_ - P1)]
            on = np.arange(len(long))
            while len(on):
                rows = long[on]
                for k in range(4):
                    v[k][on] = _round(v[k][on], lane8[at[rows] + 8 * k])
                at[rows] += 32
                left[rows] -= 32
                on = on[left[long[on]] >= 32]
            acc = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for k in range(4):
                acc = (acc ^ _round(U(0), v[k])) * P1 + P4
            h[long] = acc
        h += length.astype(U)
        on = np.flatnonzero(left >= 8)
        while len(on):
            h[on] = _rotl(h[on] ^ _round(U(0), lane8[at[on]]), 27) * P1 + P4
            at[on] += 8
            left[on] -= 8
            on = on[left[on] >= 8]
        on = np.flatnonzero(left >= 4)
        h[on] = _rotl(h[on] ^ (lane4[at[on]].astype(U) * P1), 23) * P2 + P3
        at[on] += 4
        left[on] -= 4
        on = np.flatnonzero(left > 0)
        while len(on):
            h[on] = _rotl(h[on] ^ (byte[at[on]].astype(U) * P5), 11) * P1
            at[on] += 1
            left[on] -= 1
            on = on[left[on] > 0]
        return mix(h)


def words(text: bytes) -> list[bytes]:
    """Words between ASCII white space (space, tab to return)."""
    return text.split()


def joined(docs: list[list[bytes]]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All words, each followed by a space; their starts and lengths; the number of words of each document."""
    counts = np.fromiter(map(len, docs), np.int64, len(docs))
    flat = [w for d in docs for w in d]
    length = np.fromiter(map(len, flat), np.int64, len(flat))
    start = np.cumsum(length + 1) - length - 1
    return b" ".join(flat) + b" ", start, length, counts
