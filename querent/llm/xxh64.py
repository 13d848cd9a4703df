"""XXH64 of many strings at once."""

from __future__ import annotations

import numpy as np

P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: longer strings go through the library one by one
LONG = 256


def _left(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _round(state: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _left(state + lane * P2, 31) * P1


def hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """The hash of each string data[start : start + size]."""
    out = np.empty(len(start), np.uint64)
    if not len(start):
        return out
    raw = np.concatenate([data, np.zeros(8, np.uint8)]).tobytes()
    eight = np.ndarray((len(data) + 1,), np.uint64, raw, strides=(1,))
    four = np.ndarray((len(data) + 1,), np.uint32, raw, strides=(1,))
    order = np.argsort(size.astype(np.uint16) if size.max() < 1 << 16 else size, kind="stable")
    edge = np.flatnonzero(np.diff(size[order], prepend=-1))
    with np.errstate(over="ignore"):
        for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(order)]):
            n = int(size[order[lo]])
            if n > LONG:
                from xxhash import xxh64_intdigest

                for i in order[lo:].tolist():
                    out[i] = xxh64_intdigest(raw[start[i] : start[i] + size[i]], seed)
                break
            for a in range(lo, hi, 1 << 16):
                rows = order[a : min(hi, a + (1 << 16))]
                out[rows] = _equal_sizes(eight, four, data, start[rows], n, np.uint64(seed))
    return out


def _equal_sizes(eight, four, data, at, n: int, seed) -> np.ndarray:
    end = at + n
    if n >= 32:
        v = [np.full(len(at), s, np.uint64) for s in (seed + P1 + P2, seed + P2, seed, seed - P1)]
        for _ in range(n // 32):
            for k in range(4):
                v[k] = _round(v[k], eight[at + 8 * k])
            at = at + 32
        h = _left(v[0], 1) + _left(v[1], 7) + _left(v[2], 12) + _left(v[3], 18)
        for x in v:
            h = (h ^ _round(np.uint64(0), x)) * P1 + P4
    else:
        h = np.full(len(at), seed + P5, np.uint64)
    h = h + np.uint64(n)
    left = n % 32
    while left >= 8:
        h = _left(h ^ _round(np.uint64(0), eight[at]), 27) * P1 + P4
        at, left = at + 8, left - 8
    if left >= 4:
        h = _left(h ^ (four[at].astype(np.uint64) * P1), 23) * P2 + P3
        at, left = at + 4, left - 4
    while left:
        h = _left(h ^ (data[at].astype(np.uint64) * P5), 11) * P1
        at, left = at + 1, left - 1
    assert left == 0 and (at == end).all()
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))
