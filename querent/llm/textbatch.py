"""Numpy views of Arrow string batches: whole texts as one byte buffer with vectorised words and span hashes.

Null texts are empty texts. Buffers are cut between documents so that one piece has about ``PIECE_BYTES``
bytes (more only when a single text is longer), which bounds a Python worker's memory.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_memory_back() -> None:
    """Returns what the C library and Arrow keep of freed arrays, so that a worker that lives long holds only what it uses."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


PRIME = np.uint64(2**31 - 1)
#: two bases drawn at random, once; spans of n bytes that differ collide with a chance of about (n / PRIME)**2
BASES = (1_348_267_193, 1_891_406_771)
BLOCK = 1 << 22
_powers = [np.ones(1, np.uint32) for _ in range(4)]  # of both bases and of their inverses

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
IS_PLAIN = ~IS_SPACE  # bytes of words [^\x20\x09-\x0D]+
IS_ALNUM = np.zeros(256, bool)  # bytes of lower-case words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
IS_ALNUM[48:58] = IS_ALNUM[97:123] = IS_ALNUM[128:] = True


def powers(n: int) -> list[np.ndarray]:
    """At least n powers modulo PRIME: of both bases, then of their inverses."""
    if len(_powers[0]) < n:
        p = int(PRIME)
        for k, base in enumerate((*BASES, *(pow(b, -1, p) for b in BASES))):
            out = _powers[k]
            while len(out) < n:
                out = np.concatenate([out, (out.astype(np.uint64) * np.uint64(pow(base, len(out), p)) % PRIME).astype(np.uint32)])
            _powers[k] = out
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads all input bits over the 64 output bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(32))


def _running(values: np.ndarray, power: np.ndarray, small: bool) -> np.ndarray:
    """Sums of (values + 1) times powers, by blocks; those of small values need not be reduced within a block."""
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    for lo in range(0, len(values), BLOCK):
        block = values[lo : lo + BLOCK].astype(np.uint64)
        block += np.uint64(1)
        block *= power[lo : lo + len(block)]
        if not small:
            block %= PRIME
        if lo:
            block[0] += out[lo] % PRIME
        np.cumsum(block, out=out[lo + 1 : lo + 1 + len(block)])
    return out


def prefix(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of two polynomial hashes over uint64 values, for span_hash()."""
    power = powers(max(1, len(values)))
    return _running(values % PRIME, power[0], False), _running(mix(values) % PRIME, power[1], False)


def span_hash(sums: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end) of the values behind sums; equal spans have equal hashes.

    Both polynomials are over a prime field: modulo a power of two, some strings would collide for every base.
    """
    inverse = powers(len(sums[0]))[2:]
    if len(sums[0]) <= BLOCK:
        a, b = ((s[end] - s[start]) % PRIME * i[start] % PRIME for s, i in zip(sums, inverse))
    else:  # the sums start anew, reduced, in each block
        a, b = ((s[end] % PRIME + PRIME - s[start] % PRIME) % PRIME * i[start] % PRIME for s, i in zip(sums, inverse))
    with np.errstate(over="ignore"):
        return mix((a << np.uint64(31) | b) + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def byte_sums(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power = powers(max(1, len(buf)))
    return _running(buf, power[0], True), _running(buf, power[1], True)


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not (pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)):
        col = col.cast(pa.large_binary() if pa.types.is_binary(col.type) else pa.large_string())
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_large_binary(col.type) else "")
    n = len(col)
    bufs = col.buffers()
    if n == 0 or bufs[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(bufs[1], np.int64)[col.offset : col.offset + n + 1]
    return np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]], off - off[0]


def joined(batches: Iterator[pa.RecordBatch], column: int, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Small batches put together until their texts have about size bytes."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.column(column).nbytes
        if n >= size:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)
    del held
    give_memory_back()


def recut(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The rows cut into batches of about size bytes of text, wherever the given batches end; none is empty."""
    held = None
    for batch in batches:
        held = batch if held is None else pa.concat_batches([held, batch])
        _, off = column_bytes(held.column(column))
        lo = 0
        while (hi := max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)) < held.num_rows:
            yield held.slice(lo, hi - lo)
            lo = hi
        held = held.slice(lo)
    if held is not None and held.num_rows:
        yield held
    del held
    give_memory_back()


def pieces(col: pa.Array, size: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a column between rows: (first row, row after the last, bytes, offsets) of about size bytes each."""
    buf, off = column_bytes(col)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        yield lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi
    if len(buf) >= 4 * size:
        give_memory_back()


def words(buf: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes with inside[byte], and offsets of each text's runs; runs end with their text."""
    ok = np.zeros(len(buf) + 2, bool)
    ok[1:-1] = inside[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[off] = True
    starts = np.flatnonzero(ok[1:] & (~ok[:-1] | cut))
    ends = np.flatnonzero(ok[:-1] & (~ok[1:] | cut))
    return starts, ends, np.searchsorted(starts, off)


def owner(counts_off: np.ndarray) -> np.ndarray:
    """Index of the text of each item, from items' offsets."""
    return np.repeat(np.arange(len(counts_off) - 1), np.diff(counts_off))


def sums_by(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of consecutive values between offsets; 0 for empty spans."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def expand(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each span, one after the other."""
    total = int(lens.sum())
    first = np.cumsum(lens) - lens
    return np.repeat(starts - first, lens) + np.arange(total)
