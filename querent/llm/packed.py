"""Rows of packed numpy arrays, and exchanges of them: few large rows in place of very many small ones.

A row has a kind, a target (the group that it goes to), a source and a payload of compressed arrays. An exchange brings
the rows of each target together, in order of kind and source, so that a worker takes them one by one.
"""

from __future__ import annotations

import itertools
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "kind int, target long, source long, payload binary"
#: rows of an Arrow batch; payloads are up to some ten megabytes
BATCH_ROWS = 8
Row = tuple[int, int, int, bytes]
RARE = np.uint64(1 << 63)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; bytes of equal significance stand together."""
    import zstandard

    head = [struct.pack("<B", len(arrays))]
    body = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        if a.dtype.kind in "iu" and a.dtype.itemsize > 1 and len(a):
            low, high = int(a.min()), int(a.max())
            if low >= 0 and high < 1 << 32:  # narrow numbers take narrow places
                a = a.astype(np.uint8 if high < 1 << 8 else np.uint16 if high < 1 << 16 else np.uint32)
        head.append(struct.pack("<2sq", a.dtype.str[1:].encode(), len(a)))
        body.append(a.view(np.uint8).reshape(len(a), -1).T.tobytes() if a.dtype.itemsize > 1 and len(a) else a.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(head + body))


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    count, at, shapes = raw[0], 1, []
    for _ in range(count):
        kind, n = struct.unpack_from("<2sq", raw, at)
        shapes.append((np.dtype(kind.decode()), n))
        at += 10
    out = []
    for kind, n in shapes:
        size = kind.itemsize * n
        part = np.frombuffer(raw, np.uint8, size, at)
        out.append(np.ascontiguousarray(part.reshape(kind.itemsize, n).T).view(kind).ravel() if kind.itemsize > 1 and n else part.view(kind))
        at += size
    return out


def split_codes(codes: np.ndarray) -> list[np.ndarray]:
    """Codes as flags, narrow numbers and whole hashes, which compress better apart."""
    rare = codes >= RARE
    return [np.packbits(rare), codes[~rare].astype(np.uint32), codes[rare]]


def join_codes(flags: np.ndarray, narrow: np.ndarray, whole: np.ndarray) -> np.ndarray:
    rare = np.unpackbits(flags, count=len(narrow) + len(whole)).astype(bool)
    out = np.empty(len(rare), np.uint64)
    out[~rare], out[rare] = narrow, whole
    return out


def record(rows: list[Row]) -> pa.RecordBatch:
    kind, target, source, payload = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(target, pa.int64()), pa.array(source, pa.int64()), pa.array(payload, pa.binary())], names=["kind", "target", "source", "payload"])


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, list[np.ndarray]]]:
    """kind, target, source and arrays of each row."""
    for batch in batches:
        kind, target, source = (batch.column(c).to_pylist() for c in ("kind", "target", "source"))
        payload = batch.column("payload")
        for i in range(batch.num_rows):
            yield kind[i], target[i], source[i], unpack(payload[i].as_py())


Work = Callable[[int, Iterator[tuple[int, int, list[np.ndarray]]]], Iterator[pa.RecordBatch]]


def exchanged(rows: DataFrame, work: Work, schema: str = SCHEMA) -> DataFrame:
    """work(target, rows as (kind, source, arrays)) for each target; its rows come one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for target, group in itertools.groupby(rows_of(batches), key=lambda r: r[1]):
            yield from work(target, ((kind, source, arrays) for kind, _, source, arrays in group))

    return rows.select("kind", "target", "source", "payload").repartition("target").sortWithinPartitions("target", "kind", "source").mapInArrow(run, schema)
