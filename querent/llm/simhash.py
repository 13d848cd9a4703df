"""Operator 4: SimHash fingerprints and groups of near-duplicates by tiled exact comparison.

Distinct fingerprints are ordered by the population counts of their four 16-bit parts; those of equal counts form a tile.
Two fingerprints within the radius have counts that differ by no more in sum, so each tile meets only the tiles whose
counts are that near: all other pairs of tiles are skipped. A pair of tiles is compared block by block, by numpy
exclusive-or and bit counts; a tile's fingerprints stand in order of the counts of their bytes, and pairs of blocks whose
counts differ beyond the radius are skipped as well. A pair of tiles passes on only a spanning set of its links.

Defined results: a null or empty text has fingerprint zero, linked like any other; texts of one or two words use their
whole sequence; repeated rows are copies of each other; a null doc_id is never the smallest of a component that has
another (and null where it has none); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.llm import tables, xxh64
from querent.llm.components import components
from querent.llm.textbatch import IS_PLAIN, LOWER, expand, pieces, words

SHINGLE = 3
SEED = 42
RADIUS = 2
PARTS = 4
BLOCK = 512
#: fingerprints of a tile in one row
TILE_ROW = 1 << 16
#: decisions on rows are broadcast up to so many, and joined beyond
BROADCAST_ROWS = 2_000_000
CHUNK = 255
LANES = np.uint64(0x0101010101010101)


def fingerprints(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The 64-bit fingerprint of each text of a buffer."""
    n = len(off) - 1
    starts, ends, of = words(buf, off, IS_PLAIN)
    count = np.diff(of)
    out = np.zeros(n, np.uint64)
    if not len(starts):
        return out
    # words of a text with one space between them
    size = ends - starts
    at = np.cumsum(size + 1) - (size + 1)
    joined = np.full(int((size + 1).sum()), 32, np.uint8)
    joined[expand(at, size)] = LOWER[buf[expand(starts, size)]]
    shingles = np.where(count > 0, np.maximum(1, count - (SHINGLE - 1)), 0)
    first = expand(of[:-1], shingles)
    last = np.minimum(first + SHINGLE - 1, np.repeat(of[1:] - 1, shingles))
    h = xxh64.hashes(joined, at[first], at[last] + size[last] - at[first], SEED)
    full = np.flatnonzero(shingles)
    # bits are counted in eight bytes at once, 255 shingles at a time, so that no byte overflows
    chunks = -(-shingles[full] // CHUNK)
    chunk = np.cumsum(chunks) - chunks
    edges = np.repeat(np.cumsum(shingles[full]) - shingles[full], chunks) + CHUNK * (np.arange(int(chunks.sum())) - np.repeat(chunk, chunks))
    total = np.empty((len(full), 8, 8), np.int64)
    for bit in range(8):
        ones_of = np.add.reduceat((h >> np.uint64(bit)) & LANES, edges).view(np.uint8).reshape(-1, 8)
        total[:, :, bit] = np.add.reduceat(ones_of, chunk, axis=0, dtype=np.int64)
    total = total.reshape(-1, 64)
    ones = 2 * total > shingles[full][:, None]
    out[full] = np.packbits(ones, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, uid (equal for equal rows) and fp (the fingerprint's 64 bits as a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in pieces(batch.column(2)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(fingerprints(buf, off).view(np.int64))], names=["doc_id", "uid", "fp"])

    return tables.texts(docs).select("doc_id", uid_of("doc_id", "text").alias("uid"), "text").mapInArrow(run, "doc_id long, uid long, fp long")


def uid_of(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(text).cast("string"))


def byte_counts(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint8)).reshape(-1, 8)


def in_order(x: np.ndarray) -> np.ndarray:
    """Fingerprints by the population counts of their bytes."""
    counts = byte_counts(x)
    return x[np.lexsort((x, *counts.T))]


class Tile:
    """A tile's fingerprints in order, with the least and the largest counts of each block."""

    def __init__(self, x: np.ndarray):
        self.x = in_order(x)
        first, counts = np.arange(0, len(x), BLOCK), byte_counts(self.x).astype(np.int16)
        self.low, self.high = np.minimum.reduceat(counts, first), np.maximum.reduceat(counts, first)


def near_pairs(a: Tile, b: Tile | None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links between two tiles, or within one, as fingerprints."""
    same = b is None
    b = a if same else b
    both = a.x if same else np.concatenate([a.x, b.x])
    shift = 0 if same else len(a.x)
    label = np.arange(len(both))
    for i in range(len(a.low)):
        gap = np.maximum(0, np.maximum(a.low[i] - b.high, b.low - a.high[i])).sum(1)
        left = a.x[i * BLOCK : (i + 1) * BLOCK]
        for j in np.flatnonzero(gap <= RADIUS).tolist():
            if same and j < i:
                continue
            p, q = np.nonzero(np.bitwise_count(left[:, None] ^ b.x[None, j * BLOCK : (j + 1) * BLOCK]) <= RADIUS)
            p, q = p + i * BLOCK, q + j * BLOCK + shift
            while True:  # hook the greater label below the smaller until the links agree
                low, high = np.minimum(label[p], label[q]), np.maximum(label[p], label[q])
                apart = low != high
                if not apart.any():
                    break
                np.minimum.at(label, high[apart], low[apart])
                while (shorter := label[label]).tobytes() != label.tobytes():
                    label = shorter
    moved = np.flatnonzero(label != np.arange(len(both)))
    return both[moved], both[label[moved]]


def part_counts() -> Column:
    """The population counts of the four parts of fp, in one number."""
    part = [F.bit_count(F.shiftrightunsigned(F.col("fp"), 16 * i).bitwiseAND(F.lit(0xFFFF))).cast("long") for i in range(PARTS)]
    out = part[0]
    for p in part[1:]:
        out = out * 32 + p
    return out


def steps() -> list[int]:
    """Differences of tiles' numbers whose counts differ by no more than the radius in sum; one of each sign, zero first."""
    out = []
    for d in itertools.product(range(-RADIUS, RADIUS + 1), repeat=PARTS):
        if sum(map(abs, d)) <= RADIUS and d >= (0,) * PARTS:
            number = 0
            for x in d:
                number = number * 32 + x
            out.append(number)
    return sorted(out)


def links(distinct: DataFrame) -> DataFrame:
    """Spanning links a, b between distinct fingerprints fp."""

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of at most TILE_ROW fingerprints of a tile, from rows in order of tile; one for each pair of tiles that it takes part in."""

        def out(tile: int, x: np.ndarray) -> pa.RecordBatch:
            # of a pair of tiles, the lower one is first; parts of numbers never carry, as counts are 0 to 16 and digits 0 to 31
            lower, greater = [tile] * len(across), [tile - s for s in across]
            n = 2 * len(across) - 1
            return pa.RecordBatch.from_arrays([pa.array(lower + greater[1:], pa.int64()), pa.array(across + across[1:], pa.int64()), pa.array([0] * len(across) + [1] * (len(across) - 1), pa.int32()), pa.array([x.tobytes()] * n, pa.binary())], names=["tile", "step", "side", "fps"])

        across, now, held, n = steps(), None, [], 0
        for batch in batches:
            tile, fp = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            edge = np.concatenate([[0], np.flatnonzero(tile[1:] != tile[:-1]) + 1, [len(tile)]]) if len(tile) else np.zeros(1, np.int64)
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if held and (tile[lo] != now or n >= TILE_ROW):
                    yield out(now, np.concatenate(held))
                    held, n = [], 0
                now = int(tile[lo])
                held.append(fp[lo:hi])
                n += hi - lo
        if held:
            yield out(now, np.concatenate(held))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(k).to_pylist() for k in range(4)))

        found: list[tuple[np.ndarray, np.ndarray]] = []
        for (_, step), group in itertools.groupby(rows(), key=lambda r: r[:2]):
            sides: tuple[list, list] = [], []
            for r in group:
                sides[r[2]].append(np.frombuffer(r[3], np.uint64))
            if step == 0:
                found.append(near_pairs(Tile(np.concatenate(sides[0])), None))
            elif sides[0] and sides[1]:
                found.append(near_pairs(*(Tile(np.concatenate(s)) for s in sides)))
            if len(found) >= 256:
                yield linked(found)
                found = []
        if found:
            yield linked(found)

    def linked(found) -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*found))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    rows = distinct.select(part_counts().alias("tile"), "fp").repartition("tile").sortWithinPartitions("tile").mapInArrow(tiles, "tile long, step long, side int, fps binary")
    return rows.repartition("tile", "step").sortWithinPartitions("tile", "step", "side").mapInArrow(compare, "a long, b long")


def groups(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, uid, fp, root (a fingerprint of the group) and component_id of every row of docs(doc_id, text)."""
    marked = tables.stored(with_fingerprints(docs))
    distinct = tables.stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    with tables.batches(spark, 2000):
        found = tables.stored(links(distinct))
    roots = components(found)
    classes = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id")
    least = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = classes.join(least, "root").select(F.col("fp").alias("class_fp"), "root", "component_id")
    return marked.join(classes, F.col("fp") == F.col("class_fp")).drop("class_fp")


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of every row of docs(doc_id, text)."""
    return groups(spark, docs).select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark, tables.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: the one with the smallest doc_id (nulls last), of equal ids one by hash.

    Rows that go, and rows of a uid that stands there more than once, are looked up by uid; texts move only where these
    are too many to broadcast. Of equal rows, which may differ in other columns, one stays.
    """
    rows = groups(spark, docs).groupBy("root", "uid").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("best")).select(F.col("best.uid").alias("kept"))
    uid, key, goes = (tables.spare_name(docs, name) for name in ("uid", "key", "goes"))
    # a uid has one root, so the rows that stay are found by uid, of which no group has many
    marked = rows.join(best, F.col("uid") == F.col("kept"), "left").select(F.col("uid").alias(key), F.col("kept").isNull().alias(goes), "n")
    told = tables.stored(marked.where(F.col(goes) | (F.col("n") > 1)).select(key, goes))
    few = told.count() <= BROADCAST_ROWS
    keyed = docs.withColumn(uid, uid_of("doc_id", "text"))
    known = keyed.join(F.broadcast(told) if few else told, F.col(uid) == F.col(key), "left")
    plain = known.where(F.col(key).isNull()).select(*[F.col(f"`{c}`") for c in docs.columns])
    again = known.where(~F.col(goes)).groupBy(uid).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias(key))
    return plain.unionAll(again.select(*[F.col(f"`{key}`.`{c}`").alias(c) for c in docs.columns]))
