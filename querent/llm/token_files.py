"""Operator 7: files of raw token ids with a minimal perfect hash index for constant-time access by document key.

A shard is one file below the shared folder: a fixed head, the raw ids of its documents, their offsets, their keys, and
an index. The index sends each distinct key to its own slot (bit arrays with counts of the bits before each word: a key
takes a bit that it alone hits, the others go on to the next, smaller array); a slot holds the key's fingerprint, its
first document and their number. Documents stand in ascending order over all shards, so a reader knows from the shards'
first and last keys where a key can be; it then reads some words of that file's index and the ids of the key's
documents, nothing else.

A shard's bytes follow from its documents alone. Files are written under names of their own and then moved to their
place, so a task that runs twice writes the same file twice, and the table of shards, which Spark commits, lists whole
files only. Workers reach the files through pyarrow's file systems.

Defined results: documents stand in ascending doc_id order, nulls first, equal ids by text; a null text counts as empty
and has its end id alone; repeated rows all stay, and a lookup gives all documents of a key, also over several shards;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querent.llm import tables
from querent.llm.bpe import word_bpe
from querent.llm.textbatch import column_bytes, mix, recut

END_ID = 1
#: texts that are encoded at once, and of a shard, in bytes
ENCODE_BYTES = 1 << 20
SHARD_BYTES = 16 << 20
GAMMA = 1.5
LEVELS = 24
NULL_KEY = 0x6E756C6C
MAGIC = b"QTOKENS2"
#: magic, width of an id, documents, ids, levels, slots by bits, keys outside the bits, and the places of the sections
HEAD = struct.Struct("<8sqqqqqq8q")
SECTIONS = ("payload", "offsets", "keys", "nulls", "sizes", "words", "last", "slots")
SLOT = np.dtype([("print", "<u4"), ("count", "<u4"), ("first", "<i8")])
WORD = np.dtype([("bits", "<u8"), ("before", "<u8")])

SHARDS = "part int, shard int, n_docs long, n_ids long, base long, first long, first_null boolean, last long, last_null boolean"


def key_hash(keys: pa.Array) -> np.ndarray:
    """64-bit hashes of nullable integer keys."""
    if isinstance(keys, pa.ChunkedArray):
        keys = keys.combine_chunks()
    null = np.asarray(keys.is_null())
    values = np.asarray(keys.fill_null(0)).astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        return np.where(null, mix(np.full(len(values), NULL_KEY, np.uint64)), mix(values * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)))


def slots_at(h: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(h + np.uint64(level + 1) * np.uint64(0xA0761D6478BD642F)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit hashes."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, last: np.ndarray):
        self.sizes, self.words, self.last = sizes, words, last
        self.begin = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    @classmethod
    def build(cls, h: np.ndarray) -> PerfectHash:
        sizes, parts, level = [], [], 0
        while len(h) and level < LEVELS:
            size = max(8, int(len(h) * GAMMA))
            at = slots_at(h, level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(alone)
            h = h[~alone[at]]
            level += 1
        flags = np.concatenate([np.zeros(0, bool), *parts])
        flags = np.concatenate([flags, np.zeros(-len(flags) % 64, bool)])
        words = np.zeros(len(flags) // 64, WORD)
        words["bits"] = np.packbits(flags, bitorder="little").view("<u8")
        ones = np.bitwise_count(words["bits"]).astype(np.int64)
        words["before"] = np.cumsum(ones) - ones
        return cls(np.array(sizes, np.int64), words, np.sort(h))

    @property
    def ones(self) -> int:
        return int(self.words["before"][-1] + np.bitwise_count(self.words["bits"][-1])) if len(self.words) else 0

    def slot(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash; a foreign hash gets some slot or -1, so fingerprints must be compared."""
        out = np.full(len(h), -1, np.int64)
        todo = np.arange(len(h))
        for level, size in enumerate(self.sizes.tolist()):
            at = self.begin[level] + slots_at(h[todo], level, size)
            word = self.words[at >> 6]
            hit, rank = probe(word["bits"], word["before"], at & 63)
            out[todo[hit]] = rank[hit]
            todo = todo[~hit]
        if len(todo) and len(self.last):
            at = np.minimum(np.searchsorted(self.last, h[todo]), len(self.last) - 1)
            hit = self.last[at] == h[todo]
            out[todo[hit]] = self.ones + at[hit]
        return out


def probe(bits: np.ndarray, before: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a word's bit is set, and the number of set bits before it."""
    bits, place = np.asarray(bits, np.uint64), np.asarray(place).astype(np.uint64)
    one = np.uint64(1)
    return (bits >> place & one).astype(bool), (before + np.bitwise_count(bits & ((one << place) - one))).astype(np.int64)


def fingerprint(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(h ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


def shard_bytes(keys: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> bytes:
    """A whole file."""
    h = key_hash(keys)
    distinct, first, count = np.unique(h, return_index=True, return_counts=True)
    index = PerfectHash.build(distinct)
    slot = index.slot(distinct)
    slots = np.zeros(len(slot), SLOT)
    slots["print"][slot], slots["first"][slot], slots["count"][slot] = fingerprint(distinct), first, count
    parts = [ids, offsets.astype("<i8"), np.asarray(keys.fill_null(0)).astype("<i8"), np.asarray(keys.is_null()).astype(np.uint8), index.sizes.astype("<i8"), index.words, index.last.astype("<u8"), slots]
    places, at = [], HEAD.size
    for x in parts:
        at += -at % 16
        places.append(at)
        at += x.nbytes
    out = bytearray(at)
    HEAD.pack_into(out, 0, MAGIC, ids.dtype.itemsize, len(keys), len(ids), len(index.sizes), index.ones, len(index.last), *places)
    for place, x in zip(places, parts):
        out[place : place + x.nbytes] = x.tobytes()
    return bytes(out)


class Shard:
    """A file that is open for reads of parts of it."""

    def __init__(self, file):
        self.file, self.bytes_read = file, 0
        magic, self.width, self.n_docs, self.n_ids, levels, self.ones, self.others, *places = HEAD.unpack(self._read(0, HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        self.at = dict(zip(SECTIONS, places))
        self.sizes = np.frombuffer(self._read(self.at["sizes"], 8 * levels), "<i8").tolist()

    def _read(self, at: int, n: int) -> bytes:
        self.bytes_read += n
        self.file.seek(at)
        return self.file.read(n)

    def _part(self, section: str, kind, first: int, n: int) -> np.ndarray:
        kind = np.dtype(kind)
        return np.frombuffer(self._read(self.at[section] + first * kind.itemsize, n * kind.itemsize), kind)

    def find(self, key: int | None) -> tuple[int, int]:
        """First document and number of documents of a key; 0 documents if it isn't here. Reads a word for each level that it tries."""
        h, begin, slot = key_hash(pa.array([key], pa.int64())), 0, -1
        for level, size in enumerate(self.sizes):
            at = begin + int(slots_at(h, level, size)[0])
            word = self._part("words", WORD, at >> 6, 1)
            hit, rank = probe(word["bits"], word["before"], np.array([at & 63]))
            if hit[0]:
                slot = int(rank[0])
                break
            begin += size
        else:  # the few keys that no level took
            others = self._part("last", "<u8", 0, self.others)
            at = int(np.searchsorted(others, h[0]))
            if at < len(others) and others[at] == h[0]:
                slot = self.ones + at
        if slot < 0:
            return 0, 0
        s = self._part("slots", SLOT, slot, 1)[0]
        return (int(s["first"]), int(s["count"])) if s["print"] == fingerprint(h)[0] else (0, 0)

    def documents(self, first: int, count: int) -> list[np.ndarray]:
        """The ids of consecutive documents."""
        off = self._part("offsets", "<i8", first, count + 1)
        ids = self._part("payload", f"<u{self.width}", int(off[0]), int(off[-1] - off[0]))
        return [ids[a:b] for a, b in zip((off - off[0]).tolist(), (off[1:] - off[0]).tolist())]

    def whole(self) -> tuple[pa.Array, np.ndarray, np.ndarray, PerfectHash, np.ndarray]:
        """Keys, ids, offsets, index and slots of the file."""
        keys = pa.array(self._part("keys", "<i8", 0, self.n_docs), mask=self._part("nulls", np.uint8, 0, self.n_docs).astype(bool))
        n = (sum(self.sizes) + 63) // 64
        index = PerfectHash(np.array(self.sizes, np.int64), self._part("words", WORD, 0, n), self._part("last", "<u8", 0, self.others))
        return keys, self._part("payload", f"<u{self.width}", 0, self.n_ids), self._part("offsets", "<i8", 0, self.n_docs + 1), index, self._part("slots", SLOT, 0, self.ones + self.others)


def place_of(folder: str, part: int, shard: int) -> str:
    return f"{folder}/{part:06d}-{shard:06d}.ids"


@dataclass
class TokenFiles:
    """A folder of shards and the table that lists them."""

    folder: str
    shards: DataFrame


def write_files(spark: SparkSession, docs: DataFrame, path: str, end_id: int = END_ID, shard_size: int = SHARD_BYTES) -> TokenFiles:
    """Encodes docs(doc_id, text) in ascending order into files."""
    docs = tables.texts(docs).withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc_nulls_first()]
    ordered = docs.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    folder = tables.shared_dir(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, shard, base = word_bpe(path), TaskContext.get().partitionId(), 0, 0
        keys, ids, lens, size = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal shard, base, keys, ids, lens, size
            key, flat = pa.concat_arrays(keys), np.concatenate(ids)
            store(place_of(folder, part, shard), shard_bytes(key, flat, np.concatenate([[0], np.cumsum(np.concatenate(lens))])))
            row = [part, shard, len(key), len(flat), base, key[0].as_py(), not key[0].is_valid, key[-1].as_py(), not key[-1].is_valid]
            shard, base, keys, ids, lens, size = shard + 1, base + len(flat), [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, SHARD_TYPES)], names=[c.split()[0] for c in SHARDS.split(", ")])

        for batch in recut(batches, 1, min(ENCODE_BYTES, shard_size)):
            buf, off = column_bytes(batch.column(1))
            flat, at = bpe.encode(buf, off)
            keys.append(batch.column(0))
            ids.append(np.insert(flat.astype(bpe.dtype), at[1:], bpe.dtype.type(end_id)))
            lens.append(np.diff(at) + 1)
            size += len(buf)
            if size >= shard_size:
                yield close()
        if keys:
            yield close()

    return TokenFiles(folder, tables.stored(ordered.mapInArrow(run, SHARDS)))


SHARD_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_()]


def store(uri: str, data: bytes) -> None:
    """Writes a file beside its place and moves it there."""
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    beside = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(beside) as out:
        out.write(data)
    system.move(beside, path)


def opened(uri: str):
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


class Reader:
    """Access by key to the documents of token files; holds the shards' first and last keys (some 40 bytes for each file)."""

    def __init__(self, files: TokenFiles, keep_open: int = 64):
        rows = sorted(files.shards.collect(), key=lambda r: (r.part, r.shard))
        self.folder, self.keep_open, self.bytes_read = files.folder, keep_open, 0
        self.places = [(r.part, r.shard) for r in rows]
        rank = lambda null, key: (not null, key or 0)  # noqa: E731  nulls stand first
        self.last = [rank(r.last_null, r.last) for r in rows]
        self.first = [rank(r.first_null, r.first) for r in rows]
        self.held: dict[int, Shard] = {}

    def _shard(self, i: int) -> Shard:
        if i not in self.held:
            while len(self.held) >= self.keep_open:
                self.held.pop(next(iter(self.held))).file.close()
            self.held[i] = Shard(opened(place_of(self.folder, *self.places[i])))
            self.bytes_read += self.held[i].bytes_read
        return self.held[i]

    def get(self, key: int | None) -> list[np.ndarray]:
        """The ids of all documents of a key."""
        rank, out = (key is not None, key or 0), []
        i = bisect_left(self.last, rank)
        while i < len(self.places) and self.first[i] <= rank:
            shard = self._shard(i)
            before = shard.bytes_read
            first, count = shard.find(key)
            if count:
                out += shard.documents(first, count)
            self.bytes_read += shard.bytes_read - before
            i += 1
        return out


def lookup(files: TokenFiles, keys: list[int | None]) -> dict[int | None, list[np.ndarray]]:
    """The ids of all documents of each key, of which only the bytes of these documents and some index words are read."""
    reader = Reader(files)
    return {k: reader.get(k) for k in keys}


def read_documents(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of every document, each found by its key through the index."""
    per = files.shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # one row for each partition of the writer
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    start = per.select(F.col("part").alias("of"), F.coalesce(before, F.lit(0)).alias("start"))
    folder = files.folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, base in zip(*(batch.column(k).to_pylist() for k in range(3))):
                with opened(place_of(folder, part, number)) as file:
                    keys, ids, offsets, index, slots = Shard(file).whole()
                h = key_hash(keys)
                slot = slots[index.slot(h)]
                if not (slot["print"] == fingerprint(h)).all():
                    raise ValueError("a key of this shard isn't in its index")
                # equal keys stand together: the n-th row of a key is its n-th document
                at, first = np.arange(len(keys)), slot["first"].astype(np.int64)
                run_start = np.maximum.accumulate(np.where(np.concatenate([[True], first[1:] != first[:-1]]), at, 0))
                doc = first + (at - run_start)
                begin, end = offsets[doc], offsets[doc + 1]
                for lo in range(0, len(keys), 4096):
                    some = slice(lo, lo + 4096)
                    raw = [ids[a:b].astype("<u4").tobytes() for a, b in zip(begin[some].tolist(), end[some].tolist())]
                    yield pa.RecordBatch.from_arrays([keys[some], pa.array(base + begin[some]), pa.array((end - begin)[some]), pa.array(raw, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    rows = files.shards.join(start, F.col("part") == F.col("of")).select("part", "shard", (F.col("start") + F.col("base")).alias("base"))
    return rows.repartition("part", "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = write_files(spark, tables.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return read_documents(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
