"""Operator 5: hierarchical multi-length packing of token sequences.

Documents are routed by what is left of them after whole long windows to tiers of context sizes. Each tier's windows
are opened by its own documents, longest first; gaps are filled with whole documents of the same or shorter tiers,
best fit first, and the last gap with a cut piece. What is left goes on to the next documents of the same task; at its
end the rest becomes windows of smaller powers of two, so that no window is padded. Windows of one size, of all tasks,
are dealt into step groups of equal numbers of tokens; only the last group of a size may be smaller.

Every task packs the texts that it reads, some megabytes at a time wherever Arrow batches end: no shuffle of texts,
bounded memory, and a lost task is simply run again with the same result. Step groups need the numbers of windows of
each task, so pieces are written before they are numbered.

Defined results: a null text counts as empty and gives its end id alone; null doc_ids and repeated rows keep their own
pieces; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querent.llm import tables
from querent.llm.bpe import word_bpe
from querent.llm.textbatch import column_bytes, recut

WINDOW = 4096
TIERS = (512, 1024, 2048, WINDOW)
STEP_TOKENS = 16 * WINDOW
END_ID = 2
BATCH_BYTES = 2 << 20

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length long, tier int, task long, number long"

Segment = tuple[int, int, int]  # document, start, length


def plan(segments: list[Segment], tiers: tuple[int, ...] = TIERS, last: bool = True) -> tuple[list[list[Segment]], list[Segment]]:
    """Windows for parts of documents, as lists of pieces, each window's length a power of two; and what is left, nothing if these are the last."""
    window = tiers[-1]
    windows: list[list[Segment]] = []
    pools: list[list[tuple[int, int, int]]] = [[] for _ in tiers]  # by tier: (length, document, start), ascending
    for d, start, n in segments:
        whole = n // window * window
        windows += [[(d, start + s, window)] for s in range(0, whole, window)]
        if n > whole:
            pools[bisect_right(tiers, n - whole - 1)].append((n - whole, d, start + whole))
    for pool in pools:
        pool.sort()

    def fill(gap: int, upto: int, out: list[Segment]) -> int:
        """Fills a gap from tier `upto` and shorter ones; returns what stays open, 0 unless all pools are empty."""
        while gap:
            best = None
            for t in range(upto, -1, -1):
                at = bisect_right(pools[t], (gap, 1 << 62, 0)) - 1
                if at >= 0:
                    best = t, at
                    break
            if best:
                n, d, s = pools[best[0]].pop(best[1])
                out.append((d, s, n))
                gap -= n
                continue
            t = next((t for t in range(upto + 1) if pools[t]), None)
            if t is None:
                return gap
            n, d, s = pools[t].pop(0)  # the shortest of those longer than the gap is cut
            out.append((d, s, gap))
            insort(pools[bisect_right(tiers, n - gap - 1)], (n - gap, d, s + gap))
            gap = 0
        return 0

    rest: list[Segment] = []
    for t in range(len(tiers) - 1, -1, -1):
        while pools[t]:
            n, d, s = pools[t].pop()
            out = [(d, s, n)]
            if fill(tiers[t] - n, t, out):
                rest += out
            else:
                windows.append(out)
    # smaller powers of two at the end
    while last and (total := sum(n for _, _, n in rest)):
        size = min(window, 1 << (total.bit_length() - 1))
        out, room = [], size
        while room:
            d, s, n = rest.pop(0)
            take = min(n, room)
            out.append((d, s, take))
            room -= take
            if n > take:
                rest.insert(0, (d, s + take, n - take))
        windows.append(out)
    return windows, rest


class Packer:
    """A task's windows: takes documents, gives pieces, and keeps what is left of them for the next ones."""

    def __init__(self, task: int, tiers: tuple[int, ...]):
        self.task, self.tiers, self.windows = task, tiers, 0
        self.numbers: dict[int, int] = {}
        self.ids: list[np.ndarray] = []
        self.keys: list[int | None] = []
        self.open: list[Segment] = []

    def add(self, keys: list, ids: list[np.ndarray], last: bool) -> pa.RecordBatch | None:
        segments = self.open + [(len(self.ids) + i, 0, len(x)) for i, x in enumerate(ids)]
        self.ids += ids
        self.keys += keys
        windows, rest = plan(segments, self.tiers, last)
        rows, parts = [], []
        for w in windows:
            size, used = sum(x[2] for x in w), 0
            number = self.numbers.get(size, 0)
            self.numbers[size] = number + 1
            for d, s, k in w:
                rows.append((self.keys[d], s, k, len(self.ids[d]), (self.task << 40) + self.windows, used, size, size, self.task, number))
                parts.append(self.ids[d][s : s + k])
                used += k
            self.windows += 1
        # documents that are done go
        live = sorted({d for d, _, _ in rest})
        place = {d: i for i, d in enumerate(live)}
        self.open = [(place[d], s, n) for d, s, n in rest]
        self.ids, self.keys = [self.ids[d] for d in live], [self.keys[d] for d in live]
        if not rows:
            return None
        key, start, length, tokens, sequence, offset, size, tier, task, number = zip(*rows)
        offsets = np.concatenate([[0], np.cumsum([4 * len(x) for x in parts])]).astype(np.int32)
        payload = pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(parts).astype("<u4"))])
        long = lambda x: pa.array(x, pa.int64())
        return pa.RecordBatch.from_arrays([long(key), long(start), long(length), payload, long(tokens), long(sequence), long(offset), long(size), pa.array(tier, pa.int32()), long(task), long(number)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def pack(spark: SparkSession, docs: DataFrame, path: str, end_id: int = END_ID, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """Pieces of every row of docs(doc_id, text), with their ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, packer = word_bpe(path), Packer(TaskContext.get().partitionId(), tiers)
        for batch in recut(batches, 1, BATCH_BYTES):
            flat, at = bpe.encode(*column_bytes(batch.column(1)))
            ids = np.insert(flat.astype("<u4"), at[1:], np.uint32(end_id))
            at = at + np.arange(len(at))
            # copies, so that what is left of a document does not hold the whole batch
            if (out := packer.add(batch.column(0).to_pylist(), [ids[a:b].copy() for a, b in zip(at.tolist(), at[1:].tolist())], False)) is not None:
                yield out
        if (out := packer.add([], [], True)) is not None:
            yield out

    return tables.texts(docs).mapInArrow(run, SCHEMA)


def step_groups(pieces_of: DataFrame, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """Pieces (as stored) with step_group: windows of one size and, but for the last of a size, step_tokens tokens."""
    per = pieces_of.where("offset = 0").groupBy("sequence_length", "task").agg(F.count(F.lit(1)).alias("n"))
    # one row for each task and size, at most 13 sizes
    before = F.sum("n").over(Window.partitionBy("sequence_length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    first = per.select(F.col("sequence_length").alias("size"), F.col("task").alias("of"), F.coalesce(before, F.lit(0)).alias("first"))
    index = F.col("first") + F.col("number")
    size = F.col("sequence_length")
    group = F.shiftleft(size, 40) + F.floor(index / F.greatest(F.lit(1), F.floor(F.lit(step_tokens) / size))).cast("long")
    return pieces_of.join(first, (size == F.col("size")) & (F.col("task") == F.col("of"))).withColumn("step_group", group).drop("size", "of", "first", "task", "number")


def digest(pieces_of: DataFrame) -> DataFrame:
    return step_groups(tables.stored(pieces_of.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "tier", "step_group")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(pack(spark, tables.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents."""
    import public_tokenizers

    return digest(pack(spark, docs, public_tokenizers.path("word_bpe_49k.json")))
