"""Operator 10: token counts of whole texts by a two-tier lookup on the map side.

Tier 1 is a broadcast compact hash table with the token counts of frequent pre-tokens; tier 2 encodes the misses with
the library itself, once per distinct pre-token and worker cache. No pre-token is ever shuffled.

Defined results: a null text counts as empty (0 bytes, 0 tokens); null doc_ids and repeated rows keep their own rows;
an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.llm import tables
from querent.llm.textbatch import byte_sums, pieces, span_hash, sums_by

#: the broadcast table holds at most so many pre-tokens, taken from so many texts of the first partitions; this only sets its hit rate
TABLE_ENTRIES = 1 << 16
SAMPLE_TEXTS = 4000
SAMPLE_PARTITIONS = 32
CACHE_ENTRIES = 500_000
LIMIT = 4096
MARK = "▁".encode()


class LengthTable:
    """Open-addressing table from 64-bit hashes to token counts, in two flat arrays."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.bits = max(4, int(max(1, len(keys)) * 4 - 1).bit_length())
        self.keys, self.counts = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.reach = 0
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        left, step = np.arange(len(keys)), 0
        while len(left):
            at = (slot[left] + step) & ((1 << self.bits) - 1)
            _, firsts = np.unique(at, return_index=True)
            free = firsts[self.keys[at[firsts]] == 0]
            self.keys[at[free]], self.counts[at[free]] = keys[left[free]], counts[left[free]]
            left = np.delete(left, free)
            step += 1
        self.reach = step

    def get(self, h: np.ndarray) -> np.ndarray:
        """Counts, -1 where a hash is not held."""
        out = np.full(len(h), -1, np.int64)
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(h))
        for step in range(self.reach):
            at = (slot[todo] + step) & ((1 << self.bits) - 1)
            found = self.keys[at]
            hit = found == h[todo]
            out[todo[hit]] = self.counts[at[hit]]
            todo = todo[~hit & (found != 0)]
            if not len(todo):
                break
        return out


def pretokens(buf: np.ndarray, off: np.ndarray):
    """Adds the space before each text that is not empty, and cuts before each run of spaces and around line feeds.

    No vocabulary piece holds a space after another character or a line feed, so pre-tokens are encoded apart.
    Returns the longer buffer, starts, ends and the offsets of each text's pre-tokens.
    """
    sizes = np.diff(off)
    full = sizes > 0
    added = np.cumsum(full)
    out_off = off + np.concatenate([[0], added])
    out = np.full(len(buf) + int(full.sum()), 32, np.uint8)
    keep = np.ones(len(out), bool)
    keep[out_off[:-1][full]] = False
    out[keep] = buf
    space, feed = out == 32, out == 10
    begin = np.zeros(len(out), bool)
    begin[out_off[:-1][full]] = True
    if len(out):
        begin[1:] |= (space[1:] & ~space[:-1]) | feed[1:] | feed[:-1]
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], len(out)) if len(starts) else starts
    return out, starts, ends, np.searchsorted(starts, out_off)


@functools.lru_cache(maxsize=2)
def library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Counter:
    def __init__(self, path: str, table: tuple[np.ndarray, np.ndarray] | None = None):
        self.model = library(path)
        self.table = LengthTable(*table) if table is not None else None
        self.cache: dict[int, int] = {}

    def encoded(self, spans: list[bytes]) -> np.ndarray:
        """Token counts of pre-tokens; the library adds a space in front, which those after a line feed do not have."""
        given = [s[1:] if s[:1] == b" " else b"\n" + s for s in spans]
        got = self.model.encode([g.decode("utf-8", "replace") for g in given], num_threads=1)
        return np.array([len(x) + (1 if s == b" " else 0) - (0 if s[:1] == b" " else 2) for x, s in zip(got, spans)], np.int64)

    def distinct(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray):
        """Distinct hashes with their counts, by tier 2."""
        u, at, inverse, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        out = np.fromiter((self.cache.get(x, -1) for x in u.tolist()), np.int64, len(u))
        new = np.flatnonzero(out < 0)
        if len(new):
            data = buf.tobytes()
            out[new] = self.encoded([data[a:b] for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist())])
            if len(self.cache) + len(new) > CACHE_ENTRIES:
                self.cache.clear()
            self.cache.update(zip(u[new].tolist(), out[new].tolist()))
        return u, n, inverse, out

    def counts(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        out, starts, ends, of = pretokens(buf, off)
        if not len(out):
            return np.zeros(len(off) - 1, np.int64)
        h = span_hash(byte_sums(out), starts, ends) | np.uint64(1)
        got = self.table.get(h) if self.table else np.full(len(h), -1, np.int64)
        miss = np.flatnonzero(got < 0)
        if len(miss):
            _, _, inverse, found = self.distinct(out, starts[miss], ends[miss], h[miss])
            got[miss] = found[inverse]
        result = sums_by(got, of)
        data = buf.tobytes()
        if MARK in data:  # the library's own sign for a space, met in a text
            for i in range(len(off) - 1):
                if MARK in data[off[i] : off[i + 1]]:
                    result[i] = len(self.model.encode(data[off[i] : off[i + 1]].decode("utf-8", "replace")))
        return result


def frequent(spark: SparkSession, docs: DataFrame, path: str, entries: int = TABLE_ENTRIES, texts: int = SAMPLE_TEXTS):
    """The tier-1 table: hashes and token counts of the most frequent pre-tokens of a bounded number of texts.

    Only the first partitions are read, few at a time, until there are enough texts; a full scan would only serve a cache.
    """

    def count(rows: Iterator) -> list[tuple[int, list]]:
        counter, total, seen = Counter(path), {}, 0
        while batch := [r.text for r in itertools.islice(rows, min(200, texts - seen))]:
            seen += len(batch)
            for _, _, buf, off in pieces(pa.array(batch, pa.large_string())):
                out, starts, ends, _ = pretokens(buf, off)
                if len(out):
                    u, n, _, got = counter.distinct(out, starts, ends, span_hash(byte_sums(out), starts, ends) | np.uint64(1))
                    for k, x, c in zip(u.tolist(), n.tolist(), got.tolist()):
                        total[k] = (total.get(k, (0,))[0] + x, c)
        best = sorted(total.items(), key=lambda kv: (-kv[1][0], kv[0]))[:entries]
        return [(seen, [(k, n, c) for k, (n, c) in best])]

    source = docs.select("text").rdd
    parts, at, step, seen, total = source.getNumPartitions(), 0, 1, 0, {}
    while at < min(parts, SAMPLE_PARTITIONS) and seen < texts:
        for n, rows in spark.sparkContext.runJob(source, count, list(range(at, min(at + step, parts)))):
            seen += n
            for k, x, c in rows:
                total[k] = (total.get(k, (0,))[0] + x, c)
        at, step = at + step, step * 2
    best = sorted(total.items(), key=lambda kv: (-kv[1][0], kv[0]))[:entries]
    return np.array([k for k, _ in best], np.uint64), np.array([v[1] for _, v in best], np.int32)


def token_counts(spark: SparkSession, docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs(doc_id, text)."""
    docs = tables.texts(docs)
    shared = spark.sparkContext.broadcast(frequent(spark, docs, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, shared.value)
        for batch in batches:
            for lo, hi, buf, off in pieces(batch.column(1)):
                n = counter.counts(buf, off)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(np.diff(off)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark, tables.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", F.col("n_bytes"), "n_tokens", "over_limit")
