"""Operator 6: benchmark decontamination with an FM-index per training shard.

Each shard's words that occur in the benchmark are numbered; runs of them that are long enough for a phrase form the
shard's text, with separators of their own order between them. Its suffix array gives the Burrows-Wheeler transform,
kept in a wavelet matrix. All benchmark windows are searched backwards at once, occurrences are located by walking to
sampled suffix positions, and the spans of hit words are merged.

Defined results: null and empty texts have no words; items without words never occur; repeated items and rows count as
they are (an item id counts once); a null item_id counts as one item with an empty name; empty tables give no rows or no
hits; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.llm import tables
from querent.llm.textbatch import IS_ALNUM, LOWER, byte_sums, column_bytes, expand, owner, pieces, span_hash, sums_by, words

WINDOW = 10
SAMPLE = 8
SHARD_BYTES = 2 << 20
#: benchmark text that is broadcast at once; a larger benchmark is searched in blocks
BLOCK_BYTES = 16 << 20

SCHEMA = "doc_id long, n_words long, spans array<struct<start:long,stop:long,words:long>>, items array<string>"


class Phrases:
    """The distinct windows of benchmark items, as numbers of the benchmark's words."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int = WINDOW):
        buf, off = column_bytes(pa.array(texts, pa.large_string()))
        buf = LOWER[buf]
        starts, ends, of = words(buf, off, IS_ALNUM)
        h = span_hash(byte_sums(buf), starts, ends)
        self.vocabulary, number = np.unique(h, return_inverse=True)
        rows: dict[tuple, set] = {}
        for i in range(len(ids)):
            w = (number[of[i] : of[i + 1]] + 1).tolist()
            for k in range(max(1, len(w) - window + 1) if w else 0):
                rows.setdefault(tuple(w[k : k + window]), set()).add(i)
        self.names = ids
        self.by_length: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        for n in sorted({len(p) for p in rows}):
            some = [p for p in rows if len(p) == n]
            self.by_length[n] = np.array(some, np.int64).reshape(-1, n), [sorted(rows[p]) for p in some]
        self.shortest = min(self.by_length, default=0)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Numbers of words by hash, from 1; 0 for words that the benchmark hasn't."""
        if not len(self.vocabulary):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at + 1, 0)


class Wavelet:
    """Wavelet matrix: the number of times a symbol stands before a position, for arrays of both."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.zeros, self.ranks = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.ranks.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        begin = np.zeros_like(position)
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            r, z = self.ranks[k], self.zeros[k]
            position = np.where(one, z + r[position], position - r[position])
            begin = np.where(one, z + r[begin], begin - r[begin])
        return position - begin


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of text, in which each 0 is a separator of its own, ordered by position; by prefix doubling."""
    n = len(text)
    mark = text == 0
    rank = np.where(mark, np.cumsum(mark) - 1, text + mark.sum() - 1)
    step = 1
    order = np.argsort(rank, kind="stable")
    while True:
        if step > 1:
            second = np.full(n, -1, np.int64)
            second[: n - step // 2] = rank[step // 2 :]
            order = np.lexsort((second, rank))
            same = (rank[order][1:] == rank[order][:-1]) & (second[order][1:] == second[order][:-1])
        else:
            same = rank[order][1:] == rank[order][:-1]
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum(~same)
        rank = new
        if not same.any():
            return order
        step *= 2


class FmIndex:
    def __init__(self, text: np.ndarray, symbols: int):
        """text: numbers from 1 with a 0 after each run."""
        order = suffix_array(text)
        self.bwt = text[order - 1]
        self.tree = Wavelet(self.bwt, max(1, int(symbols).bit_length()))
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        # rows whose suffix position is kept: every SAMPLE-th position, and the first ones of runs
        self.kept = (order % SAMPLE == 0) | (self.bwt == 0)
        self.place = np.cumsum(self.kept) - 1
        self.positions = order[self.kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of rows for phrases of one length, all symbols backwards."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.bwt), np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[:, k]
            lo, hi = self.less[c] + self.tree.rank(c, lo), self.less[c] + self.tree.rank(c, hi)
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps, todo = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        while len(todo):
            hit = self.kept[rows]
            out[todo[hit]] = self.positions[self.place[rows[hit]]] + steps
            rows, todo = rows[~hit], todo[~hit]
            c = self.bwt[rows]
            rows, steps = self.less[c] + self.tree.rank(c, rows), steps + 1
        return out


def occurrences(phrases: Phrases, number: np.ndarray, of: np.ndarray):
    """For numbered words of texts: arrays of the first word, the number of words and the phrase (length, index) of each occurrence."""
    none = np.zeros(0, np.int64)
    inside = np.zeros(len(number) + 2, bool)
    inside[1:-1] = number > 0
    cut = np.zeros(len(number) + 1, bool)
    cut[of] = True
    begin = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    long = end - begin >= max(1, phrases.shortest)
    begin, size = begin[long], (end - begin)[long]
    if not phrases.by_length or not len(begin):
        return none, none, none
    word = expand(begin, size + 1)  # the place after a run is its separator
    text = np.append(number, 0)[np.minimum(word, len(number))]
    text[np.cumsum(size + 1) - 1] = 0
    index = FmIndex(text, len(phrases.vocabulary))
    first, length, which = [], [], []
    for n, (rows, _) in phrases.by_length.items():
        lo, hi = index.search(rows)
        count = hi - lo
        at = word[index.locate(expand(lo, count))]
        first.append(at)
        length.append(np.full(len(at), n))
        which.append(np.repeat(np.arange(len(rows)), count))
    return np.concatenate(first), np.concatenate(length), np.concatenate(which)


class Found:
    """What a shard's index finds: for each occurrence its text, first word in the text, number of words and item names."""

    def __init__(self, phrases: Phrases, raw: np.ndarray, off: np.ndarray):
        buf, n = LOWER[raw], len(off) - 1
        starts, ends, of = words(buf, off, IS_ALNUM)
        text_of = owner(of)
        first, length, which = occurrences(phrases, phrases.numbers(span_hash(byte_sums(buf), starts, ends)), of)
        self.text, self.first, self.length = text_of[first], first - of[text_of[first]], length
        self.items: list[set[str]] = [set() for _ in range(n)]
        for d, size, w in set(zip(self.text.tolist(), length.tolist(), which.tolist())):
            self.items[d].update(phrases.names[i] for i in phrases.by_length[size][1][w])


class Spans:
    """Merged spans of hit words: for each text its number of words, and (first byte, byte after the last, words) of each span."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, text: np.ndarray, first: np.ndarray, length: np.ndarray):
        starts, ends, of = words(LOWER[raw], off, IS_ALNUM)
        cover = np.zeros(len(starts) + 1, np.int64)
        first = first + of[text]
        np.add.at(cover, first, 1)
        np.add.at(cover, first + length, -1)
        hit = np.concatenate([[False], np.cumsum(cover)[:-1] > 0, [False]])
        cut = np.zeros(len(starts) + 1, bool)
        cut[of] = True
        a = np.flatnonzero(hit[1:] & (~hit[:-1] | cut))
        b = np.flatnonzero(hit[:-1] & (~hit[1:] | cut))
        self.words = np.diff(of)
        self.spans: list[list[tuple[int, int, int]]] = [[] for _ in range(len(off) - 1)]
        for d, x, y in zip(owner(of)[a].tolist(), a.tolist(), b.tolist()):
            self.spans[d].append((int(starts[x] - off[d]), int(ends[y - 1] - off[d]), y - x))


HIT = "array<struct<first:long,length:long>>"


def block_hits(docs: DataFrame, block) -> DataFrame:
    """uid, hits (first word, words) and items of the rows of docs(uid, text) in which phrases of a broadcast block occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, off in pieces(batch.column(1), SHARD_BYTES):
                found = Found(block.value, raw, off)
                hits: dict[int, list] = {}
                for d, k, n in zip(found.text.tolist(), found.first.tolist(), found.length.tolist()):
                    hits.setdefault(d, []).append({"first": k, "length": n})
                keys = sorted(hits)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi].take(pa.array(keys, pa.int64())), pa.array([hits[d] for d in keys], pa.list_(pa.struct([("first", pa.int64()), ("length", pa.int64())]))), pa.array([sorted(found.items[d]) for d in keys], pa.list_(pa.string()))],
                    names=["uid", "hits", "items"],
                )

    return docs.mapInArrow(run, f"uid long, hits {HIT}, items array<string>")


def benchmark_blocks(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """The distinct items (name, text), and the number of blocks of about BLOCK_BYTES that hold them."""
    items = tables.texts(benchmark, "item_id").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), "text").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    return items, 1 + size // BLOCK_BYTES


def block_of(spark: SparkSession, items: DataFrame, k: int, count: int):
    rows = items.where(F.pmod(F.xxhash64("name", "text"), F.lit(count)) == k).sort("name", "text").collect()  # about BLOCK_BYTES
    return spark.sparkContext.broadcast(Phrases([r.name for r in rows], [r.text for r in rows]))


def with_spans(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text: str, work, schema: str) -> DataFrame:
    """work(batch, spans, items) on every batch of docs, with the spans and items of each row's text.

    A benchmark of one block is broadcast and searched where the texts are read. A larger one is searched block by block,
    one pass and one broadcast at a time; what the passes find joins the rows at the end.
    """
    items, count = benchmark_blocks(benchmark)
    if count == 1:
        block = block_of(spark, items, 0, 1)

        def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi, raw, off in pieces(batch.column(text), SHARD_BYTES):
                    found = Found(block.value, raw, off)
                    yield work(batch.slice(lo, hi - lo), Spans(raw, off, found.text, found.first, found.length), [sorted(x) for x in found.items])

        return docs.mapInArrow(at_once, schema)
    uid, key, hits, names = (tables.spare_name(docs, n) for n in ("uid", "key", "hits", "items"))
    keyed = docs.withColumn(uid, F.xxhash64(F.col(text)))
    parts = []
    for k in range(count):
        block = block_of(spark, items, k, count)
        parts.append(tables.stored(block_hits(keyed.select(F.col(uid).alias("uid"), F.col(text).cast("string").alias("text")), block)))
        block.unpersist()
    every = functools.reduce(DataFrame.unionAll, parts).groupBy("uid").agg(F.flatten(F.collect_set("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    joined = keyed.join(every.select(F.col("uid").alias(key), F.col("hits").alias(hits), F.col("items").alias(names)), F.col(uid) == F.col(key), "left").drop(uid, key)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some, found = batch.column(hits).to_pylist(), batch.column(names).to_pylist()
            rows = batch.drop_columns([hits, names])
            for lo, hi, raw, off in pieces(batch.column(text), SHARD_BYTES):
                flat = [(d, x["first"], x["length"]) for d, of in enumerate(some[lo:hi]) for x in of or ()]
                at, first, length = np.array(flat, np.int64).reshape(-1, 3).T
                yield work(rows.slice(lo, hi - lo), Spans(raw, off, at, first, length), [sorted(x or ()) for x in found[lo:hi]])

    return joined.mapInArrow(merged, schema)


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, items and spans of every row of docs(doc_id, text); spans are byte ranges of its text."""

    def work(batch: pa.RecordBatch, found: Spans, items: list[list[str]]) -> pa.RecordBatch:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("words", pa.int64())]))
        spans = [[dict(zip(("start", "stop", "words"), s)) for s in of] for of in found.spans]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.words), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "n_words", "spans", "items"])

    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s.words)
    return with_spans(spark, tables.texts(docs), benchmark, "text", work, SCHEMA).select("doc_id", "n_words", n_hit.alias("n_hit"), "items", "spans")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(spark, tables.table(spark, sf_dir, "documents"), tables.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: the same in SQL (words by RE2, windows by position)
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, k, k + least(len(w), 10) - 1), ' ') AS phrase
      FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM p),
g AS (SELECT r, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS phrase FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(k) WHERE len(w) >= n),
o AS (SELECT g.r, g.k, g.n, p.item FROM g JOIN p USING (n, phrase)),
h AS (SELECT r, count(DISTINCT i) AS n_hit FROM (SELECT DISTINCT r, k, n FROM o), unnest(range(k, k + n)) AS t(i) GROUP BY r),
m AS (SELECT r, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM o GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN m USING (r)
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Hit words go from their texts, with what stands between the words of a span; every row and column stays, n_chars counts anew."""

    def work(batch: pa.RecordBatch, found: Spans, items: list[list[str]]) -> pa.RecordBatch:
        text, chars = batch.schema.get_field_index("text"), batch.schema.get_field_index("n_chars")
        values = batch.column(text).to_pylist()
        for i, spans in enumerate(found.spans):
            if spans:
                whole, out, at = values[i].encode(), [], 0
                for first, last, _ in spans:
                    out.append(whole[at:first])
                    at = last
                values[i] = b"".join([*out, whole[at:]]).decode("utf-8")
        out = batch.set_column(text, batch.schema.field(text), pa.array(values, batch.schema.field(text).type))
        if chars >= 0 and pa.types.is_integer(batch.schema.field(chars).type):
            out = out.set_column(chars, batch.schema.field(chars), pa.array([None if v is None else len(v) for v in values], batch.schema.field(chars).type))
        return out

    return with_spans(spark, docs, tables.table(spark, sf_dir, "benchmark"), "text", work, docs.schema)
