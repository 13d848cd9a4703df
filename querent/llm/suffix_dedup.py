"""Operator 9: removal of every byte covered by a 200-byte string that starts more than once in the corpus.

Suffixes are sampled: each 200-byte window is represented by the place in it whose 96-byte string has the least hash,
so equal windows are represented alike wherever they stand, and windows that share a place form a run. The runs of a
shard are sorted as suffixes by deep-shallow sorting: multikey quicksort over eight-byte characters to a shallow depth,
then a blind trie for each group with a longer common prefix. Neighbours in that order that are equal over their whole
length are a class; classes of several runs are settled in the shard, and one run of each class goes on. Classes of all
shards meet by 64-bit hashes of the place's string: equal runs are repeated as a whole; runs that share only the place
are resolved window by window in a second exchange.

A class that stands in several shards of a sample (a fixed share of the texts, by hash) is known to be repeated: its runs
are settled wherever they are met, and only one of them, from the sample, goes on. So no place gathers a row from every
shard. Strings that are frequent within a shard are spread by their runs. What is removed does not depend on either.

Defined results: a null or empty text has no bytes; texts of less than 200 bytes lose nothing; repeated rows repeat
each other's strings; null doc_ids keep their rows; an empty table gives no rows; other columns are ignored. Strings
are compared by 64-bit hashes between shards, by bytes within one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.llm import tables
from querent.llm.textbatch import byte_sums, column_bytes, mix, recut, span_hash

LENGTH = 200
PLACE = 96
#: bytes of a shard's texts
SHARD_BYTES = 2 << 20
#: one of so many texts is in the sample; a class in so many of its shards is settled everywhere; classes in the list, at most
SAMPLE = 64
SAMPLE_SHARD_BYTES = 1 << 18
KNOWN_FROM = 4
KNOWN = 1 << 16
POSITION_BITS = 23
SEGMENT = 1 << 19
SHALLOW = 32
FREQUENT = 64

#: states of rows on their way to an exchange
ONE, MANY, SHARED, SEEN, SETTLED, MANY_SHARED = 0, 1, 2, 3, 4, 5
ROWS = "key long, f long, uid long, pos int, n int, state int"
FOUND = "uid long, pos int, n int, full boolean"


def runs(buf: np.ndarray, off: np.ndarray, sums: np.ndarray):
    """Runs of windows with one place: hash of the place's string, text, first window and number of windows."""
    span, out = LENGTH - PLACE + 1, []
    low = np.uint64((1 << POSITION_BITS) - 1)
    for base in range(0, max(0, len(buf) - LENGTH + 1), SEGMENT):
        end = min(len(buf), base + SEGMENT + LENGTH - 1)
        pos = np.arange(base, end - PLACE + 1)
        h = span_hash(sums, pos, pos + PLACE)
        # the leftmost of the least: places carry their position in the low bits
        least = (h & ~low) | (pos - base).astype(np.uint64)
        m = len(least)
        blocks = np.concatenate([least, np.full(-m % span, 2**64 - 1, np.uint64)]).reshape(-1, span)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(behind[: m - span + 1], ahead[span - 1 : m]) & low).astype(np.int64)
        s = np.arange(base, base + len(at))
        text = np.searchsorted(off, s, "right") - 1
        ok = s + LENGTH <= off[text + 1]
        s, at, text = s[ok], at[ok], text[ok]
        if not len(s):
            continue
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
        out.append((h[at[new]], text[new], s[new], np.diff(np.append(new, len(s)))))
    if not out:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    return tuple(np.concatenate(x) for x in zip(*out))


def characters(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each position as one character, in byte order."""
    out = np.zeros(len(at), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | buf[at + i].astype(np.uint64)
    return out


class BlindTrie:
    """Orders strings with a long common prefix: nodes keep only a depth and branching bytes, strings are compared once each."""

    def __init__(self, data: bytes, start: list[int], end: list[int]):
        self.data, self.start, self.end, self.root = data, start, end, None

    def byte(self, i: int, depth: int) -> int:
        at = self.start[i] + depth
        return self.data[at] if at < self.end[i] else -1

    def common(self, i: int, j: int) -> int:
        a, b = self.data[self.start[i] : self.end[i]], self.data[self.start[j] : self.end[j]]
        if a == b:
            return len(a)
        n = min(len(a), len(b))
        return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8

    def insert(self, i: int) -> None:
        """A leaf is a list of equal strings, an inner node a tuple (depth, children by byte)."""
        if self.root is None:
            self.root = [i]
            return
        node = self.root
        while type(node) is tuple:  # blindly down to some leaf
            node = node[1].get(self.byte(i, node[0])) or next(iter(node[1].values()))
        other = node[0]
        depth = self.common(i, other)
        if depth == self.end[i] - self.start[i] == self.end[other] - self.start[other]:
            node.append(i)
            return
        parent, key, node = None, None, self.root
        while type(node) is tuple and node[0] < depth:
            parent, key = node, self.byte(i, node[0])
            node = node[1][key]
        if type(node) is tuple and node[0] == depth:
            node[1][self.byte(i, depth)] = [i]
            return
        new = (depth, {self.byte(other, depth): node, self.byte(i, depth): [i]})
        if parent is None:
            self.root = new
        else:
            parent[1][key] = new

    def classes(self) -> list[list[int]]:
        """Lists of equal strings, in order."""
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if type(node) is tuple:
                todo += [node[1][k] for k in sorted(node[1], reverse=True)]
            else:
                out.append(node)
        return out


def deep_shallow(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings buf[start : start + size], none shorter than SHALLOW, and whether each equals the one before it."""
    order = np.argsort(characters(buf, start), kind="stable")
    same = np.zeros(len(order), bool)
    depth = 0
    key = characters(buf, start[order])
    same[1:] = key[1:] == key[:-1]
    while depth + 8 < SHALLOW and same.any():
        depth += 8
        tied = same.copy()
        tied[:-1] |= same[1:]
        at = np.flatnonzero(tied)
        group = np.cumsum(~same)[at]
        key = characters(buf, start[order[at]] + depth)
        by = np.lexsort((key, group))
        order[at] = order[at][by]
        same[at] = same[at] & np.concatenate([[False], (key[by][1:] == key[by][:-1]) & (group[1:] == group[:-1])])
    edge = np.flatnonzero(np.concatenate([~same, [True]]))
    deep = np.flatnonzero(np.diff(edge) > 1)
    if len(deep):
        data, first, last = buf.tobytes(), start.tolist(), (start + size).tolist()
        for a, b in zip(edge[deep].tolist(), edge[deep + 1].tolist()):
            trie = BlindTrie(data, first, last)
            for i in order[a:b].tolist():
                trie.insert(i)
            at = a
            for group in trie.classes():
                order[at : at + len(group)] = group
                same[at : at + len(group)] = True
                same[at] = False
                at += len(group)
    return order, same


def batch_of(key, f, uid, pos, n, state) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(f.view(np.int64)), pa.array(uid), pa.array(pos.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(state.astype(np.int32))], names=[x.split()[0] for x in ROWS.split(", ")])


def combined(place: np.ndarray, f: np.ndarray, uid: np.ndarray, pos: np.ndarray, n: np.ndarray, order: np.ndarray, same: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows for the exchange from runs in order of their content; classes of more than one are settled here and send one row."""
    edge = np.flatnonzero(np.concatenate([~same, [True]]))
    lead, count = order[edge[:-1]], np.diff(edge)
    state = np.where(count > 1, MANY, ONE)
    settled = order[np.repeat(count > 1, count)]
    if len(settled):
        yield settled_rows(uid[settled], pos[settled], n[settled])
    key = place[lead]
    _, inverse, classes = np.unique(key, return_inverse=True, return_counts=True)
    hot = classes[inverse] > FREQUENT
    if hot.any():
        # known to be shared: spread by content; one row tells other shards that the place is here
        one = np.unique(key[hot])
        yield batch_of(one, one, np.zeros(len(one), np.int64), np.zeros(len(one), np.int64), np.zeros(len(one), np.int64), np.full(len(one), SEEN))
        with np.errstate(over="ignore"):
            key = np.where(hot, mix(key ^ f[lead] * np.uint64(3)), key)
        state = np.where(hot, np.where(state == ONE, SHARED, MANY_SHARED), state)
    yield batch_of(key, f[lead], uid[lead], pos[lead], n[lead], state)


class Known:
    """Classes that the sample shows to be repeated, by place and content."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)

    def holds(self, place: np.ndarray, f: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(f), bool)
        key = class_key(place, f)
        return self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key


def class_key(place: np.ndarray, f: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(place ^ mix(f * np.uint64(0x9E3779B97F4A7C15)))


def settled_rows(uid: np.ndarray, pos: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Rows of runs that are known to be repeated; neighbouring runs of a text go on as one."""
    order = np.lexsort((pos, uid))
    u, p, e = uid[order], pos[order], (pos + n)[order]
    at = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (p[1:] > e[:-1])]))
    last = np.append(at[1:], len(u)) - 1
    k = mix(u[at].view(np.uint64))
    return batch_of(k, k, u[at], p[at], e[last] - p[at], np.full(len(at), SETTLED))


def shard_runs(known):
    """Rows of the runs of texts (uid, text), sorted shard by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in recut(batches, 1, SHARD_BYTES):
            buf, off = column_bytes(batch.column(1))
            ids, sums = np.asarray(batch.column(0)), byte_sums(buf)
            place, text, s, n = runs(buf, off, sums)
            f, uid, pos = span_hash(sums, s, s + n + (LENGTH - 1)), ids[text], s - off[text]
            there = known.value.holds(place, f)
            if there.any():
                yield settled_rows(uid[there], pos[there], n[there])
            rest = np.flatnonzero(~there)
            if len(rest):
                yield from combined(place[rest], f[rest], uid[rest], pos[rest], n[rest], *deep_shallow(buf, s[rest], n[rest] + (LENGTH - 1)))

    return run


def repeated_in_sample(spark: SparkSession, docs: DataFrame) -> tuple[Known, DataFrame]:
    """The classes that several shards of the sample share, and one row of each of them for the exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in recut(batches, 1, SAMPLE_SHARD_BYTES):
            buf, off = column_bytes(batch.column(1))
            ids, sums = np.asarray(batch.column(0)), byte_sums(buf)
            place, text, s, n = runs(buf, off, sums)
            f = span_hash(sums, s, s + n + (LENGTH - 1))
            _, first = np.unique(class_key(place, f), return_index=True)
            yield batch_of(place[first], f[first], ids[text[first]], (s - off[text])[first], n[first], np.full(len(first), MANY))

    rows = docs.where(F.pmod("uid", F.lit(SAMPLE)) == 0).mapInArrow(run, ROWS)
    one = F.min(F.struct("uid", "pos", "n")).alias("x")
    often = rows.groupBy("key", "f").agg(F.count(F.lit(1)).alias("shards"), one).where(F.col("shards") >= KNOWN_FROM).orderBy(F.desc("shards"), "key", "f").limit(KNOWN)
    found = tables.stored(often.select("key", "f", "x.uid", "x.pos", "x.n", F.lit(MANY).alias("state")))
    keys = found.select("key", "f").toPandas()  # at most KNOWN
    return Known(class_key(keys.key.to_numpy(np.int64).view(np.uint64), keys.f.to_numpy(np.int64).view(np.uint64))), found


def shard_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the single windows of texts (uid, z, edges) that are still open."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for i0 in range(0, batch.num_rows, 64):
            part = batch.slice(i0, 64)
            raw = [unpack.decompress(z, max_output_size=n) if n else b"" for z, n in zip(part.column(1).to_pylist(), part.column(3).to_pylist())]
            buf, off = column_bytes(pa.array(raw, pa.large_binary()))
            edges = part.column(2)
            lens = np.diff(np.asarray(edges.offsets))
            pos, n = np.asarray(edges.flatten().field(0)).astype(np.int64), np.asarray(edges.flatten().field(1)).astype(np.int64)
            text = np.repeat(np.arange(part.num_rows), lens)
            s = np.repeat(pos + off[text] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            text = np.repeat(text, n)
            if not len(s):
                continue
            f = span_hash(byte_sums(buf), s, s + LENGTH)
            order = np.argsort(f, kind="stable")
            same = np.concatenate([[False], f[order][1:] == f[order][:-1]])
            yield from combined(f, f, np.asarray(part.column(0))[text], s - off[text], np.ones(len(s), np.int64), order, same)


def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of key and f: what is repeated as a whole (full), and what shares its key with other runs.

    Where runs share a key, one of each class goes on, also of those that are settled: its windows may be another's.
    """

    def done(key, f, uid, pos, n, state):
        if not len(key):
            return None
        settled = state == SETTLED
        live = ~settled
        out = [(uid[settled], pos[settled], n[settled], np.ones(int(settled.sum()), bool))]
        key, f, uid, pos, n, state = (x[live] for x in (key, f, uid, pos, n, state))
        if len(key):
            new_key = np.concatenate([[True], key[1:] != key[:-1]])
            group = np.cumsum(new_key) - 1
            new = new_key | np.concatenate([[True], f[1:] != f[:-1]])
            in_key = np.bincount(group, weights=new)[group]  # classes of the key
            cls = np.cumsum(new) - 1
            many = np.bincount(cls, weights=np.where((state == MANY) | (state == MANY_SHARED), 2, state != SEEN))[cls] > 1
            full = many & ((state == ONE) | (state == SHARED))
            known = np.bincount(cls, weights=(state == SHARED) | (state == MANY_SHARED))[cls] > 0
            shared = new & (state != SEEN) & (known | (in_key > 1))
            for use, whole in ((full, True), (shared, False)):
                out.append((uid[use], pos[use], n[use], np.full(int(use.sum()), whole)))
        cols = [np.concatenate(x) for x in zip(*out)]
        return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1].astype(np.int32)), pa.array(cols[2].astype(np.int32)), pa.array(cols[3])], names=[x.split()[0] for x in FOUND.split(", ")])

    # rows of a key may come in several batches; they are put together once
    held: list[list[np.ndarray]] = []

    def put_together() -> pa.RecordBatch | None:
        cols = [np.concatenate(x) for x in zip(*held)]
        held.clear()
        return done(*cols)

    for batch in batches:
        cols = [np.asarray(batch.column(i)).astype(np.int64) for i in range(6)]
        key = cols[0]
        if not len(key):
            continue
        if held and held[-1][0][-1] != key[0] and (out := put_together()) is not None:
            yield out
        if key[0] != key[-1]:
            cut = int(np.flatnonzero(key != key[-1])[-1]) + 1
            held.append([x[:cut] for x in cols])
            if (out := put_together()) is not None:
                yield out
            cols = [x[cut:] for x in cols]
        held.append(cols)
    if held and (out := put_together()) is not None:
        yield out


def exchange(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key", "f").mapInArrow(resolve, FOUND)


def packed(docs: DataFrame) -> DataFrame:
    """docs(uid, text, ...) with the text as compressed bytes z of n_bytes, which later exchanges move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            buf, off = column_bytes(batch.column(1))
            data, o = buf.tobytes(), off.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack.compress(data[a:b]) for a, b in zip(o, o[1:])], pa.binary()), pa.array(np.diff(off)), *[batch.column(i) for i in range(2, batch.num_columns)]], names=["uid", "z", "n_bytes", *batch.schema.names[2:]])

    rest = [f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields[2:]]
    return docs.mapInArrow(run, ", ".join(["uid long, z binary, n_bytes long", *rest]))


def repeated(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """uid, spans: runs of repeated windows (first, number) of the texts of docs(uid, text) that have any."""
    docs = docs.select("uid", "text")
    known, samples = repeated_in_sample(spark, docs)
    rows = docs.mapInArrow(shard_runs(spark.sparkContext.broadcast(known)), ROWS)
    found = tables.stored(exchange(rows.unionAll(samples)))
    # equal rows share a uid and have the same runs, which count once; at most a text's windows
    edges = found.where("not full").groupBy("uid").agg(F.collect_set(F.struct("pos", "n")).alias("edges"))
    open_texts = packed(docs).join(edges, "uid").select("uid", "z", "edges", "n_bytes")
    windows = tables.stored(exchange(open_texts.mapInArrow(shard_windows, ROWS)).where("full"))
    tables.discard(spark, samples)
    return found.where("full").unionAll(windows).groupBy("uid").agg(F.collect_set(F.struct("pos", "n")).alias("spans"))


def without_spans(raw: bytes, spans: list) -> tuple[bytes, int, int]:
    """What is left of a text, the number of bytes removed and the number of maximal removed runs."""
    out, at, removed, count = [], 0, 0, 0
    for first, n in sorted(spans):
        end = first + n - 1 + LENGTH
        if first > at or not count:
            out.append(raw[at:first])
            count += 1
            removed += end - first
            at = end
        elif end > at:
            removed += end - at
            at = end
    out.append(raw[at:])
    return b"".join(out), removed, count


def deduplicate(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of every row of docs(doc_id, text)."""
    docs = tables.texts(docs).select(F.xxhash64("doc_id", "text").alias("uid"), "text", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            kept, removed, count = [], [], []
            for z, n, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                raw = unpack.decompress(z, max_output_size=n) if n else b""
                k, r, c = without_spans(raw, [(s["pos"], s["n"]) for s in spans or ()])
                kept.append(k)
                removed.append(r)
                count.append(c)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = packed(docs).join(repeated(spark, docs), "uid", "left").select("doc_id", "z", "n_bytes", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(spark, tables.table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their repeated strings (and what is left of a character that was cut); every row and column stays, n_chars counts anew."""
    uid, key, spans = (tables.spare_name(docs, name) for name in ("uid", "key", "spans"))
    keyed = docs.withColumn(uid, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    found = repeated(spark, keyed.select(F.col(uid).alias("uid"), F.col("text").cast("string").alias("text"))).select(F.col("uid").alias(key), F.col("spans").alias(spans))
    joined = keyed.join(found, F.col(uid) == F.col(key), "left").drop(uid, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, chars = batch.schema.get_field_index("text"), batch.schema.get_field_index("n_chars")
            values = batch.column(text).to_pylist()
            for i, s in enumerate(batch.column(spans).to_pylist()):
                if s:
                    values[i] = without_spans(values[i].encode(), [(x["pos"], x["n"]) for x in s])[0].decode("utf-8", "ignore")
            out = batch.set_column(text, batch.schema.field(text), pa.array(values, batch.schema.field(text).type))
            if chars >= 0 and pa.types.is_integer(batch.schema.field(chars).type):
                out = out.set_column(chars, batch.schema.field(chars), pa.array([None if v is None else len(v) for v in values], batch.schema.field(chars).type))
            yield out.drop_columns([spans])

    return joined.mapInArrow(run, docs.schema)
