"""Operator 2: toxicity by the nearest labelled examples.

Examples and texts are unit TF-IDF vectors over all words and word beginnings of the examples (others weigh nothing);
document frequencies come from all texts. A term's weight also rises with how clearly the examples' labels single it
out, by a factor between FLOOR and 1; no term is left out. The nearest examples by exact cosine are found in an inverted
index: terms of many examples have whole rows of weights, which give a first part of every cosine; all other terms have
postings in blocks of examples with the largest weight of each block. Blocks are visited by falling upper bound until no
block can hold a nearer example. Neighbours vote by distance; votes are calibrated by leaving each example out, and
returned with the neighbours as evidence.

Defined results: null and empty texts, and texts without any word of the examples, get the examples' share of toxic
ones; null doc_ids count as not held out; repeated rows each have their own row; equally near examples are taken in the
index's order; without labelled rows the score is 0, with labels of one kind it is their value; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.llm import packed, tables
from querent.llm.quality import platt
from querent.llm.textbatch import IS_ALNUM, LOWER, byte_sums, expand, give_memory_back, joined, mix, owner, pieces, span_hash, words

#: examples in the index and bytes of their texts, at most; equal texts of one label count once
EXAMPLES = 2048
EXAMPLE_BYTES = 8 << 20
PREFIXES = (5, 7)  # bytes
FLOOR = 0.25
CLEAR = 10.0  # standard deviations at which a term weighs fully
NEIGHBOURS = 32
BLOCK = 32
#: terms in more than one of so many examples have whole rows
DENSE = 32
FIRST_BLOCKS = 8
TOXIC_AT = 0.3
EVIDENCE = 5
CHUNK = 1 << 16


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


class Terms:
    """Numbered terms, by hash."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers, -1 for others."""
        if not len(self.hashes):
            return np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)

    def of(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, term and number of occurrences of each distinct term of each text, in order."""
        return occurrences(raw, off, self.find)


def occurrences(raw: np.ndarray, off: np.ndarray, number) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, number(hash) and count of each text's words and word beginnings; numbers below 0 are left out."""
    buf = LOWER[raw]
    starts, ends, of = words(buf, off, IS_ALNUM)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums = byte_sums(buf)
    coded = pa.array(span_hash(sums, starts, ends)).dictionary_encode()
    which = np.asarray(coded.indices).astype(np.int64)
    distinct = np.asarray(coded.dictionary)
    first = np.empty(len(distinct), np.int64)
    first[which[::-1]] = np.arange(len(which))[::-1]
    # words once for each text
    pair = np.sort(owner(of) * len(distinct) + which)
    at = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    n, pair = np.diff(np.append(at, len(pair))), pair[at]
    text, word = pair // len(distinct), pair % len(distinct)
    found = [(text, number(distinct)[word], n)]
    for k in PREFIXES:
        long = np.flatnonzero((ends - starts)[first] >= k)
        with np.errstate(over="ignore"):
            begin = np.full(len(distinct), -1, np.int64)
            begin[long] = number(mix(span_hash(sums, starts[first[long]], starts[first[long]] + k) + np.uint64(k)))
        found.append((text, begin[word], n))
    text, term, n = (np.concatenate(x) for x in zip(*found))
    use = np.flatnonzero(term >= 0)
    text, term, n = text[use], term[use], n[use]
    width = int(term.max(initial=0)) + 1
    key = text * width + term
    order = np.argsort(key)
    key, n = key[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else order
    key = key[new]
    return key // width, key % width, np.add.reduceat(n, new) if len(new) else n


def examples_of(docs: DataFrame, labels: DataFrame, rows: int, size: int) -> DataFrame:
    """doc_id, label, text of the examples: of the labelled ids that do not test, the first by hash; of equal texts of one label the smallest id."""
    some = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out())
    ids = some.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most `rows` ids of 12 bytes
    labelled = tables.texts(docs).join(F.broadcast(ids), "doc_id")
    distinct = labelled.groupBy(F.xxhash64("text").alias("sig"), "label").agg(F.min(F.struct("doc_id", "text")).alias("x"))
    order = [F.xxhash64("doc_id"), "doc_id", "sig", "label"]
    chosen = tables.stored(distinct.select("sig", "label", "x.doc_id", F.coalesce("x.text", F.lit("")).alias("text")).orderBy(*order).limit(rows))
    lengths = chosen.select(*order, F.octet_length("text").alias("n")).orderBy(*order).collect()
    total, kept = 0, []
    for r in lengths:
        total += r.n
        if kept and total > size:
            break
        kept.append((r.sig, r.label))
    keep = docs.sparkSession.createDataFrame(kept, "sig long, label int")
    return chosen.join(F.broadcast(keep), ["sig", "label"]).select("doc_id", "label", "text")


def example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, label, and hashes and counts of the terms of each example."""
    for batch in batches:
        for lo, hi, buf, off in pieces(batch.column(2)):
            met: list[np.ndarray] = [np.zeros(0, np.uint64)]

            def note(h, met=met):
                met.append(h)
                return np.zeros(len(h), np.int64)

            occurrences(buf, off, note)
            terms = Terms(np.unique(np.concatenate(met)))
            text, term, n = terms.of(buf, off)
            hashes = terms.hashes[term]
            edge = np.searchsorted(text, np.arange(hi - lo + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array([hashes[a:b].tobytes() for a, b in zip(edge, edge[1:])], pa.binary()), pa.array([n[a:b].astype(np.int64).tobytes() for a, b in zip(edge, edge[1:])], pa.binary())],
                names=["doc_id", "label", "hashes", "counts"],
            )


def frequencies(docs: DataFrame, terms: Terms) -> tuple[np.ndarray, int]:
    """In how many texts each term occurs, and the number of texts."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, texts = np.zeros(len(shared.value.hashes) + 1, np.int64), 0
        for batch in joined(batches, 0):
            for lo, hi, buf, off in pieces(batch.column(0)):
                total += np.bincount(shared.value.of(buf, off)[1], minlength=len(total))
                texts += hi - lo
        total[-1] = texts
        for k in range(0, len(total), CHUNK):
            yield packed.record([(0, k, TaskContext.get().partitionId(), packed.pack(total[k : k + CHUNK]))])

    def add(chunk: int, rows) -> Iterator[pa.RecordBatch]:
        total = 0
        for _, _, (n,) in rows:
            total = total + n.astype(np.int64)
        yield packed.record([(0, chunk, 0, packed.pack(total))])

    out = np.zeros(len(terms.hashes) + 1, np.int64)
    for r in packed.exchanged(docs.select(F.col("text").cast("string")).mapInArrow(count, packed.SCHEMA), add).collect():  # one number for each term
        (n,) = packed.unpack(r.payload)
        out[r.target : r.target + len(n)] = n
    return out[:-1], int(out[-1])


class Index:
    """Block-max inverted index over unit vectors of examples."""

    def __init__(self, terms: Terms, weight: np.ndarray, labels: np.ndarray, ids: np.ndarray):
        self.terms, self.weight, self.labels, self.ids = terms, weight, labels, ids
        self.prior = (labels.sum() + 0.5) / (len(labels) + 1)

    def vectors(self, text: np.ndarray, term: np.ndarray, n: np.ndarray, texts: int) -> np.ndarray:
        """Unit weights of the terms of each text."""
        w = self.weight[term] * (1 + np.log(n))
        norm = np.sqrt(np.bincount(text, weights=w * w, minlength=texts))
        return w / norm[text] if len(w) else w

    def build(self, text: np.ndarray, term: np.ndarray, n: np.ndarray) -> None:
        """From the terms of the examples and their numbers of occurrences, by example and term."""
        self.given = self.labels, self.ids, text, term, n
        self.place(text, term, self.vectors(text, term, n, len(self.labels)))

    def __getstate__(self) -> bytes:
        """What travels to workers, who build the index once."""
        labels, ids, text, term, n = self.given
        return packed.pack(self.terms.hashes, self.weight, labels, ids, np.bincount(text, minlength=len(labels)), term, n)

    def __setstate__(self, state: bytes) -> None:
        hashes, weight, labels, ids, many, term, n = packed.unpack(state)
        self.__init__(Terms(hashes.astype(np.uint64)), weight, labels.astype(np.int64), ids.astype(np.int64))
        self.build(np.repeat(np.arange(len(labels)), many.astype(np.int64)), term.astype(np.int64), n.astype(np.int64))
        give_memory_back()

    def place(self, text: np.ndarray, term: np.ndarray, w: np.ndarray) -> None:
        n = len(self.labels)
        if not n:
            return
        # examples with the same strongest term stand together, so that blocks' maxima are sharp
        strongest = np.full(n, len(self.weight))
        order = np.lexsort((w, text))
        strongest[text[order]] = term[order]
        place = np.empty(n, np.int64)
        place[np.lexsort((self.ids, strongest))] = np.arange(n)
        back = np.argsort(place)
        self.labels, self.ids = self.labels[back], self.ids[back]
        e = place[text]
        self.blocks = -(-n // BLOCK)
        held = np.bincount(term, minlength=len(self.weight))
        dense = np.flatnonzero(held * DENSE > n)
        self.row = np.full(len(self.weight), -1, np.int64)
        self.row[dense] = np.arange(len(dense))
        self.rows = np.zeros((len(dense), self.blocks * BLOCK))
        full = self.row[term] >= 0
        self.rows[self.row[term[full]], e[full]] = w[full]
        e, term, w = e[~full], term[~full], w[~full]
        order = np.lexsort((e, term))
        e, term, w = e[order], term[order], w[order]
        cell = term * self.blocks + e // BLOCK
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
        self.example, self.value = e.astype(np.int32), w
        self.cell_block, self.cell_first = (cell[first] % self.blocks).astype(np.int32), np.append(first, len(cell))
        self.cell_most = np.maximum.reduceat(w, first) if len(first) else w
        self.cells = np.searchsorted(cell[first] // self.blocks, np.arange(len(self.weight) + 1))

    def first_parts(self, text: np.ndarray, term: np.ndarray, w: np.ndarray, texts: int) -> np.ndarray:
        """The part of every cosine that the terms with whole rows give."""
        x = np.zeros((texts, len(self.rows)))
        full = self.row[term] >= 0
        x[text[full], self.row[term[full]]] = w[full]
        return x @ self.rows

    def nearest(self, part: np.ndarray, term: np.ndarray, w: np.ndarray, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The NEIGHBOURS nearest examples of a text and their cosines, equal ones by place; those of cosine 0 are left out."""
        lists = np.flatnonzero(self.row[term] < 0)
        term, w = term[lists], w[lists]
        many = self.cells[term + 1] - self.cells[term]
        cell = expand(self.cells[term], many)
        block, by = self.cell_block[cell], np.repeat(w, many)
        bound = part.reshape(self.blocks, BLOCK).max(1) + np.bincount(block, weights=by * self.cell_most[cell], minlength=self.blocks)
        near, cosine = np.zeros(0, np.int64), np.zeros(0)
        order = np.argsort(-bound, kind="stable")
        # a few blocks first; then all that can hold one nearer than the last of these
        for use in (order[:FIRST_BLOCKS], order[FIRST_BLOCKS:]):
            least = cosine[-1] - 1e-9 if len(near) == NEIGHBOURS else 0.0
            use = use[: np.searchsorted(-bound[use], -least, "right")]
            if not len(use):
                break
            inside = np.zeros(self.blocks, bool)
            inside[use] = True
            some = np.flatnonzero(inside[block])
            c = cell[some]
            lens = self.cell_first[c + 1] - self.cell_first[c]
            span = expand(self.cell_first[c], lens)
            total = part + np.bincount(self.example[span], weights=np.repeat(by[some], lens) * self.value[span], minlength=len(part))
            e = np.flatnonzero((total >= least) & (total > 1e-12) & np.repeat(inside, BLOCK))
            e = e[e != skip]
            near, cosine = np.concatenate([near, e]), np.concatenate([cosine, np.round(total[e], 9)])
            best = np.lexsort((near, -cosine))[:NEIGHBOURS]
            near, cosine = near[best], cosine[best]
        return near, cosine

    def vote(self, near: np.ndarray, cosine: np.ndarray) -> float:
        """Log odds of the neighbours' votes, each worth the inverse of its distance; the prior has one distant vote."""
        w = 1 / (0.05 + np.maximum(0, 1 - cosine))
        p = (np.sum(w * self.labels[near]) + self.prior) / (w.sum() + 1)
        return float(np.log(p / (1 - p)))

    def neighbours(self, raw: np.ndarray, off: np.ndarray, skip: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each text with terms: its number, nearest examples and cosines."""
        texts = len(off) - 1
        text, term, n = self.terms.of(raw, off)
        w = self.vectors(text, term, n, texts)
        part = self.first_parts(text, term, w, texts)
        edge = np.searchsorted(text, np.arange(texts + 1))
        for i in np.flatnonzero(np.diff(edge)).tolist():
            here = slice(edge[i], edge[i + 1])
            yield i, *self.nearest(part[i], term[here], w[here], -1 if skip is None else int(skip[i]))

    def score(self, raw: np.ndarray, off: np.ndarray, slope: float, shift: float) -> tuple[np.ndarray, pa.Array]:
        texts = len(off) - 1
        if not len(self.labels) or not 0 < self.labels.mean() < 1:
            value = float(self.labels.mean()) if len(self.labels) else 0.0
            return np.full(texts, value), pa.array([[]] * texts, EVIDENCE_TYPE)
        out, many, near_of, cosine_of = np.full(texts, float(self.labels.mean())), np.zeros(texts, np.int64), [], []
        for i, near, cosine in self.neighbours(raw, off):
            if len(near):
                out[i] = 1 / (1 + np.exp(-np.clip(slope * self.vote(near, cosine) + shift, -30, 30)))
                many[i] = min(EVIDENCE, len(near))
                near_of.append(near[:EVIDENCE])
                cosine_of.append(cosine[:EVIDENCE])
        near, cosine = np.concatenate([np.zeros(0, np.int64), *near_of]), np.concatenate([np.zeros(0), *cosine_of])
        why = pa.StructArray.from_arrays([pa.array(self.ids[near]), pa.array(self.labels[near].astype(np.int32)), pa.array(cosine)], names=["doc_id", "toxic", "cosine"])
        return out, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), why)


EVIDENCE_TYPE = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))


@dataclass
class Trained:
    """The index, its broadcast, and the slope and intercept that calibrate its votes."""

    index: Index
    shared: object
    slope: float = 1.0
    shift: float = 0.0


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, size: int = EXAMPLE_BYTES) -> Trained:
    sample = tables.stored(examples_of(docs, labels, examples, size))
    rows = sorted(sample.mapInArrow(example_terms, "doc_id long, label int, hashes binary, counts binary").collect(), key=lambda r: (r.doc_id, r.label, bytes(r.hashes)))
    y = np.array([r.label for r in rows], np.int64)
    hashes = [np.frombuffer(r.hashes, np.uint64) for r in rows]
    text = np.repeat(np.arange(len(rows)), [len(h) for h in hashes])
    n = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(r.counts, np.int64) for r in rows]])
    known, term = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]), return_inverse=True)
    terms, weight = Terms(known), np.ones(len(known))
    votes_differ = len(rows) > 0 and 0 < y.mean() < 1
    if votes_differ:
        found, texts = frequencies(docs, terms)
        held, bad = np.bincount(term, minlength=len(known)), np.bincount(term, weights=y[text], minlength=len(known))
        share = y.mean()
        clear = np.abs(bad - held * share) / np.sqrt(held * share * (1 - share) + 1)
        weight = (np.log((1 + texts) / (1 + found)) + 1) * (FLOOR + (1 - FLOOR) * np.minimum(1, clear / CLEAR))
    index = Index(terms, weight, y, np.array([r.doc_id for r in rows], np.int64))
    order = np.lexsort((term, text))
    index.build(text[order], term[order], n[order])
    out = Trained(index, spark.sparkContext.broadcast(index))
    if not votes_differ:
        return out
    shared = out.shared

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Votes of each example's neighbours without itself."""
        here = shared.value
        place = {key: i for i, key in enumerate(zip(here.ids.tolist(), here.labels.tolist()))}
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for lo, hi, buf, off in pieces(batch.column(2)):
                z = [(keys[lo + i][0], here.vote(near, cosine), keys[lo + i][1]) for i, near, cosine in here.neighbours(buf, off, np.array([place[k] for k in keys[lo:hi]]))]
                doc_id, vote, label = zip(*z) if z else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(vote, pa.float64()), pa.array(label, pa.int32())], names=["doc_id", "vote", "label"])

    rows = sorted(sample.mapInArrow(votes, "doc_id long, vote double, label int").collect())
    z, y = np.array([r.vote for r in rows]), np.array([r.label for r in rows], float)
    if len(rows) and 0 < y.mean() < 1:
        out.slope, out.shift = platt(z, y)
    return out


def scores(model: Trained):
    """A worker's function from texts to scores and evidence."""
    shared, slope, shift = model.shared, model.slope, model.shift
    return lambda raw, off: shared.value.score(raw, off, slope, shift)


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, toxic_at: float = TOXIC_AT) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence of every row of docs(doc_id, text)."""
    score = scores(train(spark, docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in pieces(batch.column(1)):
                p, why = score(buf, off)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(2)[lo:hi], pa.array(p), pa.array((p >= toxic_at).astype(np.int32)), why], names=["doc_id", "held_out", "score", "predicted", "evidence"])

    return tables.texts(docs).withColumn("held_out", held_out()).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, evidence array<struct<doc_id:long,toxic:int,cosine:double>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark, tables.table(spark, sf_dir, "documents"), tables.table(spark, sf_dir, "labels"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are predicted toxic go; all columns stay as they are."""
    score = scores(train(spark, docs, tables.table(spark, sf_dir, "labels")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in pieces(batch.column("text")):
                p, _ = score(buf, off)
                yield batch.slice(lo, hi - lo).filter(pa.array(p < TOXIC_AT))

    return docs.mapInArrow(run, docs.schema)
