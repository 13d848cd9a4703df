"""Operator 1: quality rules and a hashed n-gram logistic regression.

The model takes mean weights of hashed words, word pairs and grams of four characters, is trained on labelled quality
rows by adaptive stochastic gradient steps and calibrated on rows that it was not trained on. Texts are scored in Arrow
batches against fixed thresholds.

Defined results: null and empty texts have no words and fail the rules; repeated rows each have their own row; without
labels of both kinds the verdict is the share of good labels (1 if there are none); an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from querent.llm import samples, tables
from querent.llm.textbatch import IS_PLAIN, byte_sums, mix, owner, pieces, prefix, span_hash, sums_by, words

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
KEEP_AT = 0.5
#: labelled rows that the model is fitted on, at most
TRAIN_ROWS = 3000
BITS = 16
KINDS = 3
#: passes over the rows in training, and the size of a step
PASSES = 8
STEP = 0.5
GRAM = 4  # characters
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def characters(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, and offsets of each text's."""
    starts = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    return np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32), starts[off]


def windows(values: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of values that stand for windows of width items, those that lie in one text, and offsets of each text's."""
    n = np.maximum(0, np.diff(offsets) - (width - 1))
    keep = np.ones(len(values), bool)
    for back in range(1, width):
        at = offsets[1:-1] - back
        keep[at[(at >= 0) & (at < len(values))]] = False
    return values[keep], np.concatenate([[0], np.cumsum(n)])


def grams(buf: np.ndarray, off: np.ndarray, h: np.ndarray, of: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of gram: bucket numbers in text order, and offsets of each text's grams."""
    shift = np.uint64(64 - BITS)
    code, at = characters(buf, off)
    with np.errstate(over="ignore"):
        pair = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) if len(h) > 1 else np.zeros(0, np.uint64)
        four = np.zeros(max(0, len(code) - (GRAM - 1)), np.uint64)
        for k in range(GRAM):
            four = four * np.uint64(0x9E3779B97F4A7C15) + code[k : k + len(four)]
        four ^= four >> np.uint64(29)
        four *= np.uint64(0xC4CEB9FE1A85EC53)
    out = [((h >> shift).astype(np.int32), of)]
    for values, offsets, width in (((pair >> shift).astype(np.int32), of, 2), ((four >> shift).astype(np.int32), at, GRAM)):
        out.append(windows(values, offsets, width))
    return out


def base(buf: np.ndarray, off: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The rule columns of each text, the words' hashes and their offsets."""
    starts, ends, of = words(buf, off, IS_PLAIN)
    sums = byte_sums(buf)
    h = span_hash(sums, starts, ends)
    n = np.diff(of)
    out = {"n_words": n, "word_chars": sums_by(IS_PLAIN[buf] & ((buf & 0xC0) != 0x80), off), "n_symbols": sums_by(SYMBOLS[buf], off)}
    # lines with a word, by text
    feeds = np.flatnonzero(buf == 10)
    line_start = np.union1d(off[:-1], feeds + 1)
    line_start = line_start[line_start < len(buf)]
    line_end = np.append(line_start[1:], len(buf))
    line_end = np.where((line_end > line_start) & (buf[line_end - 1] == 10), line_end - 1, line_end) if len(buf) else line_end
    has = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    a, b = line_start[has], line_end[has]
    line_text = np.searchsorted(off, a, "right") - 1
    with np.errstate(over="ignore"):
        key = mix(span_hash(sums, a, b) ^ (line_text.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(key, return_index=True)
    out["n_dup_lines"] = np.bincount(line_text, minlength=len(n)) - np.bincount(line_text[first], minlength=len(n))
    # windows that a text has twice
    windows = np.maximum(0, n - (REPEAT_WINDOW - 1))
    text_of = np.repeat(np.arange(len(n)), windows)
    at = np.repeat(of[:-1] - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    with np.errstate(over="ignore"):
        key = mix(span_hash(prefix(h), at, at + REPEAT_WINDOW) ^ (text_of.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(order) else order
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + REPEAT_WINDOW, -1)
    out["n_repeat_words"] = sums_by(np.cumsum(cover)[:-1] > 0, of)
    out["base_failed"] = (n < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * n)
    return out, h, of


class Model:
    """Weights by kind and bucket, an intercept, and the slope and intercept of the calibration."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights.astype(np.float32), bias, slope, shift

    def probability(self, buf: np.ndarray, off: np.ndarray, h: np.ndarray, of: np.ndarray) -> np.ndarray:
        z = np.full(len(off) - 1, self.bias)
        for kind, (bucket, at) in enumerate(grams(buf, off, h, of)):
            z += sums_by(self.weights[kind][bucket].astype(np.float64), at) / np.maximum(1, np.diff(at))
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -30, 30)))


def features(sample: DataFrame) -> DataFrame:
    """doc_id, label, and each sampled text's buckets with their shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in pieces(batch.column(1)):
                _, h, of = base(buf, off)
                kinds = grams(buf, off, h, of)
                cols, vals = [], []
                for i in range(hi - lo):
                    c, v = [], []
                    for kind, (bucket, at) in enumerate(kinds):
                        u, n = np.unique(bucket[at[i] : at[i + 1]], return_counts=True)
                        c.append(u + kind * (1 << BITS))
                        v.append(n / max(1, n.sum()))
                    cols.append(np.concatenate(c).astype(np.int32).tobytes())
                    vals.append(np.concatenate(v).astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(2)[lo:hi], pa.array(cols, pa.binary()), pa.array(vals, pa.binary())], names=["doc_id", "label", "cols", "vals"])

    return sample.mapInArrow(run, "doc_id long, label int, cols binary, vals binary")


def fit(rows: list) -> Model:
    """Logistic regression with equal weight for both labels, calibrated on every fifth row."""
    rows = sorted(rows, key=lambda r: (r.doc_id, bytes(r.cols)))
    y = np.array([r.label for r in rows], np.float64)
    if not len(rows) or y.min() == y.max():
        p = float(np.clip(y.mean() if len(rows) else 1.0, 0.001, 0.999))
        return Model(np.zeros((KINDS, 1 << BITS)), np.log(p / (1 - p)), 1.0, 0.0)
    cols = [np.frombuffer(r.cols, np.int32) for r in rows]
    vals = [np.frombuffer(r.vals, np.float32).astype(np.float64) for r in rows]
    held = np.arange(len(rows)) % 5 == 4
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    train = np.flatnonzero(~held)
    weight = np.where(y == 1, 0.5 / max(1, (y[train] == 1).sum()), 0.5 / max(1, (y[train] == 0).sum())) * len(train)
    w, b, gw, gb, rng = np.zeros(KINDS << BITS), 0.0, np.full(KINDS << BITS, 1e-8), 1e-8, np.random.default_rng(21)
    for _ in range(PASSES):
        for i in rng.permutation(train).tolist():
            c, v = cols[i], vals[i]
            error = weight[i] * (1 / (1 + np.exp(-np.clip(v @ w[c] + b, -30, 30))) - y[i])
            g = error * v
            gw[c] += g * g
            gb += error * error
            w[c] -= STEP * g / np.sqrt(gw[c])
            b -= 0.1 * error / np.sqrt(gb)
    z = np.array([v @ w[c] + b for c, v in zip(cols, vals)])
    use = held if held.any() else np.ones(len(rows), bool)
    slope, shift = platt(z[use], y[use])
    return Model(w.reshape(KINDS, -1), b, slope, shift)


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that calibrate z, by Newton steps with smoothed targets."""
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    scale = max(1e-6, float(np.abs(z).max()))
    x = np.stack([z / scale, np.ones_like(z)], 1)
    w = np.array([a * scale, b])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - t) + 1e-3 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, g)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]) / scale, 1e-9), float(w[1])


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rule columns, the model's probability of good quality and the verdict of every row of docs(doc_id, text)."""
    model = spark.sparkContext.broadcast(fit(features(samples.labelled(docs, labels, "quality", train_rows)).collect()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in pieces(batch.column(1)):
                rules, h, of = base(buf, off)
                p = model.value.probability(buf, off, h, of)
                names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], *[pa.array(rules[k].astype(np.int64)) for k in names], pa.array(rules["base_failed"]), pa.array(p), pa.array(~rules["base_failed"] & (p >= keep_at))],
                    names=["doc_id", *names, "base_failed", "probability", "kept"],
                )

    return tables.texts(docs).mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark, tables.table(spark, sf_dir, "documents"), tables.table(spark, sf_dir, "labels"))
