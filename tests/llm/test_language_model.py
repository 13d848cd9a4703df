"""Base scores against brute force, probabilities that add up to 1, equal scores however the table is cut, and seatings against exact distributions."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from querent.llm import language_model as lm
from querent.llm import packed, seating, tables

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def check(docs, out):
    rows = docs.collect()
    count = Counter(w for r in rows if not held(r.doc_id) for w in words_of(r.text))
    total = sum(count.values())
    want = sorted((str(r.doc_id), held(r.doc_id), len(t := words_of(r.text)), sum(count[w] > 0 for w in t), total, round(sum(math.log10((count[w] + 0.5) / (total + 0.5 * (len(count) + 1))) for w in t), 6) + 0.0) for r in rows)
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6) + 0.0) for r in out)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[5] for x in got], [x[5] for x in want])


MORE = [(500, None), (501, ""), (None, "the the The"), (502, "same"), (502, "same"), (503, "été " * 500)]
#: one group, and many with contexts in several of them and few pairs in the broadcast table
SIZES = [{}, {"GROUP_TOKENS": 3000, "CONTEXT_TOKENS": 200, "SAMPLE": 1, "TOP_PAIRS": 60, "FREQUENT": 300}]


@pytest.mark.parametrize("sizes", SIZES)
def test_scores(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(lm, name, value)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionAll(spark.createDataFrame(MORE, docs.schema)).selectExpr("*", "'x' as score", "1 as uid")
    out = lm.perplexity(spark, docs).collect()
    check(docs, out)
    assert all(math.isfinite(r.score) and r.score < 0 and r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens)) for r in out)
    for held in (True, False):  # better than counts of words, most of all where pairs were met before
        some = [r for r in out if r.held_out == held]
        assert sum(r.score for r in some) > (0.9 if held else 0.6) * sum(r.base_score for r in some)
    same = [r.score for r in out if r.doc_id == 502]
    assert same[0] == same[1]


def test_edges(spark):
    assert lm.perplexity(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only_held = next(i for i in range(100) if held(i))
    out = lm.perplexity(spark, spark.createDataFrame([(only_held, "a b")], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in out] == [(3, 0, 0, 0.0, 0.0)]


@pytest.mark.parametrize("sizes", SIZES[1:])
def test_scores_do_not_depend_on_partitions(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(lm, name, value)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    scores = [sorted((r.doc_id, r.base_score, r.score) for r in lm.perplexity(spark, docs.repartition(n)).collect()) for n in (1, 8)]
    assert scores[0] == scores[1]


@pytest.mark.parametrize("sizes", SIZES)
def test_probabilities_add_up(spark, monkeypatch, sizes):
    """After each context: the words that followed it, all other known words, and the unknown one."""
    for name, value in sizes.items():
        monkeypatch.setattr(lm, name, value)
    docs = lm.keyed(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    with tables.batches(spark, packed.BATCH_ROWS):
        model, start, seats, state, told = lm.train(spark, docs)
    kept = len(model.parents)
    base = {}
    for r in lm.of_kinds(state, lm.STATE).collect():
        x = packed.unpack(r.payload)
        states = [a.astype(np.int64) for a in x[5:]][-2 * kept :]
        base |= zip(packed.join_codes(*x[:3]).tolist(), np.stack([p.base(states[2 * k], states[2 * k + 1]) for k, p in enumerate(model.parents)], 1).tolist())
    unknown = np.array([p.base(np.zeros(1), np.zeros(1))[0] for p in model.parents])
    whole = sum(np.array(b) for b in base.values())
    assert np.allclose(whole + unknown, 1)
    rows = lm.of_kinds(start, lm.STATIC).unionAll(lm.of_kinds(seats, lm.WORK)).unionAll(lm.of_kinds(told, lm.REPLY)).orderBy("target", "kind", "source").collect()
    groups, total, left = {r.target for r in rows}, Counter(), {}
    for g in groups:
        here = lm.Restaurants(model, *lm.gathered((r.kind, r.source, packed.unpack(r.payload)) for r in rows if r.target == g)[:3])
        for i, u in enumerate(here.u.tolist()):
            mine = np.flatnonzero(here.of == i)
            w = here.w[here.pair[mine] & 0xFFFFFFFF].tolist()
            total[u] += (10 ** here.logp[mine]).sum() - (here.share[:, i] * sum(np.array(base[x]) for x in w)).mean()
            left[u] = (here.share[:, i] * (whole + unknown)).mean()
    assert len(groups) == model.codes.groups or not sizes
    assert np.allclose([total[u] + left[u] for u in left], 1)
    assert all(10 ** model.log_top <= 1) and len(model.top) <= lm.TOP_PAIRS


def exact_tables(c, a, d):
    """Probabilities of the numbers of tables of c customers, in proportion to a**t S(c, t), customer by customer."""
    p, t = np.eye(1, c + 1, 1)[0], np.arange(c + 1)
    for n in range(1, c):
        q = np.maximum(n - d * t, 0) * p
        q[1:] += a * p[:-1]
        p = q / q.sum()
    return p


@pytest.mark.parametrize("c,a,d", [(4, 0.3, 0.4), (30, 5.0, 0.7), (100, 0.01, 0.8), (100, 60.0, 0.6), (5000, 30.0, 0.7), (3000, 40.0, 0.85), (20000, 60.0, 0.6)])
def test_draws_of_table_counts_are_exact(c, a, d):
    p = exact_tables(c, a, d)
    mean = (np.arange(c + 1) * p).sum()
    spread = np.sqrt((np.arange(c + 1) ** 2 * p).sum() - mean**2)
    n = 4000
    t = seating.table_counts(np.full(n, c), np.full(n, -1), np.full(n, a), d, np.random.default_rng(10))
    assert t.min() >= 1 and t.max() <= c
    assert abs(t.mean() - mean) < 4 * spread / math.sqrt(n) and abs(t.std() / spread - 1) < 0.08


def test_sweeps_of_all_customers_sample_the_posterior():
    """Two dishes of one restaurant: the mean numbers of tables against sums over all pairs of them, with a large dish."""
    d, theta, base, c = 0.4, 1.5, np.array([0.3, 0.7]), np.array([400, 5])
    with np.errstate(divide="ignore"):
        log_s = [np.log(exact_tables(n, 1.0, d)) for n in c]
    t = [np.arange(n + 1) for n in c]
    total = t[0][:, None] + t[1][None]
    up = np.concatenate([[0], np.cumsum(np.log(theta + d * np.arange(total.max())))])
    w = up[total] + (log_s[0] + t[0] * np.log(base[0]))[:, None] + (log_s[1] + t[1] * np.log(base[1]))[None]
    w = np.exp(w - w.max()) * (t[0] > 0)[:, None] * (t[1] > 0)[None]
    want = np.array([(w * x).sum() / w.sum() for x in (t[0][:, None], t[1][None])])
    rng, now, seen = np.random.default_rng(11), np.ones(2, np.int64), []
    for _ in range(4000):
        now = seating.table_counts(c, now, seating.new_table_weight(now.sum(), d, theta, rng) * base, d, rng)
        seen.append(now)
    assert np.allclose(np.mean(seen[100:], axis=0), want, rtol=0.04)
