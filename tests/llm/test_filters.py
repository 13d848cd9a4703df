"""Quality rules and toxicity on small tables: rules against brute force, models by held-out accuracy, edges."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from querent.llm import quality, samples, toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

SF = "/root/testdata/sf0.01"


def rules(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {k for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


EDGES = [(1, None, 1), (2, "", 1), (None, "a b c", 1), (3, "x " * 50, 1), (3, "x " * 50, 1), (4, "# a\n\n a\n a\nb ä é日\n" * 9, 1), (5, " \n\t ", 1)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "doc_id long, text string, kept int")


def test_quality(spark, edges):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text").unionAll(edges.select("doc_id", "text"))
    got = quality.quality(spark, docs, labels).collect()
    want = Counter((str(r.doc_id), *(b := rules(r.text or "")), b[0] < 20 or 100 * b[4] > 30 * b[0]) for r in docs.collect())
    assert Counter((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept for r in got if r.base_failed)


def test_quality_of_rows_not_fitted_on(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    seen = {r.doc_id for r in samples.labelled(docs, labels, "quality", quality.TRAIN_ROWS).select("doc_id").collect()}
    label = {r.doc_id: r.quality for r in labels.collect() if r.doc_id not in seen}
    got = [r for r in quality.quality(spark, docs, labels).collect() if r.doc_id in label]
    checked = [(r.probability >= quality.KEEP_AT, label[r.doc_id]) for r in got]
    assert len(checked) > 500 and sum(k == bool(y) for k, y in checked) > 0.95 * len(checked)
    # calibrated: mean probabilities are near the shares
    p, y = np.array([r.probability for r in got]), np.array([label[r.doc_id] for r in got])
    assert abs(p.mean() - y.mean()) < 0.03


def test_character_grams():
    """Windows of four characters, whatever their bytes, that lie in one text."""
    texts = ["aé日b𝄞c", "abc", "", "x" * 9]
    raw = [t.encode() for t in texts]
    buf, off = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    code, at = quality.characters(buf, off)
    assert [code[a:b].tolist() for a, b in zip(at, at[1:])] == [[ord(c) for c in t] for t in texts]
    _, h, of = quality.base(buf, off)
    bucket, ends = quality.grams(buf, off, h, of)[2]
    assert np.diff(ends).tolist() == [3, 0, 0, 6] and len(bucket) == 9 and len(set(bucket[3:].tolist())) == 1 and len(set(bucket.tolist())) == 4


def test_quality_without_labels(spark, edges):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.kept for r in quality.quality(spark, edges, labels).where("not base_failed").collect()} <= {True}
    assert quality.quality(spark, edges.limit(0), labels).count() == 0


def test_toxicity_held_out(spark, edges):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(spark, docs.select("doc_id", "text").unionAll(edges.select("doc_id", "text")), labels).collect()
    assert len(got) == docs.count() + len(EDGES)
    label = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [(r.predicted, label[r.doc_id]) for r in got if r.held_out and r.doc_id in label]
    hit = sum(p and y for p, y in held)
    assert hit >= 0.85 * sum(y for _, y in held) and hit >= 0.9 * sum(p for p, _ in held)
    assert all(r.evidence for r in got if r.predicted)


def test_toxicity_without_labels(spark, edges):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r.score, r.predicted) for r in toxicity.toxicity(spark, edges, labels).collect()} == {(0.0, 0)}
    assert toxicity.toxicity(spark, edges.limit(0), labels).count() == 0


def brute_terms(text):
    """Words and their beginnings, in bytes."""
    w = [x.encode() for x in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))]
    return Counter([(0, x) for x in w] + [(k, x[:k]) for k in toxicity.PREFIXES for x in w if len(x) >= k])


def test_nearest_examples_by_cosine_of_whole_texts(spark):
    """Against vectors made from words themselves: document frequencies of all texts, weights by labels, every example compared."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    toxic = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id in text and zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    distinct = {}
    for d in sorted(toxic, reverse=True):
        distinct[text[d], toxic[d]] = d
    ids = sorted(distinct.values())
    counts = {d: brute_terms(t) for d, t in text.items()}
    found = Counter(t for c in counts.values() for t in c)
    held, bad = Counter(t for d in ids for t in counts[d]), Counter(t for d in ids if toxic[d] for t in counts[d])
    share = sum(toxic[d] for d in ids) / len(ids)

    def unit(c):
        w = {}
        for t, n in c.items():
            if t in held:
                clear = abs(bad[t] - held[t] * share) / np.sqrt(held[t] * share * (1 - share) + 1)
                w[t] = (1 + np.log(n)) * (np.log((1 + len(text)) / (1 + found[t])) + 1) * (toxicity.FLOOR + (1 - toxicity.FLOOR) * min(1, clear / toxicity.CLEAR))
        norm = np.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}

    vectors = {d: unit(counts[d]) for d in ids}
    index = toxicity.train(spark, docs, labels).index
    assert sorted(index.ids.tolist()) == ids and index.blocks > 1
    for d, t in text.items():
        raw = np.frombuffer(t.encode(), np.uint8)
        q = unit(counts[d])
        want = sorted((c for c in (sum(x * v.get(t, 0.0) for t, x in q.items()) for v in vectors.values()) if c > 1e-9), reverse=True)[: toxicity.NEIGHBOURS]
        got = [(near, cosine) for _, near, cosine in index.neighbours(raw, np.array([0, len(raw)]))]
        assert bool(got) == bool(want)
        if got:
            assert np.allclose(got[0][1], want, atol=1e-8)
            assert np.allclose([sum(x * vectors[int(index.ids[e])].get(t, 0.0) for t, x in q.items()) for e in got[0][0]], got[0][1], atol=1e-8)


def test_scores_tell_texts_apart(spark):
    """Also where few rows are labelled; equal texts score alike, however the table is cut."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    out = [{r.doc_id: r.score for r in toxicity.toxicity(spark, docs.repartition(n), labels).collect()} for n in (1, 7)]
    assert out[0] == out[1]
    by_score = {}
    words = {r.doc_id: tuple(sorted(brute_terms(r.text or "").items())) for r in docs.collect()}
    for d, s in out[0].items():
        by_score.setdefault(round(s, 12), set()).add(words[d])
    assert len(by_score) > 0.97 * len(set(words.values()))


def test_block_max_search_is_exact(monkeypatch):
    rng = np.random.default_rng(3)
    for dense in (4, 64, 10**9):  # whole rows for many, few and no terms
        monkeypatch.setattr(toxicity, "DENSE", dense)
        index = toxicity.Index(toxicity.Terms(np.arange(400, dtype=np.uint64)), np.ones(400), (rng.random(900) < 0.3).astype(int), np.arange(900))
        vectors = np.zeros((900, 400))
        for i in range(900):
            r = np.unique(rng.zipf(1.3, 30) % 400)
            vectors[i, r] = rng.random(len(r)) + 0.1
        vectors[800:820] = vectors[0]  # ties
        vectors /= np.linalg.norm(vectors, axis=1)[:, None]
        text, term = np.nonzero(vectors)
        index.place(text, term, vectors[text, term])
        for i in range(0, 900, 9):
            q = np.flatnonzero(vectors[i])
            part = index.first_parts(np.zeros(len(q), np.int64), q, vectors[i, q], 1)[0]
            near, cosine = index.nearest(part, q, vectors[i, q], skip=5)
            every = np.sort(np.delete(vectors @ vectors[i], index.ids[5]))[::-1]
            assert np.allclose(cosine, every[: len(cosine)], atol=1e-8) and len(cosine) == min(32, (every > 1e-9).sum())
            assert np.allclose(cosine, vectors[index.ids[near]] @ vectors[i], atol=1e-8)
            assert all(near[k] < near[k + 1] for k in range(len(near) - 1) if cosine[k] == cosine[k + 1])


@pytest.mark.parametrize("labels", [[(1, 0, 1)], [(1, 0, 1), (3, 0, None), (None, 0, 1)], [(1, 0, 0), (3, 0, 0)], [(1, 0, 1), (3, 0, 0)]])
def test_few_labels(spark, edges, labels):
    got = toxicity.toxicity(spark, edges, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(EDGES) and all(0 <= r.score <= 1 for r in got)
    assert {type(r.score) for r in got} == {float}


def test_bound_on_bytes_of_examples(spark):
    docs = spark.createDataFrame([(i, f"own{i} " * 50) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    assert 0 < toxicity.examples_of(docs, labels, 1000, 5000).agg({"text": "count"}).first()[0] <= 5000 // 250
    assert toxicity.examples_of(docs, labels, 7, 1 << 20).count() == 7


def test_examples_that_share_a_passage_all_stay(spark):
    passage = "the same three words and more of them stand in every text here "
    rows = [(i, f"{passage * 3} own{i} words{i} follow{i}", i % 2) for i in range(40)] + [(90, "one text", 1), (80, "one text", 1), (70, "one text", 0), (60, "", 1), (61, " ", 0)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 0, r[2]) for r in rows], "doc_id long, quality int, toxic int")
    index = toxicity.train(spark, docs, labels).index
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    want = sorted({(t, y): min(i for i, u, z in learned if (u, z) == (t, y)) for _, t, y in learned}.values())
    assert sorted(index.ids.tolist()) == want
