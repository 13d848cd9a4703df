"""Repeated 200-byte strings against brute force, and deep-shallow order against sorting."""

import hashlib
from collections import Counter

import numpy as np

from querent.llm import suffix_dedup


def brute(texts):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + 200] for b in data for i in range(len(b) - 199))
    out = []
    for b in data:
        hit = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                hit[i : i + 200] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~hit])
        out.append((len(b), int(hit.sum()), int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum()), kept))
    return out


def passages(seed=7):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdeé"), rng.integers(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(n) for n in (45, 60, 70, 200)]
    rows = [(1, None), (2, ""), (3, "short"), (None, "x" * 500), (4, "x" * 199), (5, "ab" * 300), (6, text(300)), (6, text(300))]
    for i in range(40):
        parts = []
        for _ in range(rng.integers(1, 5)):
            s = shared[rng.integers(len(shared))]
            a = rng.integers(0, 60)
            parts += [text(rng.integers(0, 40)), s[a : a + rng.integers(150, 900)]]
        rows.append((10 + i, " ".join(parts)))
    return rows + [(50, rows[-1][1]), (50, rows[-1][1]), (51, rows[-3][1][:250]), (52, rows[20][1][5:260] + rows[21][1][-230:])]


def test_equals_brute_force(spark, monkeypatch):
    rows = passages()
    want = Counter((d, *x) for (d, _), x in zip(rows, brute([t for _, t in rows])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as spans", "'u' as uid").repartition(3)
    for frequent in (64, 1):  # with and without spreading frequent strings
        monkeypatch.setattr(suffix_dedup, "FREQUENT", frequent)
        out = suffix_dedup.deduplicate(spark, docs).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out) == want
    assert suffix_dedup.deduplicate(spark, docs.limit(0)).count() == 0


def test_a_string_in_every_shard(spark, monkeypatch):
    """Classes that the sample knows are settled where they are met; others that share their places are still found."""
    rng = np.random.default_rng(12)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 1500)
    monkeypatch.setattr(suffix_dedup, "SAMPLE_SHARD_BYTES", 1500)
    word = lambda n: " ".join("".join(rng.choice(list("abcdefg"), 6)) for _ in range(n))
    license_text = word(120)
    rows = [(i, f"{word(20)} {license_text} {word(20)}") for i in range(60)] + [(100 + i, f"{word(9)} {license_text[i * 7 : 260 + i * 9]} {word(9)}") for i in range(12)]
    want = Counter((d, *x) for (d, _), x in zip(rows, brute([t for _, t in rows])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for sample, least in ((1, 4), (3, 2), (64, 4)):
        monkeypatch.setattr(suffix_dedup, "SAMPLE", sample)
        monkeypatch.setattr(suffix_dedup, "KNOWN_FROM", least)
        out = suffix_dedup.deduplicate(spark, docs).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out) == want
        keyed = suffix_dedup.tables.texts(docs).selectExpr("xxhash64(doc_id, text) uid", "text")
        known, samples = suffix_dedup.repeated_in_sample(spark, keyed)
        assert len(known.keys) == samples.count() and (len(known.keys) > 0 or sample == 64)


def test_many_equal_rows(spark):
    """Each of 5,000 equal rows has the same runs, which are kept once."""
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text)] * 5000 + [(2, text[:150])], "doc_id long, text string").repartition(4)
    keyed = docs.selectExpr("xxhash64(doc_id, text) uid", "text")
    spans = suffix_dedup.repeated(spark, keyed).collect()
    assert len(spans) == 1 and len(spans[0].spans) <= len(text)
    out = suffix_dedup.deduplicate(spark, docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in out) == {(1, len(text), len(text), 1): 5000, (2, 150, 0, 0): 1}


def test_rows_of_a_key_over_many_batches(spark):
    import pyarrow as pa

    cols = [np.repeat([1, 2, 3, 4], [1, 5000, 2, 1]).astype(np.uint64), np.full(5004, 9, np.uint64), np.arange(5004), np.zeros(5004, int), np.ones(5004, int), np.zeros(5004, int)]
    whole = suffix_dedup.batch_of(*cols)
    for step in (1, 7, 4999, 6000):
        out = pa.Table.from_batches(suffix_dedup.resolve(iter([whole.slice(i, step) for i in range(0, 5004, step)])))
        assert sorted(out.column("uid").to_pylist()) == list(range(1, 5003)) and all(out.column("full").to_pylist())


def test_test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    want = {r.doc_id: (*x[:3], hashlib.sha256(x[3]).hexdigest()) for r, x in zip(rows, brute([r.text for r in rows]))}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.query(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_stage_keeps_rows_and_columns(spark):
    rows = passages()
    docs = spark.createDataFrame([(d, t, "en", None if t is None else len(t)) for d, t in rows], "doc_id long, text string, lang string, n_chars long")
    out = suffix_dedup.stage(spark, docs, "").collect()
    assert out[0].__fields__ == docs.columns
    want = Counter((d, None if t is None else x[3].decode("utf-8", "ignore")) for (d, t), x in zip(rows, brute([t for _, t in rows])))
    assert Counter((r.doc_id, r.text) for r in out) == want
    assert all(r.text is None or r.n_chars == len(r.text) for r in out)


def test_deep_shallow_order():
    rng = np.random.default_rng(1)
    buf = rng.integers(97, 99, 3000).astype(np.uint8)
    buf[1000:1400] = buf[200:600]
    buf[2000:2400] = 97
    start = rng.integers(0, 2600, 900)
    size = rng.integers(40, 300, 900)
    order, same = suffix_dedup.deep_shallow(np.concatenate([buf, np.zeros(8, np.uint8)]), start, size)
    data = buf.tobytes()
    strings = [data[a : a + n] for a, n in zip(start[order], size[order])]
    assert strings == sorted(strings) and sorted(order.tolist()) == list(range(900))
    assert same.tolist() == [i > 0 and strings[i] == strings[i - 1] for i in range(900)]
