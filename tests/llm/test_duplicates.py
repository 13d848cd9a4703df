"""SimHash groups and decontamination against brute force."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from querent.llm import components, decontamination, simhash, xxh64

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(s))


def groups(fps):
    x = np.array(fps, np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None]) <= 2
    label = np.arange(len(x))
    while True:
        new = np.where(near, label[None], len(x)).min(1)
        if (new == label).all():
            return label
        label = new


@pytest.fixture(scope="module")
def docs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    return docs.unionAll(spark.createDataFrame([(900, None), (901, ""), (902, "one"), (903, "ONE"), (904, "one  two"), (0, "one two"), (905, " a\tb\nc d ")], docs.schema)).withColumnRenamed("x", "y")


def test_simhash(spark, docs):
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id, r.text or ""))
    fps = [fingerprint(r.text) for r in rows]
    label = groups(fps)
    least = {g: min(rows[i].doc_id for i in np.flatnonzero(label == g)) for g in set(label.tolist())}
    want = Counter((r.doc_id, f"{f:016x}", least[g]) for r, f, g in zip(rows, fps, label.tolist()))
    out = simhash.near_duplicates(spark, docs).collect()
    assert Counter((r.doc_id, f"{r.fp % 2**64:016x}", r.component_id) for r in out) == want


def test_tiles_and_buckets_lose_no_link(spark):
    rng = np.random.default_rng(2)
    seeds = rng.integers(0, 2**63, 40, dtype=np.uint64)
    x = []
    for s in seeds:
        for _ in range(30):
            x.append(s := s ^ np.uint64(1) << np.uint64(rng.integers(64)) ^ np.uint64(1) << np.uint64(rng.integers(64)))
    one = int(seeds[0])
    x += [np.uint64(one ^ i) for i in range(1500)]  # one large bucket
    x = np.unique(np.array(x, np.uint64))
    label = groups(x.tolist())
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    found = {r.node: r.root for r in components.components(simhash.links(df)).collect()}
    mine = [found.get(int(v), int(v)) for v in x.view(np.int64)]
    assert len(set(zip(mine, label.tolist()))) == len(set(mine)) == len(set(label.tolist()))


def test_pairs_of_tiles_equal_all_pairs(monkeypatch):
    """Blocks of few fingerprints, so that many pairs of blocks are skipped by their counts."""
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, 500, dtype=np.uint64)
    y = np.concatenate([x[:200] ^ np.uint64(5), x[200:300] ^ np.uint64(7), rng.integers(0, 2**63, 300, dtype=np.uint64)])
    for a, b in ((x, y), (np.concatenate([x, y]), None)):
        both = a if b is None else np.concatenate([a, b])
        near = np.bitwise_count(both[:, None] ^ both[None]) <= 2
        if b is not None:
            near[: len(a), : len(a)] = near[len(a) :, len(a) :] = False
        p, q = simhash.near_pairs(simhash.Tile(a), None if b is None else simhash.Tile(b))
        label = {int(v): int(v) for v in both}

        def find(v, label=label):
            while label[v] != v:
                v = label[v]
            return v

        for u, v in zip(p.tolist(), q.tolist()):
            label[find(u)] = find(v)
        i, j = np.nonzero(near)
        assert len(i) and all(find(int(both[k])) == find(int(both[m])) for k, m in zip(i, j))


def test_tiles_that_are_skipped_hold_no_link():
    steps = set(simhash.steps())
    assert len(steps) == 21 and 0 in steps
    number = lambda v: sum(((v >> 16 * i) & 0xFFFF).bit_count() * 32 ** (3 - i) for i in range(4))
    rng = np.random.default_rng(4)
    for _ in range(3000):
        v = int(rng.integers(0, 2**63))
        w = v ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64)))
        assert abs(number(v) - number(w)) in steps


def test_hash_equals_the_library():
    rng = np.random.default_rng(0)
    data, start, size = rng.integers(0, 256, 9000).astype(np.uint8), rng.integers(0, 8000, 3000), rng.integers(0, 500, 3000)
    raw = data.tobytes()
    assert xxh64.hashes(data, start, size, 42).tolist() == [xxhash.xxh64_intdigest(raw[a : a + n], 42) for a, n in zip(start, size)]


def test_fingerprint_of_a_long_text():
    text = " ".join(f"w{i % 97}" for i in range(3000))
    raw = np.frombuffer(text.encode(), np.uint8)
    assert simhash.fingerprints(raw, np.array([0, len(raw)])).tolist() == [fingerprint(text)]


def test_simhash_stage_keeps_one_of_each_group(spark, docs):
    full = docs.withColumn("component_id", docs.doc_id)
    out = simhash.stage(spark, full, "").collect()
    assert out[0].__fields__ == full.columns
    want = {r.root: r.component_id for r in simhash.groups(spark, docs).collect()}
    assert sorted(r.doc_id for r in out) == sorted(want.values())


def test_simhash_stage_with_an_id_of_two_texts(spark):
    text = [" ".join(f"{w}{i}" for i in range(40)) for w in "abc"]
    docs = spark.createDataFrame([(1, text[0], "x"), (2, text[0], "y"), (2, text[1], "z"), (2, text[1], "a"), (None, text[2], "b"), (None, text[0], "c")], "doc_id long, text string, lang string")
    out = sorted(map(str, (tuple(r) for r in simhash.stage(spark, docs, "").collect())))
    assert out == sorted(map(str, [(1, text[0], "x"), (2, text[1], "a"), (None, text[2], "b")]))


def test_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7)], "a long, b long")
    assert sorted(map(tuple, components.components(links).collect())) == sorted([(i, 0) for i in range(1, 61)] + [(101, 100)])
    assert components.components(links.limit(0)).count() == 0


def hits(text, items):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    cover, found = set(), set()
    for name, phrases in items:
        for p in phrases:
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    cover.update(range(k, k + len(p)))
                    found.add(name)
    return len(w), len(cover), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_decontamination_edges(spark):
    long = " ".join(f"w{i}" for i in range(25))
    items = [(1, long), (2, "Short ITEM"), (3, None), (4, ""), (None, "lonely"), (5, "Short item"), (5, "été là")]
    docs = [(1, f"x {long} y {long}"), (2, None), (3, ""), (None, "a short, item! and short. ITEM"), (4, " ".join(f"w{i}" for i in range(9))), (5, "ÉTÉ là été LÀ lonely"), (5, "ÉTÉ là été LÀ lonely"), (6, long[:-4] + " " + long * 40)]
    phrases = []
    for name, text in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        phrases.append(("" if name is None else str(name), [w[k : k + 10] for k in range(max(1, len(w) - 9))] if w else []))
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as items", "2 as n_hit")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 24, 40):
        decontamination.BLOCK_BYTES = block
        out = decontamination.contamination(spark, df, bench).collect()
        got = Counter((r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) for r in out)
        assert got == Counter((d, *hits(t, phrases)) for d, t in docs)
    decontamination.BLOCK_BYTES = 16 << 20
    assert decontamination.contamination(spark, df.limit(0), bench).count() == 0
    assert {r.n_hit for r in decontamination.contamination(spark, df, bench.limit(0)).collect()} == {0}


def test_decontamination_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = decontamination.query(spark, sf).toPandas()
    want = con.execute(decontamination.ORACLE).df()[list(got.columns)]
    key = list(got.columns)
    assert got.sort_values(key).astype(str).values.tolist() == want.sort_values(key).astype(str).values.tolist()


def test_fm_index_ranks_and_positions():
    rng = np.random.default_rng(4)
    text = rng.integers(0, 4, 400)
    text[-1] = 0
    index = decontamination.FmIndex(text, 3)
    for n in (1, 2, 5):
        phrases = rng.integers(1, 4, (30, n))
        lo, hi = index.search(phrases)
        for p, a, b in zip(phrases, lo, hi):
            want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want
