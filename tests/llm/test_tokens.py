"""Tokenising operators against the libraries on whole texts."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from querent.llm import packing, tables, token_counts, token_files

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", None, "Hello  World, it's 2024!", "Élan vital ÷ × ñ", "日本 İstanbul é ", "<|endoftext|>x <s> </s> ▁ a", " \n\t\n ", "a" * 9000, "word " * 3000, "Tab\tfeed\nline\x00\x1f", "Tab\tfeed\nline\x00\x1f"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 3 else None, t, "x", "y") for i, t in enumerate(TEXTS)] + [(2, "again 2", "x", "y"), (2, "Hello  World, it's 2024!", "x", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens string")


def word_ids(text, end):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_counts(spark, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sorted((str(r.doc_id), len((r.text or "").encode()), n := len(model.encode(r.text or "")), n > 4096) for r in docs.collect())
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(spark, docs, PIECES).collect())
    assert got == want


def test_length_table_holds_every_key():
    keys = np.random.default_rng(1).integers(1, 2**63, 5000, dtype=np.uint64) | np.uint64(1)
    table = token_counts.LengthTable(keys, np.arange(5000, dtype=np.int32))
    assert (table.get(keys) == np.arange(5000)).all()
    assert (table.get(keys ^ np.uint64(2)) == -1).all()


def test_files_round_trip(spark, docs):
    files = token_files.write_files(spark, docs, WORDS, shard_size=20_000)
    got = sorted((r.start, r.doc_id, r.n_tokens, bytes(r.ids)) for r in token_files.read_documents(spark, files).collect())
    rows = docs.collect()
    assert sorted((str(d), crc(np.frombuffer(x, "<u4"))) for _, d, _, x in got) == sorted((str(r.doc_id), crc(word_ids(r.text, 1))) for r in rows)
    at, last = 0, None
    for start, doc_id, n, ids in got:
        assert start == at and len(ids) == 4 * n
        assert last is None or doc_id >= last
        at, last = at + n, doc_id


def test_lookup_reads_only_its_documents(spark):
    """Over many shards, with keys in several of them, null keys and keys that are not there."""
    rows = [(7 * i, f"text {i} " * (1 + i % 40)) for i in range(3000)] + [(None, "no key"), (None, "none either")] + [(700, f"again {i} " * 300) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    files = token_files.write_files(spark, df, WORDS, shard_size=30_000)
    reader = token_files.Reader(files)
    want = defaultdict(list)
    for k, t in rows:
        want[k].append(t)
    total = files.shards.agg({"n_ids": "sum"}).first()[0]
    assert len(reader.places) > 8
    assert sum(f == r for f, r in zip(reader.first[1:], reader.last)) >= 1  # a key in several shards
    for key in (0, 7, 6993, 2100, 700, None, 20993, 3, -5, 10**9):
        before = reader.bytes_read
        held = len(reader.held)
        found = reader.get(key)
        assert sorted(crc(x) for x in found) == sorted(crc(word_ids(t, 1)) for t in want.get(key, ()))
        opened = len(reader.held) - held
        payload = sum(2 * len(x) for x in found)
        # a head for each file that was opened, and for each file some words of the index and the offsets
        assert reader.bytes_read - before <= payload + 8 * len(found) + (opened + 4) * 700
    assert reader.bytes_read < 0.3 * total * 2 + 100_000
    some = token_files.lookup(files, [14, 15])
    assert [crc(x) for x in some[14]] == [crc(word_ids("text 2 " * 3, 1))] and some[15] == []


def test_a_file_is_written_once_more_with_the_same_bytes(tmp_path):
    import pyarrow as pa

    keys, ids = pa.array([1, 2, 2, None]), np.arange(9, dtype="<u2")
    data = token_files.shard_bytes(keys, ids, np.array([0, 2, 4, 8, 9]))
    for _ in range(2):
        token_files.store(f"file://{tmp_path}/x/1.ids", data)
    assert [p.name for p in (tmp_path / "x").iterdir()] == ["1.ids"] and (tmp_path / "x/1.ids").read_bytes() == data
    with token_files.opened(f"file://{tmp_path}/x/1.ids") as file:
        shard = token_files.Shard(file)
        assert [shard.find(k) for k in (1, 2, None, 3)] == [(0, 1), (1, 2), (3, 1), (0, 0)]
        assert [x.tolist() for x in shard.documents(1, 2)] == [[2, 3], [4, 5, 6, 7]]


@pytest.mark.parametrize("n", [0, 1, 2, 100, 40_000])
def test_perfect_hash_is_minimal(n):
    h = np.unique(np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64))
    index = token_files.PerfectHash.build(h)
    assert sorted(index.slot(h).tolist()) == list(range(n))
    index = token_files.PerfectHash(np.array([8]), index.words[:1] if n else index.words, np.sort(h))  # keys that no level took
    assert n != 1 or index.slot(h[:1]).tolist() in ([0], [1])


def check_pieces(rows, docs, window=4096):
    ids_of = defaultdict(list)
    for r in docs:
        ids_of[str(r.doc_id)].append(word_ids(r.text, 2))
    per_doc, per_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        per_doc[str(r.doc_id)].append(r)
        per_sequence[r.sequence_id].append((r.offset, r.length))
    for key, group in ids_of.items():
        assert sum(r.length for r in per_doc[key]) == sum(map(len, group))
        for r in per_doc[key]:
            assert any(len(ids) == r.doc_tokens and crc(ids[r.start : r.start + r.length]) == r.ids_crc32 for ids in group)
        if len(group) == 1:
            at = 0
            for r in sorted(per_doc[key], key=lambda r: r.start):
                assert r.start == at
                at += r.length
    for parts in per_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= window and at & (at - 1) == 0


def test_packing(spark, docs):
    check_pieces(packing.digest(packing.pack(spark, docs, WORDS)).collect(), docs.collect())


def test_plan_covers_every_token_once():
    rng = np.random.default_rng(5)
    for n in (0, 1, 3, 50, 400):
        lengths = rng.integers(1, 9000, n).tolist()
        segments = [(d, 0, x) for d, x in enumerate(lengths)]
        some, rest = packing.plan(segments[: n // 2], last=False)
        assert all(sum(x[2] for x in w) in packing.TIERS for w in some)
        more, left = packing.plan(rest + segments[n // 2 :])
        windows = some + more
        assert not left
        seen = sorted(x for w in windows for x in w)
        for d, size in enumerate(lengths):
            at = 0
            for _, start, length in (x for x in seen if x[0] == d):
                assert start == at
                at += length
            assert at == size
        assert all((t := sum(x[2] for x in w)) <= 4096 and t & (t - 1) == 0 for w in windows)
        if n >= 50:
            assert sum(sum(x[2] for x in w) == 4096 for w in windows) >= 0.5 * sum(lengths) / 4096


def test_step_groups_are_balanced(spark, monkeypatch):
    """Over all tasks: one size in a group, equal totals but for the last of a size; and no windows under a tier but at a task's end."""
    monkeypatch.setattr(packing, "BATCH_BYTES", 60_000)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(3)
    rows = packing.digest(packing.pack(spark, docs, WORDS)).where("offset = 0").collect()
    size, groups = {r.sequence_id: r.sequence_length for r in rows}, defaultdict(list)
    for r in rows:
        groups[r.step_group].append(size[r.sequence_id])
    totals = defaultdict(list)
    for group in groups.values():
        assert len(set(group)) == 1
        totals[group[0]].append(sum(group))
    for sums in totals.values():
        assert sorted(sums)[1:] == [packing.STEP_TOKENS] * (len(sums) - 1) and max(sums) <= packing.STEP_TOKENS
    assert {s >> 40 for s in size} == {0, 1, 2}
    assert sum(s < packing.TIERS[0] for s in size.values()) <= 3 * 9


def test_packing_does_not_depend_on_arrow_batches(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = []
    for n in (7, 10_000):
        with tables.batches(spark, n):
            out.append(sorted(packing.digest(packing.pack(spark, docs, WORDS)).collect()))
    assert out[0] == out[1]


def test_empty_table(spark, docs):
    empty = docs.limit(0)
    assert token_counts.token_counts(spark, empty, PIECES).count() == 0
    assert packing.pack(spark, empty, WORDS).count() == 0
    assert token_files.read_documents(spark, token_files.write_files(spark, empty, WORDS)).count() == 0
