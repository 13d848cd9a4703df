"""The pipeline's stages, each on its own input, against brute force; the whole keeps clean documents."""

import re
from collections import Counter

import public_tokenizers
import pytest

import corpus_pipeline
from querent.llm import decontamination, simhash, suffix_dedup, tables, toxicity
from tests.llm.test_duplicates import LOWER, fingerprint, groups
from tests.llm.test_suffix_dedup import brute
from tests.llm.test_tokens import check_pieces

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = tables.table(spark, SF, "documents")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = tables.stored(stage(spark, docs, SF))
        out.append(docs)
    return out


def test_columns(steps):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_toxicity(spark, steps):
    bad = {r.doc_id for r in toxicity.query(spark, SF).where("predicted = 1").collect()}
    assert {r.doc_id for r in steps[1].collect()} == {r.doc_id for r in steps[0].collect()} - bad


def test_simhash(steps):
    rows = sorted(steps[1].collect())
    label = groups([fingerprint(r.text) for r in rows]).tolist()
    assert sorted(steps[2].collect()) == [r for i, r in enumerate(rows) if label.index(label[i]) == i]


def test_suffix_dedup(steps):
    rows = steps[2].collect()
    want = Counter((r.doc_id, r.lang, x[3].decode("utf-8", "ignore")) for r, x in zip(rows, brute([r.text for r in rows])))
    assert Counter((r.doc_id, r.lang, r.text) for r in steps[3].collect()) == want


def test_decontaminate(spark, steps):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    phrases = set()
    for r in tables.table(spark, SF, "benchmark").collect():
        w = re.findall(pattern, r.text.translate(LOWER))
        phrases |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))}
    want = Counter()
    for r in steps[3].collect():
        found = list(re.finditer(pattern, r.text.translate(LOWER)))
        hit = set()
        for n in {len(p) for p in phrases}:
            for k in range(len(found) - n + 1):
                if tuple(m[0] for m in found[k : k + n]) in phrases:
                    hit.update(range(k, k + n))
        out, at = "", 0
        for k, m in enumerate(found):
            if k in hit:
                out += r.text[at : m.start()] if k - 1 not in hit else ""
                at = m.end()
        out += r.text[at:]
        want[(r.doc_id, out, len(out) if hit else r.n_chars)] += 1
    assert Counter((r.doc_id, r.text, r.n_chars) for r in steps[4].collect()) == want


def test_pack_and_run(spark, steps):
    check_pieces(steps[5].collect(), steps[4].collect())
    key = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(corpus_pipeline.run(spark, SF).groupBy("doc_id").agg({"length": "sum"}).collect()) == sorted(steps[5].groupBy("doc_id").agg({"length": "sum"}).collect())
    assert set(key) <= set(steps[5].columns) and public_tokenizers.path("word_bpe_49k.json")


def test_stages_on_edges(spark):
    rows = [(1, None, "en", None, 0), (None, "", None, "s", None), (2, "x" * 800, "en", "s", 800), (2, "x" * 800, "en", "s", 800), (3, "clean words here", "en", "s", 16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for stage in (toxicity.stage, simhash.stage, suffix_dedup.stage, decontamination.stage):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert {r.doc_id for r in out.collect()} >= {1, 2, 3} or stage is simhash.stage
        assert stage(spark, docs.limit(0), SF).count() == 0
    kept = sorted((str(r.doc_id), r.text) for r in simhash.stage(spark, docs, SF).collect())
    assert kept == [("1", None), ("2", "x" * 800), ("3", "clean words here")]
