"""Strings that collide in any polynomial hash modulo a power of two are kept apart by every operator."""

import numpy as np
import public_tokenizers
import pytest

from querent.llm import bpe, decontamination, quality, textbatch, token_counts
from querent.llm import language_model as lm


def complements(letters="ab", n=10):
    """A Thue-Morse string of 2**n letters and its complement."""
    swap = str.maketrans(letters, letters[::-1])
    out = letters[0]
    for _ in range(n):
        out += out.translate(swap)
    return out, out.translate(swap)


def buffer(*texts):
    parts = [t.encode() for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def test_hash_tells_complements_apart():
    for n in (10, 11, 14):
        buf, off = buffer(*complements(n=n))
        h = textbatch.span_hash(textbatch.byte_sums(buf), off[:-1], off[1:])
        assert h[0] != h[1]


def test_equal_spans_have_equal_hashes_in_any_buffer(monkeypatch):
    rng = np.random.default_rng(5)
    buf = rng.integers(97, 99, 5000).astype(np.uint8)
    start = rng.integers(0, 4900, 3000)
    end = start + rng.integers(0, 12, 3000)
    whole = textbatch.span_hash(textbatch.byte_sums(buf), start, end)
    monkeypatch.setattr(textbatch, "BLOCK", 256)  # several blocks
    assert (textbatch.span_hash(textbatch.byte_sums(buf), start, end) == whole).all()
    strings = [buf[a:b].tobytes() for a, b in zip(start, end)]
    assert len(set(zip(strings, whole.tolist()))) == len(set(strings)) == len(set(whole.tolist()))
    values = rng.integers(0, 2**63, 40, dtype=np.uint64)
    sums = textbatch.prefix(np.concatenate([values, values]))
    a, b = np.arange(40), np.arange(40) + 40
    assert (textbatch.span_hash(sums, a[:-3], a[3:]) == textbatch.span_hash(sums, b[:-3], b[3:])).all()


@pytest.mark.parametrize("letters", ["ab", "xy"])
def test_tokens(letters):
    from tokenizers import Tokenizer

    words = complements(letters)
    path = public_tokenizers.path("word_bpe_49k.json")
    flat, at = bpe.WordBpe(path).encode(*buffer(*words))
    library = Tokenizer.from_file(path)
    assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == [library.encode(w, add_special_tokens=False).ids for w in words]
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert token_counts.Counter(path).counts(*buffer(*words)).tolist() == [len(model.encode(w)) for w in words]


def test_lines_and_windows():
    a, b = complements()
    rules, _, _ = quality.base(*buffer(f"{a}\n{b}", " ".join([a] * 8 + [b] * 8), f"{a}\n{b}\n{a}"))
    assert rules["n_dup_lines"].tolist() == [0, 0, 1] and rules["n_repeat_words"].tolist() == [0, 0, 0]


def test_phrases():
    a, b = complements()
    raw, off = buffer(b, a)
    found = decontamination.Found(decontamination.Phrases(["1"], [a]), raw, off)
    assert found.text.tolist() == [1] and found.items == [set(), {"1"}]


def test_words_of_the_language_model():
    h, _ = lm.tokens(*buffer(*complements()))
    assert len(set(h.tolist())) == 3
