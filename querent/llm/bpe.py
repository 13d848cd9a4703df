"""Batch encoding with a byte-level BPE vocabulary that marks word ends, equal to the tokenizers library.

Runs of letters, single digits and runs of other marks are encoded together by vectorised merges, once per
distinct run of a batch. Words with anything outside ASCII and the letters U+00C0..U+00FF, with an apostrophe or
with a special token's first marks go through the library itself, word by word, with a worker cache: white space
always separates tokens, so words can be encoded apart.
"""

from __future__ import annotations

import functools
import json

import numpy as np

from querent.llm.textbatch import IS_SPACE, LOWER, byte_sums, expand, span_hash

NONE = np.int32(2**31 - 1)
CACHE_WORDS = 200_000
KNOWN_RUNS = 300_000

#: 0 space, 1 letter, 2 digit, 3 mark, 4 needs the library
KIND = np.full(256, 4, np.uint8)
KIND[33:127] = 3
KIND[48:58] = 2
KIND[65:91] = KIND[97:123] = KIND[0xC3] = 1
KIND[IS_SPACE] = 0
KIND[39] = 4


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PairTable:
    """Rank of a pair of ids in constant time: an open table, and a collision-free second one for what did not fit."""

    def __init__(self, keys: np.ndarray):
        self.first, rest = self._fill(keys, np.arange(len(keys), dtype=np.int32), 20, 0x9E3779B1)
        for mult in range(0x85EBCA6B, 0x85EBCA6B + 4000, 2):
            self.second, left = self._fill(keys[rest], rest.astype(np.int32), 18, mult)
            if not len(left):
                break
        else:
            raise ValueError("no collision-free table was found")

    @staticmethod
    def _fill(keys: np.ndarray, ranks: np.ndarray, bits: int, mult: int):
        slot = PairTable._slot(keys, bits, mult)
        table = np.full(1 << bits, 0xFFFFFFFF, np.uint32), np.full(1 << bits, NONE, np.int32), bits, mult
        table[0][slot[::-1]] = keys[::-1]
        held = table[0][slot] == keys
        table[1][slot[held]] = ranks[held]
        return table, np.flatnonzero(~held)

    @staticmethod
    def _slot(keys: np.ndarray, bits: int, mult: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys * np.uint32(mult)) >> np.uint32(32 - bits)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint32) << np.uint32(16)) | right.astype(np.uint32)
        out = None
        for table, ranks, bits, mult in (self.first, self.second):
            slot = self._slot(keys, bits, mult)
            got = np.where(table[slot] == keys, ranks[slot], NONE)
            out = got if out is None else np.minimum(out, got)
        return out


class WordBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        chars = byte_chars()
        self.inner = np.array([vocab[chars[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[chars[b] + suffix] for b in range(256)], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pairs = PairTable(np.array([(vocab[a] << 16) | vocab[b] for a, b in merges], np.uint32))
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.vocab_size = self.library.get_vocab_size()
        self.dtype = np.dtype("<u2") if self.vocab_size <= 1 << 16 else np.dtype("<u4")
        self.cache: dict[bytes, np.ndarray] = {}
        # runs met before, by hash; the first KNOWN_RUNS stay
        self.known = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.known_ids = np.zeros(0, np.int32)

    def runs(self, h: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of runs with distinct, sorted hashes: one array, and where in it each run's ids begin and how many they are."""
        keys, begin, count = self.known
        at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
        hit = keys[at] == h if len(keys) else np.zeros(len(h), bool)
        new = np.flatnonzero(~hit)
        ids, n = self.merged(buf, start[new], end[new])
        first, size = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        first[hit], size[hit] = begin[at[hit]], count[at[hit]]
        first[new], size[new] = len(self.known_ids) + np.cumsum(n) - n, n
        ids = np.concatenate([self.known_ids, ids])
        if len(keys) + len(new) <= KNOWN_RUNS:
            keys = np.concatenate([keys, h[new]])
            order = np.argsort(keys, kind="stable")
            self.known = keys[order], np.concatenate([begin, first[new]])[order], np.concatenate([count, n])[order]
            self.known_ids = ids
        return ids, first, size

    def slow(self, word: bytes) -> np.ndarray:
        ids = self.cache.get(word)
        if ids is None:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            ids = np.array(self.library.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, np.int32)
            self.cache[word] = ids
        return ids

    def merged(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs of bytes: one flat array, and the number of ids of each run."""
        size, parts, counts = end - start, {}, np.zeros(len(start), np.int64)
        width, lo = 1, 0
        while lo < size.max(initial=0):
            rows = np.flatnonzero((size > lo) & (size <= width))
            # a long run is worked on with few others at a time
            for at in range(0, len(rows), max(1, (1 << 21) // width)):
                r = rows[at : at + max(1, (1 << 21) // width)]
                ids, counts[r] = self._merged(buf, start[r], size[r], width)
                parts[(lo, at)] = r, ids
            lo, width = width, width * 2 if width > 1 else 2
        out = np.zeros(int(counts.sum()), np.int32)
        first = np.cumsum(counts) - counts
        for r, ids in parts.values():
            out[expand(first[r], counts[r])] = ids
        return out, counts

    def _merged(self, buf, start, size, width):
        n, cols = len(start), np.arange(width)
        live = cols < size[:, None]
        at = np.minimum(start[:, None] + cols, len(buf) - 1)
        sym = np.where(cols == size[:, None] - 1, self.last[buf[at]], self.inner[buf[at]]).astype(np.int32)
        if width > 1:
            step = width + 1
            sym = np.concatenate([sym, np.zeros((n, 1), np.int32)], 1).ravel()
            rank = np.full((n, step), NONE, np.int32)
            rank[:, : width - 1] = np.where(live[:, 1:], self.pairs.rank(sym.reshape(n, step)[:, : width - 1], sym.reshape(n, step)[:, 1:width]), NONE)
            nxt = np.tile(np.arange(1, step + 1, dtype=np.int32), (n, 1)).ravel()
            prv = np.tile(np.arange(-1, step - 1, dtype=np.int32), (n, 1)).ravel()
            dead = np.zeros(n * step, bool)
            rows = np.arange(n)
            flat = rank.ravel()
            while len(rows):
                best = rank[rows].argmin(1) if len(rows) < n else rank.argmin(1)
                base = rows * step
                pos = base + best
                r = flat[pos]
                go = r != NONE
                if not go.all():
                    rows, base, best, pos, r = rows[go], base[go], best[go], pos[go], r[go]
                    if not len(rows):
                        break
                sym[pos] = self.made[r]
                j = base + nxt[pos]
                after = nxt[j]
                dead[j] = True
                flat[j] = NONE
                nxt[pos] = after
                end = after >= size[rows]
                k = base + np.minimum(after, width)
                prv[k] = best
                flat[pos] = np.where(end, NONE, self.pairs.rank(sym[pos], sym[k]))
                before = prv[pos]
                has = before >= 0
                p = (base + before)[has]
                flat[p] = self.pairs.rank(sym[p], sym[pos[has]])
            sym = sym.reshape(n, step)[:, :width]
            live &= ~dead.reshape(n, step)[:, :width]
        return sym[live], live.sum(1)

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a buffer, one after the other, and the offsets of each text's ids."""
        n = len(raw)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        kind = KIND[raw]
        buf = LOWER[raw]
        # a letter U+00C0..U+00FF is two bytes; U+00D7 and U+00F7 are not letters
        lead = np.flatnonzero(raw == 0xC3)
        lead = lead[lead + 1 < n]
        tail = raw[lead + 1]
        good = (tail >= 0x80) & (tail <= 0xBF) & (tail != 0x97) & (tail != 0xB7)
        kind[lead[good] + 1] = 1
        kind[lead[~good]] = 4
        upper = lead[good & (tail <= 0x9E)] + 1
        buf[upper] += 0x20
        special = np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124))
        kind[special] = 4
        new = np.zeros(n + 1, bool)
        new[off] = True
        new = new[:n]
        space = kind == 0
        first = ~space & new
        first[1:] |= ~space[1:] & space[:-1]
        odd = np.flatnonzero(kind == 4)
        slow_start = slow_end = np.zeros(0, np.int64)
        if len(odd):
            word_start = np.flatnonzero(first)
            last = ~space
            last[:-1] &= space[1:] | new[1:]
            word_end = np.flatnonzero(last) + 1
            which = np.unique(np.searchsorted(word_start, odd, "right") - 1)
            slow_start, slow_end = word_start[which], word_end[which]
            inside = np.zeros(n + 1, np.int32)
            np.add.at(inside, slow_start, 1)
            np.add.at(inside, slow_end, -1)
            kind[np.cumsum(inside)[:n] > 0] = 0
            first[slow_start] = False
        change = np.ones(n, bool)
        change[1:] = kind[1:] != kind[:-1]
        begin = (kind != 0) & (change | new | first | (kind == 2))
        start = np.flatnonzero(begin)
        stop = np.ones(n, bool)
        stop[:-1] = begin[1:] | (kind[1:] != kind[:-1]) | new[1:]
        end = np.flatnonzero((kind != 0) & stop) + 1
        h = span_hash(byte_sums(buf), start, end)
        distinct, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        ids, begin_at, counts = self.runs(distinct, buf, start[at], end[at])
        where, row = start, inverse
        if len(slow_start):
            data = raw.tobytes()
            index: dict[bytes, int] = {}
            rows = np.fromiter((index.setdefault(data[a:b], len(index)) for a, b in zip(slow_start.tolist(), slow_end.tolist())), np.int64, len(slow_start))
            extra = [self.slow(w) for w in index]
            row = np.concatenate([inverse, rows + len(counts)])
            where = np.concatenate([start, slow_start])
            order = np.argsort(where, kind="stable")
            where, row = where[order], row[order]
            more = np.array([len(x) for x in extra], np.int64)
            begin_at = np.concatenate([begin_at, len(ids) + np.cumsum(more) - more])
            ids = np.concatenate([ids, *extra])
            counts = np.concatenate([counts, more])
        lens = counts[row]
        flat = ids[expand(begin_at[row], lens)] if len(row) else np.zeros(0, np.int32)
        total = np.concatenate([[0], np.cumsum(lens)])
        return flat, total[np.searchsorted(where, off)]


@functools.lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One encoder for each Python worker."""
    return WordBpe(path)
