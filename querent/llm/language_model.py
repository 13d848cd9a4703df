"""Operator 3: perplexity under a hierarchical Pitman-Yor model of words.

Every word (and the end of a text) that occurs in the training texts is the context of a Chinese restaurant whose dishes
are the words that follow it; all restaurants share one parent, whose customers are their tables and whose base is
uniform over the known words and one unknown word. No word, context or pair is left out, so the restaurants grow with
the corpus. Seatings are sampled by Gibbs sweeps over all customers: a dish's number of tables is drawn from its exact
distribution given the others, however many customers it has; restaurants are drawn in parallel against their parent's
last state, then the parent against theirs. Predictive probabilities are averaged over the last sweeps.

Restaurants stand in groups by the context's hash; a context with more customers than a group should hold is spread over
several groups by the dish, which are independent given the restaurant's number of tables. Groups send the parent their
table counts and get back those of their dishes, as packed arrays. Scoring sends each text's pairs to the groups.
Pairs that are most frequent in the training texts are scored where the texts are read, from a broadcast table.

Words frequent in a fixed share of the texts, chosen by hash, have short codes; codes and groups do not depend on how the
table is partitioned, and neither do the scores.

Defined results: a null or empty text has its end alone; null doc_ids train; repeated rows count and score each; without
training texts all scores are 0; an empty table gives no rows; other columns are ignored. Words are compared by 63-bit
hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.llm import packed, tables
from querent.llm.packed import RARE, join_codes, pack, split_codes
from querent.llm.seating import new_table_weight, table_counts
from querent.llm.textbatch import IS_PLAIN, LOWER, byte_sums, expand, give_memory_back, joined, mix, owner, pieces, span_hash, sums_by, words

#: words with short codes, at most, and the share of the texts in which they are looked for; scores do not depend on it
FREQUENT = 1 << 17
SAMPLE = 16
#: training tokens of a group of restaurants, and of a context in one group, about
GROUP_TOKENS = 1 << 21
CONTEXT_TOKENS = 1 << 18
#: pairs in the broadcast table, at most
TOP_PAIRS = 1 << 20
#: sweeps, and how many of the last are averaged
SWEEPS = 3
KEPT = 2
#: strengths of the restaurants and of their parent
STRENGTH = 5.0
PARENT_STRENGTH = 5.0
#: training tokens that are counted at once; half as many are scored at once
FLUSH_TOKENS = 1 << 21
END = np.uint64(0xE4D0F7E474E4D001)
SPREAD = np.uint64(0x9E3779B97F4A7C15)

#: kinds of packed rows; within a group they come in this order
STATIC, WORK, STATE, REPLY, ASK, PAIRS, ENTRY, HEAD, SUM, HOP, HOT, TOTALS, WORDS, TOP = range(14)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))


def keyed(docs: DataFrame) -> DataFrame:
    """uid, text, doc_id, held_out; equal rows have one uid."""
    return tables.texts(docs).select(F.xxhash64("doc_id", "text").alias("uid"), "text", "doc_id", held_out().alias("held_out"))


def tokens(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of texts, each text's end last, and offsets."""
    buf = LOWER[raw]
    starts, ends, of = words(buf, off, IS_PLAIN)
    h = span_hash(byte_sums(buf), starts, ends)
    return np.insert(h, of[1:], END), of + np.arange(len(of))


def sampled_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in joined(batches, 0):
        for _, _, buf, off in pieces(batch.column(0)):
            u, n = np.unique(tokens(buf, off)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], names=["h", "n"])


class Codes:
    """Codes of words: the rank of frequent ones, a hash with the top bit set for all others; and the groups of pairs."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int):
        order = np.argsort(hashes)
        self.hashes, self.rank = hashes[order], order.astype(np.uint64)
        self.parts = np.maximum(1, -(-counts // CONTEXT_TOKENS)).astype(np.uint64)
        self.groups = max(1, round(total / GROUP_TOKENS))
        self.parents = max(1, self.groups // 4)
        self.end = self.of(np.array([END]))[0]

    def of(self, h: np.ndarray) -> np.ndarray:
        out = h | RARE
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            out = np.where(self.hashes[at] == h, self.rank[at], out)
        return out

    def spread(self, before: np.ndarray) -> np.ndarray:
        """In how many groups a context may stand."""
        out = np.ones(len(before), np.uint64)
        known = before < RARE
        out[known] = self.parts[before[known].astype(np.int64)]
        return out

    def group(self, before: np.ndarray, code: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            part = mix(code * SPREAD + np.uint64(7)) % self.spread(before)
            return ((mix(before + np.uint64(11)) + part * SPREAD) % np.uint64(self.groups)).astype(np.int64)

    def parent(self, code: np.ndarray) -> np.ndarray:
        """The group of the parent's dishes that holds a word."""
        with np.errstate(over="ignore"):
            return (mix(code * SPREAD + np.uint64(13)) % np.uint64(self.parents)).astype(np.int64)

    def row(self, uid: np.ndarray) -> np.ndarray:
        """The group in which a row's sums meet."""
        return (mix(uid) % np.uint64(self.parents)).astype(np.int64)


def numbered(codes: Codes, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct codes of tokens in order, each token's number among them, and that of the token before it."""
    coded = pa.array(h).dictionary_encode()
    code = codes.of(np.asarray(coded.dictionary))
    order = np.argsort(code)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    ids = place[np.asarray(coded.indices)]
    del coded
    code = code[order]
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[at[:-1]] = np.searchsorted(code, codes.end)
    return code, ids, before


def starts_of(sorted_values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)


def run_lengths(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a sorted array and the lengths of their runs."""
    first = starts_of(values)
    return values[first], np.diff(np.append(first, len(values)))


def by_group(group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each group and its places, in order."""
    order = np.argsort(group.astype(np.uint16) if len(group) and group.max() < 1 << 16 else group, kind="stable")
    names, sizes = run_lengths(group[order])
    for g, lo, n in zip(names.tolist(), (np.cumsum(sizes) - sizes).tolist(), sizes.tolist()):
        yield g, order[lo : lo + n]


def flushed(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """Tokens and offsets of about so many tokens of texts at a time, and the slices of the batches that they come from."""
    held, at, of = [], [0], []
    for batch in joined(batches, column):
        for lo, hi, buf, off in pieces(batch.column(column)):
            h, o = tokens(buf, off)
            held.append(h)
            of.append(batch.slice(lo, hi - lo))
            at.extend((o[1:] + at[-1]).tolist())
            if at[-1] >= size:
                yield np.concatenate(held), np.array(at), of
                held, at, of = [], [0], []
                give_memory_back()
    if held:
        yield np.concatenate(held), np.array(at), of


def pair_counts(shared):
    """PAIRS rows of training texts: contexts, runs, words and counts, for each group of restaurants."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: Codes = shared.value
        for h, at, _ in flushed(batches, 0, FLUSH_TOKENS):
            code, ids, before = numbered(codes, h, at)
            before <<= 32
            before |= ids
            del h, ids
            pair = before
            pair.sort()
            first = starts_of(pair)
            n = np.diff(np.append(first, len(pair)))
            u, w = code[pair[first] >> 32], code[pair[first] & 0xFFFFFFFF]
            for g, rows in by_group(codes.group(u, w)):
                names, runs = run_lengths(u[rows])
                yield packed.record([(PAIRS, g, 0, pack(*split_codes(names), runs, *split_codes(w[rows]), n[rows]))])

    return run


def asked(codes: Codes, group: int, code: np.ndarray, *sums: np.ndarray) -> list[packed.Row]:
    """ASK rows of a group: the words and what it has of each, for each group of the parent's dishes."""
    return [(ASK, j, group, pack(*split_codes(code[rows]), *[s[rows] for s in sums])) for j, rows in by_group(codes.parent(code))]


def answers(codes: Codes, code: np.ndarray, replies: dict[int, list[np.ndarray]], width: int) -> list[np.ndarray]:
    """Replies of all groups of the parent's dishes, in the order of the words that were asked for."""
    out = [np.zeros(len(code), np.int64) for _ in range(width)]
    for j, rows in by_group(codes.parent(code)):
        for k in range(width):
            out[k][rows] = replies[j][k]
    return out


def sums_over(values: np.ndarray, runs: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, np.cumsum(runs) - runs) if len(runs) else np.zeros(0, np.int64)


def opened(shared):
    """Restaurants of a group from its PAIRS, each dish at one table."""

    def work(group: int, rows) -> Iterator[pa.RecordBatch]:
        codes: Codes = shared.value
        us, ws, ns = [], [], []
        for _, _, x in rows:
            us.append(np.repeat(join_codes(*x[:3]), x[3].astype(np.int64)))
            ws.append(join_codes(*x[4:7]))
            ns.append(x[7].astype(np.int64))
        u, ui = np.unique(np.concatenate(us), return_inverse=True)
        w, wi = np.unique(np.concatenate(ws), return_inverse=True)
        pair = ui << 32 | wi
        order = np.argsort(pair)
        first = starts_of(pair[order])
        c = np.add.reduceat(np.concatenate(ns)[order], first)
        pair = pair[order][first]
        _, runs = run_lengths(pair >> 32)
        at = pair & 0xFFFFFFFF
        yield packed.record([(STATIC, group, group, pack(*split_codes(u), runs, *split_codes(w), at, c))])
        one = c == 1
        dishes, customers = np.bincount(at, minlength=len(w)), np.bincount(at, weights=c, minlength=len(w)).astype(np.int64)
        for row in asked(codes, group, w, dishes, np.bincount(at[one], minlength=len(w)), customers):
            yield packed.record([row])
        some = np.flatnonzero(~one)
        ctx, sizes = run_lengths((pair >> 32)[some])
        used, at = np.unique(at[some], return_inverse=True)
        ones = sums_over(one.astype(np.int64), runs)
        yield packed.record([(WORK, group, group, pack(*split_codes(u[ctx]), sizes, ones[ctx], sums_over(c, runs)[ctx], *split_codes(w[used]), at, c[some], np.ones(len(some), np.int64)))])
        hot = np.flatnonzero(codes.spread(u) > 1)
        types = np.array([np.count_nonzero(c == 1), np.count_nonzero(c == 2)])
        # how many pairs of frequent words have each count
        value, number = np.unique(c[(np.repeat(u, runs) < RARE) & (w[pair & 0xFFFFFFFF] < RARE)], return_counts=True)
        yield packed.record([(HOT, 0, group, pack(u[hot], sums_over(c, runs)[hot], runs[hot])), (TOTALS, 0, group, pack(types, value, number))])

    return work


def seated(shared, sweep: int, discount: float, keep: int):
    """A sweep over a group's dishes of more than one customer, against the parent's last state."""

    def work(group: int, rows) -> Iterator[pa.RecordBatch]:
        codes, parent, hot = shared.value
        replies, x = {}, None
        for kind, source, arrays in rows:
            if kind == WORK:
                x = arrays
            else:
                replies[source] = arrays
        u, runs, ones, cu = join_codes(*x[:3]), *(a.astype(np.int64) for a in x[3:6])
        w, at, c = join_codes(*x[6:9]), x[9].astype(np.int64), x[10].astype(np.int64)
        seats = [a.astype(np.int64) for a in x[11:]]  # the last state, and before it those that are kept
        base = parent.base(*answers(codes, w, replies, 2))[at]
        t, rng = seats[-1], np.random.default_rng([group, sweep, 77])
        where, of = np.searchsorted(hot.codes, u), np.repeat(np.arange(len(u)), runs)
        wide = hot.found(u, where)
        weight = new_table_weight(ones + sums_over(t, runs), discount, STRENGTH, rng)
        weight[wide] = hot.weight[where[wide]]
        t = table_counts(c, t, np.maximum(weight[of] * base, 1e-300), discount, rng)
        seats = [*(seats if keep else []), t]
        yield packed.record([(WORK, group, group, pack(*x[:11], *seats))])
        for row in asked(codes, group, w, np.bincount(at, weights=t, minlength=len(w)).astype(np.int64)):
            yield packed.record([row])
        mine = np.flatnonzero(codes.spread(u) > 1)
        yield packed.record([(HOT, 0, group, pack(u[mine], np.zeros(len(mine), np.int64), (ones + sums_over(t, runs))[mine]))])

    return work


def parent_opened(group: int, rows) -> Iterator[pa.RecordBatch]:
    """The parent's dishes of a group, each at one table: its customers, those of dishes with one customer, and its training count.

    Sweeps ask for the words of which a group has a dish of more customers."""
    parts = [(source, join_codes(*x[:3]), *(a.astype(np.int64) for a in x[3:])) for _, source, x in rows]
    code, inverse = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
    customers, ones, count = (np.bincount(inverse, weights=np.concatenate([p[k] for p in parts]), minlength=len(code)).astype(np.int64) for k in (2, 3, 4))
    yield from replied(group, code, ones, count, [customers, np.ones(len(code), np.int64)], [(p[0], p[1][p[2] > p[3]]) for p in parts], 2)


def replied(group: int, code, ones, count, states: list, questions: list, width: int) -> Iterator[pa.RecordBatch]:
    """STATE, TOTALS and REPLY rows of a group of the parent's dishes; replies hold the last `width` states."""
    yield packed.record([(STATE, group, group, pack(*split_codes(code), ones, count, *states))])
    customers, t = states[-2:]
    yield packed.record([(TOTALS, 0, group, pack(np.array([len(code), count.sum(), customers.sum(), t.sum(), np.count_nonzero(customers == 1), np.count_nonzero(customers == 2)])))])
    for source, some in questions:
        at = np.searchsorted(code, some)
        yield packed.record([(REPLY, source, group, pack(*[s[at] for s in states[-width:]]))])


def parent_seated(sweep: int, discount: float, weight: float, keep: int):
    """A sweep over the parent's dishes of a group; weight is that of a new table."""

    def work(group: int, rows) -> Iterator[pa.RecordBatch]:
        questions, state = [], None
        for kind, source, x in rows:
            if kind == STATE:
                code, (ones, count, *state) = join_codes(*x[:3]), (a.astype(np.int64) for a in x[3:])
                customers = ones.copy()
            else:
                some = join_codes(*x[:3])
                questions.append((source, some))
                customers[np.searchsorted(code, some)] += x[3].astype(np.int64)
        t = np.clip(state[-1], 1, customers)
        t = table_counts(customers, t, np.full(len(customers), max(weight, 1e-300)), discount, np.random.default_rng([group, sweep, 78]))
        yield from replied(group, code, ones, count, [*(state if keep else []), customers, t], questions, 2)

    return work


def parent_told(groups: int, kept: int):
    """REPLY rows of all kept states and the count of each word that a group's restaurants have; and WORDS, the frequent words."""

    def work(group: int, rows) -> Iterator[pa.RecordBatch]:
        for kind, source, x in rows:
            if kind == STATE:
                code, (_, count, *state) = join_codes(*x[:3]), (a.astype(np.int64) for a in x[3:])
                some = np.flatnonzero(code < RARE)
                yield packed.record([(WORDS, 0, group, pack(code[some], count[some], *[s[some] for s in state[-2 * kept :]]))])
            else:
                at = np.searchsorted(code, join_codes(*x[:3]))
                yield packed.record([(REPLY, source, group, pack(count[at], *[s[at] for s in state[-2 * kept :]]))])

    return work


@dataclass
class Parent:
    """The parent restaurant as a whole: types, training tokens, customers and tables."""

    types: int = 0
    tokens: int = 0
    customers: int = 0
    tables: int = 0
    discount: float = 0.5

    def base(self, customers: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Probabilities of words with so many customers and tables, 0 for the unknown word."""
        spare = (PARENT_STRENGTH + self.discount * self.tables) / (self.types + 1)
        return (customers - self.discount * t + spare) / (PARENT_STRENGTH + self.customers)


@dataclass
class Hot:
    """Contexts that stand in several groups: customers, tables, and the weight of a new table."""

    codes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    customers: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    tables: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def found(self, u: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Which of u are among the codes, with their places from a search."""
        if not len(self.codes):
            return np.zeros(len(u), bool)
        return self.codes[np.minimum(where, len(self.codes) - 1)] == u


@dataclass
class Model:
    """What all workers know of the trained model."""

    codes: Codes
    discount: float
    parents: list[Parent]  # of the kept sweeps
    hot: list[Hot]
    counts: np.ndarray  # training counts of the frequent words, 0 where a code has none
    base: np.ndarray  # their probabilities in the parent, by kept sweep
    top: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # frequent pairs (code << 32 | code) in order
    log_top: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def share(self, customers: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The part that a restaurant leaves to its parent."""
        return (STRENGTH + self.discount * t) / (STRENGTH + customers)

    def shares_without(self, u: np.ndarray) -> np.ndarray:
        """By kept sweep, the parent's part in contexts that a group does not hold."""
        out = np.ones((len(self.hot), len(u)))
        for k, hot in enumerate(self.hot):
            where = np.searchsorted(hot.codes, u)
            wide = hot.found(u, where)
            out[k, wide] = self.share(hot.customers[where[wide]], hot.tables[where[wide]])
        return out


class Restaurants:
    """A group's restaurants after training, for lookups."""

    def __init__(self, model: Model, static: list, work: list, replies: dict):
        self.model = model
        self.u, self.w = join_codes(*static[:3]), join_codes(*static[4:7])
        runs, at, self.c = (static[k].astype(np.int64) for k in (3, 7, 8))
        self.of = np.repeat(np.arange(len(self.u)), runs)
        self.pair = self.of << 32 | at
        kept = len(model.parents)
        self.count, *states = answers(model.codes, self.w, replies, 1 + 2 * kept)
        some = self.c > 1
        self.share, self.base, p = np.ones((kept, len(self.u))), np.ones((kept, len(self.w))), np.zeros(len(self.c))
        cu = sums_over(self.c, runs)
        for k in range(kept):
            t = np.ones(len(self.c), np.int64)
            t[some] = work[len(work) - kept + k].astype(np.int64)
            customers, places = cu.copy(), sums_over(t, runs)
            hot = model.hot[k]
            where = np.searchsorted(hot.codes, self.u)
            wide = hot.found(self.u, where)
            customers[wide], places[wide] = hot.customers[where[wide]], hot.tables[where[wide]]
            self.share[k] = model.share(customers, places)
            self.base[k] = model.parents[k].base(states[2 * k], states[2 * k + 1])
            p += (self.c - model.discount * t) / (STRENGTH + customers)[self.of] + self.share[k][self.of] * self.base[k][at]
        self.logp = np.log10(p / max(1, kept))

    def places(self, u: np.ndarray, w: np.ndarray):
        """Of contexts and words: places and whether they are here; of pairs likewise."""
        ui, wi = (np.minimum(np.searchsorted(have, x), max(0, len(have) - 1)) for have, x in ((self.u, u), (self.w, w)))
        hu, hw = (have[i] == x if len(have) else np.zeros(len(x), bool) for have, i, x in ((self.u, ui, u), (self.w, wi, w)))
        pair = ui << 32 | wi
        at = np.minimum(np.searchsorted(self.pair, pair), max(0, len(self.pair) - 1))
        seen = hu & hw & (self.pair[at] == pair) if len(self.pair) else np.zeros(len(u), bool)
        return ui, hu, wi, hw, at, seen


def gathered(rows) -> tuple[list, list, dict, Iterator]:
    """STATIC, WORK and REPLY rows of a group, and an iterator over the others."""
    static, work, replies, rows = None, [], {}, iter(rows)
    for kind, source, x in rows:
        if kind == STATIC:
            static = x
        elif kind == WORK:
            work = x[11:]
        elif kind == REPLY:
            replies[source] = x
        else:
            return static, work, replies, _and_rest((kind, source, x), rows)
    return static, work, replies, iter(())


def _and_rest(first, rows):
    yield first
    yield from rows


EMPTY = [np.zeros(0, np.uint8), np.zeros(0, np.uint32), np.zeros(0, np.uint64)]
NOTHING = [*EMPTY, np.zeros(0, np.int64), *EMPTY, np.zeros(0, np.int64), np.zeros(0, np.int64)]


def most_frequent(shared, least: int):
    """TOP rows: pairs of frequent words with at least so many customers, and their log probabilities."""

    def work(group: int, rows) -> Iterator[pa.RecordBatch]:
        static, seats, replies, _ = gathered(rows)
        here = Restaurants(shared.value, static, seats, replies)
        u, w = here.u[here.of], here.w[here.pair & 0xFFFFFFFF]
        use = (here.c >= least) & (u < RARE) & (w < RARE)
        yield packed.record([(TOP, 0, group, pack(u[use] << np.uint64(32) | w[use], here.logp[use]))])

    return work


def entries(shared):
    """HEAD rows of all texts with what is known where they are read, and ENTRY rows of their other pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        log_count = np.log10(model.counts + 0.5)
        for h, at, slices in flushed(batches, 1, FLUSH_TOKENS // 2):
            codes, n = model.codes, len(at) - 1
            code, ids, before = numbered(codes, h, at)
            doc, own = owner(at), code[ids]
            frequent = own < RARE
            rank = np.where(frequent, own, 0).astype(np.int64)
            base = np.bincount(doc, weights=np.where(frequent, log_count[rank] if len(log_count) else 0.0, 0.0), minlength=n)
            known = np.bincount(doc, weights=frequent & (model.counts[rank] > 0) if len(log_count) else frequent, minlength=n).astype(np.int64)
            del h, own, frequent, rank
            key = before << 32 | ids
            del before, ids
            order = np.argsort(key)
            pair, count = run_lengths(key[order])
            del key
            u, w = code[pair >> 32], code[pair & 0xFFFFFFFF]
            both = u << np.uint64(32) | w
            place = np.minimum(np.searchsorted(model.top, both), max(0, len(model.top) - 1))
            top = (u < RARE) & (w < RARE) & (model.top[place] == both) if len(model.top) else np.zeros(len(u), bool)
            by_pair = doc[order]
            score = np.bincount(by_pair, weights=np.repeat(np.where(top, model.log_top[place] if len(model.top) else 0.0, 0.0), count), minlength=n)
            uid, doc_id = (np.concatenate([np.asarray(s.column(c).fill_null(0)) for s in slices]) for c in ("uid", "doc_id"))
            held = np.concatenate([np.asarray(s.column("held_out")) for s in slices])
            null = np.concatenate([np.asarray(s.column("doc_id").is_null()) for s in slices])
            uid = uid.astype(np.int64).view(np.uint64)
            for g, rows in by_group(codes.row(uid)):
                target = g % codes.groups
                yield packed.record([(HEAD, target, 0, pack(uid[rows], doc_id[rows].astype(np.int64).view(np.uint64), null[rows], held[rows].astype(bool), np.diff(at)[rows], known[rows], base[rows], score[rows]))])
            first = np.cumsum(count) - count
            other = np.flatnonzero(~top)
            for g, rows in by_group(codes.group(u[other], w[other])):
                rows = other[rows]
                names, runs = run_lengths(u[rows])
                present, where = np.unique(by_pair[expand(first[rows], count[rows])], return_inverse=True)
                yield packed.record([(ENTRY, g, 0, pack(*split_codes(names), runs, *split_codes(w[rows]), count[rows], uid[present], where))])

    return run


def summed(codes: Codes, group: int, parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """SUM rows: by uid, sums of the log probability, the base and the known words."""
    if parts:
        uid, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        score, base, known = (np.bincount(inverse, weights=np.concatenate([p[k] for p in parts]), minlength=len(uid)) for k in (1, 2, 3))
        for g, rows in by_group(codes.row(uid)):
            yield packed.record([(SUM, g, group, pack(uid[rows], score[rows], base[rows], known[rows].astype(np.int64)))])


def scored(shared):
    """A group's SUM rows, and HOP rows of words after contexts that they never followed, which only the parent knows."""

    def work(group: int, rows) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        codes, kept = model.codes, len(model.parents)
        static, seats, replies, rows = gathered(rows)
        here = Restaurants(model, static or NOTHING, seats if static else [np.zeros(0, np.int64)] * kept, replies)
        parts = []
        for kind, _, x in rows:
            if kind == HEAD:
                for g, some in by_group(codes.row(x[0].astype(np.uint64))):
                    yield packed.record([(HEAD, g, group, pack(*[a[some] for a in x]))])
                continue
            u, w = np.repeat(join_codes(*x[:3]), x[3].astype(np.int64)), join_codes(*x[4:7])
            count, uid, where = x[7].astype(np.int64), x[8].astype(np.uint64), x[9].astype(np.int64)
            ui, hu, wi, hw, at, seen = here.places(u, w)
            share = model.shares_without(u)
            share[:, hu] = here.share[:, ui[hu]]
            rare = w >= RARE
            base = np.ones((kept, len(w)))
            base[:, ~rare] = model.base[:, w[~rare].astype(np.int64)]
            base[:, hw] = here.base[:, wi[hw]]
            value = np.log10((share * base).mean(0))
            value[seen] = here.logp[at[seen]]
            here_too = hw | ~rare
            log_count = np.where(rare & hw, np.log10(here.count[wi] + 0.5) if len(here.w) else 0.0, 0.0)
            value[~here_too] = 0.0
            of = np.repeat(np.arange(len(w)), count)
            n = len(uid)
            parts.append((uid, *(np.bincount(where, weights=v[of], minlength=n) for v in (value, log_count, (rare & hw).astype(float)))))
            hop = ~here_too[of]
            if hop.any():
                who, pair = uid[where[hop]], of[hop]
                for j, some in by_group(codes.parent(w[pair])):
                    yield packed.record([(HOP, j, group, pack(who[some], w[pair[some]], *[share[k][pair[some]].astype(np.float32) for k in range(kept)]))])
            if len(parts) == 16:  # one for each text again
                parts = [_folded(parts)]
        yield from summed(codes, group, parts)

    return work


def _folded(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    uid, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return uid, *(np.bincount(inverse, weights=np.concatenate([p[k] for p in parts]), minlength=len(uid)) for k in (1, 2, 3))


def hopped(shared):
    """SUM rows of words by the parent alone."""

    def work(group: int, rows) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        kept = len(model.parents)
        code, count, state, parts = np.zeros(0, np.uint64), np.zeros(0, np.int64), [np.zeros(0, np.int64)] * (2 * kept), []
        for kind, _, x in rows:
            if kind == STATE:
                code, (_, count, *state) = join_codes(*x[:3]), (a.astype(np.int64) for a in x[3:])
                state = state[-2 * kept :]
                continue
            uid, w = x[0].astype(np.uint64), x[1].astype(np.uint64)
            at = np.minimum(np.searchsorted(code, w), max(0, len(code) - 1))
            hit = code[at] == w if len(code) else np.zeros(len(w), bool)
            pick = lambda a: np.where(hit, a[at], 0) if len(code) else np.zeros(len(w), np.int64)  # noqa: E731, B023
            p = sum(x[2 + k].astype(float) * model.parents[k].base(pick(state[2 * k]), pick(state[2 * k + 1])) for k in range(kept)) / kept
            c = pick(count)
            parts.append((uid, np.log10(p), np.log10(c + 0.5), (c > 0).astype(float)))
            if len(parts) == 16:
                parts = [_folded(parts)]
        yield from summed(model.codes, group, parts)

    return work


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def met(group: int, rows) -> Iterator[pa.RecordBatch]:
    """Result rows from HEAD and SUM rows; sums of a uid are those of all its copies."""
    heads, sums = [], []
    for kind, _, x in rows:
        (heads if kind == HEAD else sums).append(x)
    if not heads:
        return
    uid, doc_id, null, held, n, known, base, score = (np.concatenate(x) for x in zip(*heads))
    names, inverse, copies = np.unique(uid.astype(np.uint64), return_inverse=True, return_counts=True)
    total = np.zeros((3, len(names)))
    for x in sums:
        at = np.searchsorted(names, x[0].astype(np.uint64))
        for k in range(3):
            np.add.at(total[k], at, x[k + 1])
    total = (total / copies)[:, inverse]
    yield pa.RecordBatch.from_arrays(
        [pa.array(doc_id.astype(np.uint64).view(np.int64), mask=null.astype(bool)), pa.array(held.astype(bool)), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64) + np.rint(total[2]).astype(np.int64)), pa.array(base + total[1]), pa.array(score + total[0])],
        names=[c.split()[0] for c in RESULT.split(", ")],
    )


def discount_of(one: int, two: int) -> float:
    """The discount that the numbers of dishes with one and with two customers suggest."""
    return float(np.clip((one + 1) / (one + 2 * two + 2), 0.1, 0.95))


def hot_of(rows: DataFrame, before: Hot | None = None) -> Hot:
    """Contexts of several groups (at most FREQUENT): sums over HOT rows; customers stay those of before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, x in packed.rows_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)) for a in x], names=["code", "c", "t"])

    found = of_kinds(rows, HOT).mapInArrow(run, "code long, c long, t long").groupBy("code").agg(F.sum("c").alias("c"), F.sum("t").alias("t")).orderBy("code").toPandas()
    out = Hot(found.code.to_numpy(np.int64).astype(np.uint64), found.c.to_numpy(np.int64), found.t.to_numpy(np.int64))
    if before is not None:
        tables_of = before.tables.copy()
        tables_of[np.searchsorted(before.codes, out.codes)] = out.tables
        # contexts of which each dish has one customer take no part in the sweeps
        out = Hot(before.codes, before.customers, tables_of)
    return out


def parent_of(rows: DataFrame, discount: float | None = None) -> Parent:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, x in packed.rows_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array([int(v)]) for v in x[0]], names=list("abcdef"))

    r = of_kinds(rows, TOTALS).mapInArrow(run, "a long, b long, c long, d long, e long, f long").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "abcdef"]).first()
    return Parent(r.a, r.b, r.c, r.d, discount_of(r.e, r.f) if discount is None else discount)


def histogram_of(rows: DataFrame) -> tuple[int, int, int]:
    """Pairs of one and of two customers, and the least count that at most TOP_PAIRS pairs of frequent words reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, (types, value, number) in packed.rows_of(batches):
            cut = np.minimum(value.astype(np.int64), 1 << 20)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], cut])), pa.array(np.concatenate([types.astype(np.int64), number.astype(np.int64)]))], names=["value", "n"])

    found = dict(of_kinds(rows, TOTALS).mapInArrow(run, "value long, n long").groupBy("value").agg(F.sum("n").alias("n")).collect())
    least, total = 1 << 62, 0
    for value in sorted((v for v in found if v > 0), reverse=True):
        total += found[value]
        if total > TOP_PAIRS:
            break
        least = value
    return found.get(-1, 0), found.get(-2, 0), least


def of_kinds(rows: DataFrame, *kinds: int) -> DataFrame:
    return rows.where(F.col("kind").isin(*kinds)).select("kind", "target", "source", "payload")


def train(spark: SparkSession, docs: DataFrame) -> tuple[Model, DataFrame, DataFrame, DataFrame, DataFrame]:
    """The model, and its tables: restaurants, their seats, the parent's states and its replies to the restaurants."""
    training = docs.where("not held_out")
    share = training.where(F.pmod(F.col("uid"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(sampled_counts, "h long, n long")
    counted = share.groupBy("h").agg(F.sum("n").alias("n"))
    total = training.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n // 6  # about a word
    found = counted.orderBy(F.desc("n"), "h").limit(FREQUENT).toPandas()
    codes = Codes(found.h.to_numpy(np.int64).view(np.uint64), found.n.to_numpy(np.int64) * SAMPLE, total)
    names = spark.sparkContext.broadcast(codes)
    start = tables.stored(packed.exchanged(training.select("text").mapInArrow(pair_counts(names), packed.SCHEMA), opened(names)), "kind")
    tables.discard(spark)
    one, two, least = histogram_of(start)
    d, hot, rng = discount_of(one, two), hot_of(start), np.random.default_rng(79)
    state = tables.stored(packed.exchanged(of_kinds(start, ASK), parent_opened), "kind")
    parent = parent_of(state)
    seats, parents, hots = start, [], []
    for sweep in range(SWEEPS):
        keep = sweep > SWEEPS - KEPT
        hot.weight = new_table_weight(hot.tables, d, STRENGTH, rng)
        shared = spark.sparkContext.broadcast((codes, parent, hot))
        moved = tables.stored(packed.exchanged(of_kinds(seats, WORK).unionAll(of_kinds(state, REPLY)), seated(shared, sweep, d, keep)), "kind")
        hot = hot_of(moved, hot)
        weight = new_table_weight(parent.tables, parent.discount, PARENT_STRENGTH, rng) / (parent.types + 1)
        after = tables.stored(packed.exchanged(of_kinds(state, STATE).unionAll(of_kinds(moved, ASK)), parent_seated(sweep, parent.discount, weight, keep)), "kind")
        parent = parent_of(after, parent.discount)
        if sweep >= SWEEPS - KEPT:
            parents.append(parent)
            hots.append(hot)
        tables.discard(spark, state, *([seats] if sweep else []))
        seats, state = moved, after
    told = tables.stored(packed.exchanged(of_kinds(state, STATE).unionAll(of_kinds(start, ASK)), parent_told(codes.groups, KEPT)), "kind")
    counts, base = np.zeros(len(codes.hashes), np.int64), np.tile(np.array([[p.base(np.zeros(1), np.zeros(1))[0]] for p in parents]), len(codes.hashes))
    for r in of_kinds(told, WORDS).select("payload").collect():
        code, count, *states = packed.unpack(r.payload)
        code = code.astype(np.int64)
        counts[code] = count
        for k, p in enumerate(parents):
            base[k, code] = p.base(states[2 * k].astype(np.int64), states[2 * k + 1].astype(np.int64))
    model = Model(codes, d, parents, hots, counts, base)
    shared = spark.sparkContext.broadcast(model)
    rows = of_kinds(start, STATIC).unionAll(of_kinds(seats, WORK)).unionAll(of_kinds(told, REPLY))
    best = [packed.unpack(r.payload) for r in packed.exchanged(rows, most_frequent(shared, least)).select("payload").collect()]  # at most TOP_PAIRS
    if best:
        top = np.concatenate([x[0].astype(np.uint64) for x in best])
        order = np.argsort(top)
        model.top, model.log_top = top[order], np.concatenate([x[1] for x in best])[order]
    return model, start, seats, state, told


def perplexity(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every row of docs(doc_id, text)."""
    docs = keyed(docs)
    with tables.batches(spark, packed.BATCH_ROWS):
        model, start, seats, state, told = train(spark, docs)
        shared = spark.sparkContext.broadcast(model)
        rows = docs.mapInArrow(entries(shared), packed.SCHEMA).unionAll(of_kinds(start, STATIC)).unionAll(of_kinds(seats, WORK)).unionAll(of_kinds(told, REPLY))
        sums = tables.stored(packed.exchanged(rows, scored(shared)), "kind")
        tables.discard(spark, start, seats, told)
        hops = packed.exchanged(of_kinds(state, STATE).unionAll(of_kinds(sums, HOP)), hopped(shared))
        out = tables.stored(packed.exchanged(of_kinds(sums, HEAD, SUM).unionAll(hops), met, RESULT))
        tables.discard(spark, sums, state)
    last = model.parents[-1]
    base = F.col("base_score") - F.col("n_tokens") * float(np.log10(last.tokens + 0.5 * (last.types + 1)))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(last.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity(spark, tables.table(spark, sf_dir, "documents"))
