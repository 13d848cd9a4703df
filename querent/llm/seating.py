"""Numbers of tables in Chinese restaurants, drawn exactly from their distribution given everything else."""

from __future__ import annotations

import functools

import numpy as np

#: draws of a number of tables until one is accepted, at most; draws at once
TRIES = 4096
WIDTH = 1 << 16
MANY = 32
#: customers of a dish up to which the distribution of its tables is tabled
TABLED = 1024
#: strengths that are tried, as shares of the weight of a new table
STRENGTHS = tuple(2.0**-k for k in range(12)) + (2.0, 4.0)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function of positive numbers."""
    x = np.asarray(x, float)
    shift = np.zeros(x.shape)
    for _ in range(8):
        low = x < 8
        shift = shift + np.where(low, np.log(np.where(low, x, 1.0)), 0.0)
        x = np.where(low, x + 1, x)
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - shift


def tables_found(c: np.ndarray, d: float, theta: np.ndarray, rng) -> np.ndarray:
    """Numbers of tables that c customers take in restaurants of discount d and strengths theta above -d, without a base."""
    t = np.ones(len(c), np.int64)
    live = np.flatnonzero(c > 1)
    left = c[live] - 1
    while len(live):
        # the customers who do not join the table opened last go on to later tables
        left = rng.binomial(left, rng.beta(theta[live] + d * t[live], 1 - d))
        more = left > 0
        live, left = live[more], left[more] - 1
        t[live] += 1
    return t


def window_draw(c: int, a: float, d: float, rng) -> int:
    """A draw in proportion to a**t S(c, t) where the alternating series of S(c, t) converges without loss, or 0 elsewhere:
    for t up to about c**d, so that all t within 12 deviations of the mode can be weighed."""
    low, high = -700.0, 0.0  # log(1 - z) at the saddle point a z (1 - z)**(d - 1) = c
    for _ in range(60):
        mid = (low + high) / 2
        if np.log(a) + np.log1p(-np.exp(min(mid, -1e-300))) + (d - 1) * mid > np.log(c):
            low = mid
        else:
            high = mid
    mode, reach = a * -np.expm1(d * low) / d, 12 * np.sqrt(a / d) + 12
    t = np.arange(max(1, int(mode - reach)), min(c, int(mode + reach)) + 1, dtype=float)
    if t[-1] > 3 * c**d or c < 1000:
        return 0
    j = np.arange(1, 151, dtype=float)
    x = j * d
    # log of gamma(c - x) / gamma(c), without the difference of two large numbers
    fall = (c - x - 0.5) * np.log1p(-x / c) - x * np.log(c) + x + (1 / (c - x) - 1 / c) / 12
    # t (t - 1) ... (t - j + 1) / j!, zero above t
    falls = np.cumsum(np.log(np.maximum(t[:, None] - j + 1, 1e-300)), axis=1)
    terms = np.exp(falls + log_gamma(1 + x) + fall - log_gamma(j + 1)) * np.where(j % 2 == 1, 1, -1) * np.sin(np.pi * x)
    s, top = terms.sum(1), np.abs(terms).max(1)
    if (s < 1e-4 * top).any() or (np.abs(terms[:, -5:]).max(1) > 1e-9 * s).any():
        return 0
    p = t * (np.log(a) - np.log(d)) - log_gamma(t + 1) + np.log(np.maximum(s, 1e-300))
    total = np.cumsum(np.exp(p - p.max()))
    return int(t[np.searchsorted(total, rng.random() * total[-1], "right")])


@functools.lru_cache(maxsize=8)
def log_seatings(d: float) -> np.ndarray:
    """log S(c, t) for up to TABLED customers."""
    out = np.full((TABLED + 1, TABLED + 1), -np.inf)
    out[1, 1] = 0.0
    for n in range(1, TABLED):
        t = np.arange(1, n + 1)
        out[n + 1, 1 : n + 1] = out[n, 1 : n + 1] + np.log(n - d * t)
        out[n + 1, 2 : n + 2] = np.logaddexp(out[n + 1, 2 : n + 2], out[n, 1 : n + 1])
    return out


def _tabled(c: np.ndarray, a: np.ndarray, d: float, rng, out: np.ndarray) -> None:
    """Draws for dishes of 2 to TABLED customers, by inversion."""
    log_s, u = log_seatings(d), rng.random(len(c))
    order = np.argsort(c, kind="stable")
    edge = np.searchsorted(c[order], np.arange(2, TABLED + 2))
    for n, lo, hi in zip(range(2, TABLED + 1), edge, edge[1:]):
        for at in range(lo, hi, WIDTH):
            rows = order[at : min(at + WIDTH, hi)]
            x, v = a[rows], u[rows]
            if n == 2:
                out[rows] = 1 + (v * (1 - d + x) >= 1 - d)
            elif n == 3:
                one, two = (1 - d) * (2 - d), 3 * (1 - d) * x
                v = v * (one + two + x * x)
                out[rows] = 1 + (v >= one) + (v >= one + two)
            else:
                p = log_s[n, 1 : n + 1] + np.log(x)[:, None] * np.arange(1, n + 1)
                p = np.cumsum(np.exp(p - p.max(1, keepdims=True)), axis=1)
                out[rows] = 1 + np.minimum((v[:, None] * p[:, -1:] >= p).sum(1), n - 1)


def table_counts(c: np.ndarray, t: np.ndarray, a: np.ndarray, d: float, rng) -> np.ndarray:
    """New numbers of tables of dishes with c customers, with probability in proportion to a**t S(c, t), where S(c, t) is
    the sum of all seatings of c customers at t tables: one exact draw in place of a pass over all customers.

    Draws come from a restaurant of strength s without a base, whose probabilities are in proportion to
    s (s + d) ... (s + (t-1) d) S(c, t), and are rejected by the ratio of the two, so S itself is not needed. s is chosen to
    be rejected least. Dishes of many tables are drawn by window_draw() where that holds. A dish without an accepted draw in TRIES keeps its t, which leaves the distribution as it is.
    """
    out = t.copy()
    out[c == 1] = 1
    _tabled(c, a, d, rng, out)
    some = np.flatnonzero(c > TABLED)
    if not len(some):
        return out
    log_a, n = np.log(a[some]), c[some].astype(float)

    def weight(s, t, k):
        return (t - 1) * (log_a[k] - np.log(d)) - log_gamma(s / d + t) + log_gamma(s / d + 1)

    def most(s, k):
        # the weight rises while a exceeds s + t d
        return weight(s, np.clip(np.ceil((a[some][k] - s) / d), 1, n[k]), k)

    every = np.arange(len(some))
    best, strength = np.full(len(some), np.inf), np.zeros(len(some))
    for part in STRENGTHS:
        s = np.maximum(a[some] * part, 1e-9) - d
        cost = log_gamma(s + n) - log_gamma(s + 1) + most(s, every)
        strength = np.where(cost < best, s, strength)
        best = np.minimum(cost, best)
    top = most(strength, every)
    live, tries = every, 0
    for k in np.flatnonzero(np.minimum(a[some] / d, n**d) > MANY).tolist():
        drawn = window_draw(int(c[some[k]]), float(a[some[k]]), d, rng)
        if drawn:
            out[some[k]] = drawn
            live = live[live != k]
    while len(live) and tries < TRIES:
        copies = max(1, min(TRIES - tries, WIDTH // len(live), 2 * tries))
        k = np.tile(live, copies)
        drawn = tables_found(c[some][k], d, strength[k], rng)
        good = np.log(rng.random(len(k))) < weight(strength[k], drawn, k) - top[k]
        first, at = np.unique(k[good], return_index=True)
        out[some[first]] = drawn[good][at]
        live = np.setdiff1d(live, first)
        tries += copies
    return out


def new_table_weight(tables_of: np.ndarray, d: float, theta: float, rng) -> np.ndarray:
    """Weights of new tables, for restaurants of so many tables: given such a gamma variable, their dishes are independent."""
    return d * rng.gamma(theta / d + tables_of)
