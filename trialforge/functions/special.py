"""Tails of distributions on plain numbers, for scalars that come from aggregated statistics."""

from __future__ import annotations

import math
from functools import lru_cache

LN10 = math.log(10.0)


def log_normal_tail(z: float) -> float:
    """ln P(N > z): erfc while it lasts, then its asymptotic series."""
    if z < 25:
        return math.log(0.5 * math.erfc(z / math.sqrt(2)))
    series, term = 1.0, 1.0
    for k in range(1, 12):
        term *= -(2 * k - 1) / (z * z)
        series += term
    return -0.5 * z * z - math.log(z * math.sqrt(2 * math.pi)) + math.log(series)


def log_gamma_tail(a: float, x: float) -> float:
    """ln Q(a, x), the upper regularized incomplete gamma function."""
    if x <= 0:
        return 0.0
    head = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= x / n
            total += term
        return math.log1p(-min(1.0, math.exp(head) * total))
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        step = d * c
        h *= step
        if abs(step - 1) < 1e-16:
            break
    return head + math.log(h)


#: ln of the least positive double.
UNDERFLOW = -744.4


def chi2_log10_p(x: float, k: int) -> float:
    """log10 of the upper tail. Where the tail itself underflows, published results have density * x / (x - k + 2) in its place."""
    if x <= 0 or k <= 0:
        return 0.0
    tail = log_gamma_tail(k / 2, x / 2)
    if tail < UNDERFLOW:
        density = (k / 2 - 1) * math.log(x / 2) - x / 2 - math.log(2) - math.lgamma(k / 2)
        tail = density + math.log(x / max(x - k + 2, 1))
    return tail / LN10


@lru_cache(maxsize=256)
def _signed_rank_counts(n: int) -> tuple[int, ...]:
    """Number of sign choices for each sum of positive ranks 1..n."""
    counts = [1]
    for r in range(1, n + 1):
        counts = [(counts[s] if s < len(counts) else 0) + (counts[s - r] if 0 <= s - r < len(counts) else 0) for s in range(len(counts) + r)]
    return tuple(counts)


def wilcoxon_exact(n: int, w: float) -> float:
    """Two-sided p of min(W+, W-) = w with ranks 1..n."""
    counts = _signed_rank_counts(n)
    return min(1.0, 2 * sum(counts[: math.floor(w) + 1]) / 2**n)


def wilcoxon_permutation(ranks: list[float], w: float) -> float:
    """Two-sided p over all sign choices of the given ranks (halves allowed)."""
    sums = {0: 1}
    for r in (round(2 * r) for r in ranks):
        grown = dict(sums)
        for s, c in sums.items():
            grown[s + r] = grown.get(s + r, 0) + c
        sums = grown
    total = sum(round(2 * r) for r in ranks)
    low = sum(c for s, c in sums.items() if min(s, total - s) <= 2 * w)
    return min(1.0, low / 2 ** len(ranks))


def wilcoxon_z(m: int, w: float, ties: float) -> float | None:
    """Normal score of w among m pairs that differ; ties is the sum of t**3 - t. None without variance."""
    variance = m * (m + 1) * (2 * m + 1) / 24 - ties / 48
    return abs(w - m * (m + 1) / 4) / math.sqrt(variance) if variance > 0 else None


def wilcoxon_log10_p(m: int, w: float, ties: float) -> float:
    z = wilcoxon_z(m, w, ties) if m else None
    return min(0.0, (log_normal_tail(z) + math.log(2)) / LN10) if z is not None else 0.0


def wilcoxon_p(n: int, m: int, w: float, ties: float, ranks: list[float] | None = None) -> float | None:
    """Exact for few pairs, else the normal approximation. n pairs, m of them different.

    Without ties or zeros the null distribution is exact up to 50 pairs; with them all sign
    choices are counted up to 13 pairs.
    """
    if m == 0:
        return None
    if m == n and ties == 0 and n <= 50:
        return wilcoxon_exact(m, w)
    if n <= 13 and ranks is not None:
        return wilcoxon_permutation(ranks, w)
    z = wilcoxon_z(m, w, ties)
    return min(1.0, math.erfc(z / math.sqrt(2))) if z is not None else None


# Studentized range quantiles at 0.05 over the square root of 2, for k groups.
NEMENYI = {3: 2.343, 4: 2.569, 5: 2.728, 6: 2.850, 7: 2.949, 8: 3.031, 9: 3.102, 10: 3.164, 11: 3.219, 12: 3.268}


def nemenyi_distance(k: int, n: int) -> float | None:
    return NEMENYI[k] * math.sqrt(k * (k + 1) / (6 * n)) if k in NEMENYI and n else None
