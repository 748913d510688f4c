"""Cost-based partitioning of a chunk: the cheapest chain of fragments, each part of a greedy fragment of some model."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

from tessera.functions.fit import greedy
from tessera.functions.models import rebase
from tessera.schema import EXPONENTIAL, LINEAR, QUADRATIC, SQRT

# Bits of a fragment besides its residuals, by mode and family.
LOSSLESS_BITS = {LINEAR: 131, EXPONENTIAL: 131, QUADRATIC: 163, SQRT: 163}
LOSSY_BITS = {LINEAR: 130, EXPONENTIAL: 130, QUADRATIC: 162, SQRT: 162}
LINEAR_BITS = {LINEAR: 96}
#: All families, in the order of their tags after the linear.
ALL = (LINEAR, EXPONENTIAL, QUADRATIC, SQRT)


def grid(max_bpc: int, families: Sequence[int] = ALL, step: int = 1) -> list[tuple[int, int]]:
    """Models ``(family, bits)``: 0, then from 2 to ``max_bpc`` bits (1 corrects no more than 0)."""
    bits = [0, *range(2, max_bpc + 1, step)] if max_bpc > 1 else [0]
    if bits[-1] != max_bpc and max_bpc > 1:
        bits.append(max_bpc)
    return [(f, b) for f in families for b in bits]


def partition(y: np.ndarray, models: Sequence[tuple[int, int]], weights=None, error: float | None = None, extra: float = 0.0) -> list[tuple]:
    """``(start, end, family, bits, s, t0, t1, t2)`` of the cheapest cover of ``y``.

    The greedy fragments of a model don't depend on where the chain is cut. A part of a fragment is a fragment as well,
    so the cost to reach ``k`` by a model is its bits and weight plus the smallest ``cost[i] - bits * i`` over the
    places ``i`` since its fragment began: one running minimum a model, all models at once.
    """
    weights = weights or LOSSLESS_BITS
    n, m = len(y), len(models)
    if not n:
        return []
    fits = [greedy(f, b, y, error) for f, b in models]
    bits = np.array([0.0 if error is not None else b for _, b in models])
    fixed = np.array([weights[f] + extra for f, _ in models])
    at = [0] * m
    begin: dict[int, list[int]] = {}  # models whose fragments end at a place
    for q, frags in enumerate(fits):
        begin.setdefault(frags[0][1], []).append(q)
    # cheapest cost[i] - bits * i since a model's fragment began; infinite where it has none
    best = np.array([0.0 if frags[0][2] else np.inf for frags in fits])
    shut = np.isinf(best)
    any_shut = bool(shut.any())
    origin = np.zeros(m, np.int64)
    back: list[tuple[int, int, int]] = [(0, 0, 0)] * (n + 1)
    step = np.zeros(m)
    for k in range(1, n + 1):
        step += bits
        reach = best + fixed
        reach += step
        c = int(reach.argmin())
        cost = reach[c]
        if cost == np.inf:
            raise ValueError("no model covers a point")
        back[k] = (int(origin[c]), c, at[c])
        here = cost - step
        if k in begin and k < n:
            for q in begin.pop(k):
                at[q] += 1
                f = fits[q][at[q]]
                begin.setdefault(f[1], []).append(q)
                best[q], origin[q], shut[q] = here[q], k, not f[2]
            any_shut = bool(shut.any())
        if any_shut:
            here[shut] = best[shut] = np.inf
        better = here < best
        origin[better] = k
        np.minimum(best, here, out=best)
    out, k = [], n
    while k:
        i, c, frag = back[k]
        start, _, coef = fits[c][frag]
        f, b = models[c]
        out.append((i, k, f, b, *rebase(f, i - start, *coef)))
        k = i
    return out[::-1]


def single(y: np.ndarray, family: int, error: float) -> list[tuple]:
    """Greedy error-bounded fragments of one family; a point it can't fit becomes a constant line."""
    out = []
    for a, z, c in greedy(family, 0, y, error):
        f, c = (family, c) if c else (LINEAR, (0, 0.0, 0.0, float(y[a])))
        out.append((a, z, f, 0, *c))
    return out


def trained_extra(n: int) -> float:
    return float(math.floor(math.log2(n))) if n > 1 else 0.0


def adaptive(y: np.ndarray, error: float) -> list[tuple]:
    """Adaptive approximation: lines, exponentials and parabolas grow from a common start until each has closed a piece;
    the one with the fewest coefficients so far (an open piece counts half) gives its pieces, and all start anew after them."""
    count = {LINEAR: 2, EXPONENTIAL: 2, QUADRATIC: 3}
    out, at, n = [], 0, len(y)
    while at < n:
        rest = y[at:]
        first = {}
        for f in count:
            one = greedy(f, 0, rest[:1], error)
            if one[0][2]:
                first[f] = greedy(f, 0, rest, error)
        stop = max(p[0][1] for p in first.values())
        price = {}
        for f, p in first.items():
            closed = sum(1 for q in p if q[1] <= stop)
            price[f] = closed * count[f] + (count[f] / 2 if p[min(closed, len(p) - 1)][0] < stop < p[-1][1] else 0)
        f = min(price, key=lambda f: (price[f], f))
        for a, z, c in first[f]:
            if a >= stop or not c:
                break
            out.append((at + a, at + z, f, 0, *c))
        at = out[-1][1]
    return out
