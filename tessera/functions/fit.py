"""Greedy fits: the longest run of points that one function of a family approximates within bounds.

Every family is a line in some plane: a point with bounds becomes a vertical interval at an abscissa, and a function
within all bounds a line that stabs all intervals. The steepest such line goes through a lower end and a later upper
end, the flattest through an upper end and a later lower end. Both are kept while points arrive, with the hulls of the
ends that may still carry them; every point enters and leaves a hull once, so a point takes constant time on average.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from tessera.functions.models import eps
from tessera.schema import EXPONENTIAL, LINEAR, QUADRATIC, SQRT

#: Bounds are drawn in by this share, against rounding in the evaluation.
SLACK = 1e-9


class Line:
    """A line through intervals that come one after the other, by rising ``x``."""

    __slots__ = ("ax", "ay", "a0", "bx", "by", "b0", "least", "most", "n")

    def __init__(self):
        # lower ends that may carry the steepest line (their upper hull, from a0 on), upper ends for the flattest one
        self.ax, self.ay, self.a0 = [], [], 0
        self.bx, self.by, self.b0 = [], [], 0
        self.least, self.most, self.n = -np.inf, np.inf, 0

    def add(self, x: float, low: float, high: float) -> bool:
        """Take the interval, unless no line stabs it together with those before."""
        ax, ay, bx, by, n = self.ax, self.ay, self.bx, self.by, self.n
        if n:
            a, b = self.a0, self.b0
            if n == 1:
                above, below = True, True
            else:
                ceiling, floor = ay[a] + self.most * (x - ax[a]), by[b] + self.least * (x - bx[b])
                if low > ceiling or high < floor:
                    return False
                above, below = high < ceiling, low > floor
            if above:  # the steepest line turns down to the new upper end
                last, best = len(ax) - 1, (high - ay[a]) / (x - ax[a])
                while a < last:
                    s = (high - ay[a + 1]) / (x - ax[a + 1])
                    if s > best:
                        break
                    best, a = s, a + 1
                self.a0, self.most = a, best
            if below:  # the flattest turns up to the new lower end
                last, best = len(bx) - 1, (low - by[b]) / (x - bx[b])
                while b < last:
                    s = (low - by[b + 1]) / (x - bx[b + 1])
                    if s < best:
                        break
                    best, b = s, b + 1
                self.b0, self.least = b, best
            while len(ax) - a > 1 and (low - ay[-1]) * (ax[-1] - ax[-2]) >= (ay[-1] - ay[-2]) * (x - ax[-1]):
                ax.pop()
                ay.pop()
            while len(bx) - b > 1 and (high - by[-1]) * (bx[-1] - bx[-2]) <= (by[-1] - by[-2]) * (x - bx[-1]):
                bx.pop()
                by.pop()
        ax.append(x)
        ay.append(low)
        bx.append(x)
        by.append(high)
        self.n = n + 1
        return True

    def middle(self) -> tuple[float, float]:
        """Slope and intercept in the middle of what works: of the slopes, then of the intercepts."""
        if self.n == 1:
            return 0.0, (self.ay[0] + self.by[0]) / 2
        s = (self.least + self.most) / 2
        down = max([y - s * x for x, y in zip(self.ax[self.a0 :], self.ay[self.a0 :], strict=True)])
        up = min([y - s * x for x, y in zip(self.bx[self.b0 :], self.by[self.b0 :], strict=True)])
        return s, (down + up) / 2


def longest(x: Sequence[float], low: Sequence[float], high: Sequence[float], at: int, end: int, anchor: float | None = None) -> tuple[int, float, float]:
    """``(k, slope, intercept)``: a line stabs the intervals from ``at`` to before ``k`` (``end`` at most), but not the next.

    ``x`` is counted from ``at``. With an ``anchor``, an interval becomes that of the slopes from the anchor, at ``x = 0``,
    to its ends.
    """
    line = Line()
    add, k = line.add, at
    if anchor is None:
        while k < end and add(x[k - at], low[k], high[k]):
            k += 1
    else:
        while k < end and add(p := x[k - at], (low[k] - anchor) / p, (high[k] - anchor) / p):
            k += 1
    return (k, *line.middle())


def stab(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[int, float, float]:
    """How many leading intervals a line can stab, with its slope and intercept."""
    return longest(x.tolist(), low.tolist(), high.tolist(), 0, len(x))


def bounds(model: int, bpc: int, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Real bounds within which a function's integer value can be corrected by ``bpc`` bits."""
    e = eps(bpc)
    up = e + 1 if bpc else 0
    if model in (LINEAR, QUADRATIC):  # rounded up
        low, high = y - (e + 1), y + float(up)
        low, high = low + 1e-6, high - 1e-6
    else:
        low, high = y - (e + 0.5), y + (up + 0.5)
        low, high = low + 1e-6, high - 1e-6
    room = SLACK * np.abs(y)
    return low + np.minimum(room, 0.25), high - np.minimum(room, 0.25)


def exact(model: int, e: float, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of an error-bounded fit: errors from -(e + 1) to e."""
    if model in (LINEAR, QUADRATIC):
        return y - (e + 1) + 1e-6, y + e + 1 - 1e-6
    return y - (e + 0.5) + 1e-6, y + e + 1.5 - 1e-6


class Fitter:
    """Greedy fragments of one family over the bounds of ``y``, grown from any start."""

    def __init__(self, model: int, y: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.model, self.n, self.y = model, len(y), y.tolist()
        if model == EXPONENTIAL:
            self.stops = np.flatnonzero(low <= 0).tolist()
            low = np.log(np.where(low > 0, low, 1.0))
            high = np.log(np.where(high > 0, high, 1.0))
        self.low, self.high = low.tolist(), high.tolist()
        steps = np.arange(1, self.n + 1, dtype=np.float64)
        self.x = (np.sqrt(steps) if model == SQRT else steps).tolist()
        self.stop = 0

    def grow(self, at: int) -> tuple[int, tuple]:
        """End and ``(s, t0, t1, t2)`` of the longest fragment from ``at``; no coefficients where the family can't start."""
        if self.model == QUADRATIC:  # through the first point exactly
            first = self.y[at]
            if at + 1 >= self.n:
                return at + 1, (0, 0.0, 0.0, first)
            k, a, b = longest(self.x, self.low, self.high, at + 1, self.n, first)
            return k, (0, a, b, first)
        end = self.n
        if self.model == EXPONENTIAL:
            while self.stop < len(self.stops) and self.stops[self.stop] < at:
                self.stop += 1
            if self.stop < len(self.stops):
                end = self.stops[self.stop]
                if end == at:
                    return at + 1, ()
        k, a, b = longest(self.x, self.low, self.high, at, end)
        return k, (0, 0.0, a, float(np.exp(b)) if self.model == EXPONENTIAL else b)


def segment(model: int, y: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[int, tuple]:
    """Length and ``(s, t0, t1, t2)`` of the longest fragment from the start of ``y``; length 0 where a family can't start."""
    k, c = Fitter(model, np.asarray(y, np.float64), np.asarray(low, np.float64), np.asarray(high, np.float64)).grow(0)
    return (k, c) if c else (0, ())


def greedy(model: int, bpc: int, y: np.ndarray, error: float | None = None) -> list[tuple[int, int, tuple]]:
    """``(start, end, coefficients)`` of successive longest fragments that cover ``y``.

    Where an exponential can't start, a fragment without coefficients covers the point.
    """
    y = np.asarray(y, np.float64)
    low, high = bounds(model, bpc, y) if error is None else exact(model, error, y)
    fitter, out, at = Fitter(model, y, low, high), [], 0
    while at < len(y):
        end, c = fitter.grow(at)
        out.append((at, end, c))
        at = end
    return out


class Online:
    """A fragment that grows value by value, for streams. ``add`` says whether the value still fits; one that doesn't is not taken."""

    def __init__(self, model: int, bpc: int):
        self.model, self.bpc, self.line, self.n, self.first = model, bpc, Line(), 0, 0.0

    def add(self, y: int) -> bool:
        v = np.array([y], np.float64)
        low, high = (float(b[0]) for b in bounds(self.model, self.bpc, v))
        if self.model == QUADRATIC:
            if not self.n:
                self.first, self.n = float(y), 1
                return True
            x, low, high = float(self.n), (low - self.first) / self.n, (high - self.first) / self.n
        else:
            x = float(np.sqrt(self.n + 1)) if self.model == SQRT else float(self.n + 1)
            if self.model == EXPONENTIAL:
                if low <= 0:
                    return False
                low, high = float(np.log(low)), float(np.log(high))
        taken = self.line.add(x, low, high)
        self.n += taken
        return taken

    def coefficients(self) -> tuple:
        """``(s, t0, t1, t2)``; there must be a value."""
        a, b = self.line.middle() if self.line.n else (0.0, 0.0)
        if self.model == QUADRATIC:
            return (0, a, b, self.first) if self.n > 1 else (0, 0.0, 0.0, self.first)
        return (0, 0.0, a, float(np.exp(b)) if self.model == EXPONENTIAL else b)
