"""Statistics of sliding windows that a sum can't give, in one pass along each entity.

Quantiles and ranks come from a sorted window that is kept up (a binary search and a shift a row), the largest drawdown from
a queue of two stacks over the mergeable summary (maximum, minimum, largest fall), places of extremes from a monotone
queue. Mean absolute deviations and ulcer indices depend on every value of a window and are computed in numpy over windows
laid side by side. Nothing makes a list a row."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import deque
from dataclasses import dataclass

import numpy as np

KINDS = ("median", "quantile", "rank", "mad", "drawdown", "ulcer", "since_max", "since_min")
#: Cells of windows that are laid out at a time.
CELLS = 1 << 21


@dataclass(frozen=True)
class Slide:
    """A statistic of a column (by name) over the last ``window`` rows. Quantiles and ranks need min(least, window) values;
    the others need all. ``rank`` is that of the row's own value as a share of the window's values."""

    column: str
    window: int
    how: str
    least: int = 1
    quantile: float = 0.5
    method: str = "average"

    def __post_init__(self) -> None:
        if self.how not in KINDS or self.method not in ("average", "min", "max") or self.window < 1:
            raise ValueError(f"no such window: {self}")

    def over(self, x: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Along each run of equal group numbers; NaN is missing."""
        out = np.full(len(x), np.nan)
        if not len(x):
            return out
        cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(x)]
        run = {"median": self._ordered, "quantile": self._ordered, "rank": self._ordered, "mad": self._laid_out, "ulcer": self._laid_out, "drawdown": self._drawdown}.get(self.how, self._since)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            out[a:b] = run(x[a:b])
        return out

    def _ordered(self, x: np.ndarray) -> list[float]:
        """From a sorted window."""
        n, need, ranked = self.window, max(1, min(self.least, self.window)), self.how == "rank"
        share = 0.5 if self.how == "median" else self.quantile
        values, held, out = x.tolist(), [], []
        for i, v in enumerate(values):
            if i >= n and (old := values[i - n]) == old:
                del held[bisect_left(held, old)]
            if v == v:
                insort(held, v)
            seen = len(held)
            if seen < need or (ranked and v != v):
                out.append(np.nan)
            elif ranked:
                low, high = bisect_left(held, v), bisect_right(held, v)
                out.append({"average": (low + 1 + high) / 2, "min": low + 1, "max": high}[self.method] / seen)
            else:
                at = (seen - 1) * share
                low = int(at)
                part = at - low
                out.append(held[low] if part == 0 else (1 - part) * held[low] + part * held[low + 1])
        return out

    def _full(self, x: np.ndarray) -> np.ndarray:
        """Whether the window that ends here is whole and without a missing value."""
        missing = np.concatenate([[0], np.cumsum(np.isnan(x))])
        out = np.zeros(len(x), dtype=bool)
        n = self.window
        if len(x) >= n:
            out[n - 1 :] = missing[n:] == missing[:-n]
        return out

    def _laid_out(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), np.nan)
        at = np.flatnonzero(self._full(x))
        if not len(at):
            return out
        view = np.lib.stride_tricks.sliding_window_view(x, self.window)
        rows = max(1, CELLS // self.window)
        for lo in range(0, len(at), rows):
            i = at[lo : lo + rows]
            w = view[i - self.window + 1]
            if self.how == "mad":
                out[i] = np.abs(w - w.mean(axis=1, keepdims=True)).sum(axis=1) / self.window
            else:
                out[i] = np.sqrt(((100 * _falls(w)) ** 2).sum(axis=1) / self.window)
        return out

    def _drawdown(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), np.nan)
        full = self._full(x)
        if not full.any():
            return out
        if np.nanmin(x) <= 0:  # falls from tops that aren't positive don't merge
            view = np.lib.stride_tricks.sliding_window_view(x, self.window)
            for i in np.flatnonzero(full).tolist():
                out[i] = np.maximum(0.0, _falls(view[i - self.window + 1][None]).max())
            return out
        front: list[tuple[float, float, float]] = []  # summaries from here to the newest of the front
        back: list[float] = []  # newer values
        top, low, fall = 0.0, np.inf, 0.0  # summary of the back
        made = []
        for v, whole in zip(x.tolist(), full.tolist(), strict=True):
            if v != v:
                front, back, top, low, fall = [], [], 0.0, np.inf, 0.0
                made.append(np.nan)
                continue
            if len(front) + len(back) == self.window:
                if not front:  # the back turned over
                    a, b, c = 0.0, np.inf, 0.0
                    for u in reversed(back):
                        c = max(c, 1 - b / u)
                        a, b = max(a, u), min(b, u)
                        front.append((a, b, c))
                    back, top, low, fall = [], 0.0, np.inf, 0.0
                front.pop()
            back.append(v)
            top = max(top, v)
            fall, low = max(fall, 1 - v / top), min(low, v)
            if not whole:
                made.append(np.nan)
            elif front:
                a, _, c = front[-1]
                made.append(max(c, fall, 1 - low / a))
            else:
                made.append(fall)
        return np.array(made)

    def _since(self, x: np.ndarray) -> list[float]:
        """Rows since the latest extreme of a full window, from a queue of candidates."""
        sign = 1.0 if self.how == "since_max" else -1.0
        queue: deque[tuple[int, float]] = deque()
        out = []
        for i, (v, whole) in enumerate(zip((sign * x).tolist(), self._full(x).tolist(), strict=True)):
            while queue and (v != v or queue[-1][1] <= v):
                queue.pop()
            if v == v:
                queue.append((i, v))
            while queue and queue[0][0] <= i - self.window:
                queue.popleft()
            out.append(float(i - queue[0][0]) if whole else np.nan)
        return out


def _falls(w: np.ndarray) -> np.ndarray:
    """Of each value from the running maximum of its window; NaN from a maximum of 0."""
    top = np.maximum.accumulate(w, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1 - np.where(top == 0, np.nan, w / top)
