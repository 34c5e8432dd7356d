"""Exponentially weighted statistics as a state that goes on: row by row, over arrays of many series at once, and from one
stretch of rows to the next by composing what each stretch does to the state before it.

A state is (w, w2, mean, cov, seen): the decayed weight and sum of squared weights of what was observed, its mean and
variance under these weights, and the number of observations. ``adjust`` gives every observation weight 1 and lets older
ones decay; otherwise an observation gets ``alpha`` and the rest what is left, and weights are scaled to 1 again. Rows
without a value only decay."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Rows of a segment, over which many segments step side by side.
SEGMENT = 128


@dataclass
class State:
    """Numbers, or arrays of one shape; all zero before the first row."""

    w: np.ndarray
    w2: np.ndarray
    mean: np.ndarray
    cov: np.ndarray
    seen: np.ndarray

    @classmethod
    def empty(cls, n: int) -> State:
        return cls(*(np.zeros(n) for _ in range(5)))

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.w, self.w2, self.mean, self.cov, self.seen]

    def at(self, i) -> State:
        return State(*(p[i] for p in self.parts))

    def put(self, i, other: State) -> None:
        for mine, theirs in zip(self.parts, other.parts, strict=True):
            mine[i] = theirs


def step(s: State, x: np.ndarray, alpha: float, adjust: bool) -> State:
    """The state after one more row each."""
    decay, new = 1 - alpha, 1.0 if adjust else alpha
    here, had = ~np.isnan(x), s.seen > 0
    w, w2 = s.w * decay, s.w2 * decay * decay
    total = np.where(here, w + new, 1.0)
    mean = np.where(s.mean == x, s.mean, (w * s.mean + new * x) / total)
    cov = (w * (s.cov + (s.mean - mean) ** 2) + new * (x - mean) ** 2) / total
    both, first = here & had, here & ~had
    pick = lambda if_both, if_first, if_none: np.where(both, if_both, np.where(first, if_first, if_none))
    after = (w + new, w2 + new * new) if adjust else (np.ones_like(w), (w2 + new * new) / total**2)
    return State(pick(after[0], 1.0, w), pick(after[1], 1.0, w2), pick(mean, x, s.mean), pick(cov, 0.0, s.cov), s.seen + here)


def statistic(s: State, how: str, least: int) -> np.ndarray:
    """Mean, variance or deviation of a state; NaN of fewer than ``least`` observations."""
    enough = s.seen >= max(least, 1)
    if how == "mean":
        return np.where(enough, s.mean, np.nan)
    square = s.w * s.w
    open_ = square - s.w2
    with np.errstate(invalid="ignore", divide="ignore"):
        var = np.where(enough & (open_ > 0), square / open_ * s.cov, np.nan)
        return np.sqrt(var) if how == "std" else var


@dataclass
class Stretch:
    """What rows do to any state before them: rows up to and with the first observation (all rows where there is none), its
    value, and the state after the others if the state after it were of weight 1 (``kept`` of that weight is left)."""

    lead: np.ndarray
    first: np.ndarray
    rest: State
    kept: np.ndarray


def summary(x: np.ndarray, there: np.ndarray, alpha: float, adjust: bool) -> Stretch:
    """Of each row of ``x`` (many stretches, side by side); ``there`` says which places are rows at all."""
    n, size = x.shape
    decay, new = 1 - alpha, 1.0 if adjust else alpha
    seen = ~np.isnan(x) & there
    some = seen.any(axis=1)
    lead = np.where(some, seen.argmax(axis=1) + 1, there.sum(axis=1)).astype(float)
    first = np.where(some, x[np.arange(n), seen.argmax(axis=1)], np.nan)
    # new weight, its squares, mean and variance of what follows the first observation, and what is left of weight 1 before
    mass, squares, mean, cov, count, kept = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.ones(n)
    for k in range(size):
        on, here = there[:, k] & (k >= lead), seen[:, k] & (k >= lead)
        fade = np.where(on, decay, 1.0)
        mass, squares, kept = mass * fade, squares * fade * fade, kept * fade
        value = np.where(here, x[:, k], 0.0)
        total = np.where(here, mass + new, 1.0)
        moved = np.where(mean == value, mean, (mass * mean + new * value) / total)
        cov = np.where(here, (mass * (cov + (mean - moved) ** 2) + new * (value - moved) ** 2) / total, cov)
        mean = np.where(here, moved, mean)
        mass, squares, count = np.where(here, mass + new, mass), np.where(here, squares + new * new, squares), count + here
        if not adjust:  # weights are scaled to 1 at every observation
            scale = np.where(here, mass + kept, 1.0)
            mass, squares, kept = mass / scale, squares / scale**2, kept / scale
    return Stretch(lead, first, State(mass, squares, mean, cov, count), kept)


def passed(s: State, f: Stretch, alpha: float, adjust: bool) -> State:
    """The state after the stretch ``f``."""
    decay = 1 - alpha
    fade = decay ** (f.lead - ~np.isnan(f.first))
    old = step(State(s.w * fade, s.w2 * fade * fade, s.mean, s.cov, s.seen), f.first, alpha, adjust)
    old = State(*(np.where(np.isnan(f.first), a, b) for a, b in zip((s.w * fade, s.w2 * fade * fade, s.mean, s.cov, s.seen), old.parts, strict=True)))
    r = f.rest
    w, w2 = old.w * f.kept, old.w2 * f.kept * f.kept
    total = w + r.w
    share = np.where(total > 0, r.w / np.where(total > 0, total, 1.0), 0.0)
    mean = old.mean + share * (r.mean - old.mean)
    cov = (1 - share) * (old.cov + (old.mean - mean) ** 2) + share * (r.cov + (r.mean - mean) ** 2)
    more = r.seen > 0
    return State(w + r.w, w2 + r.w2, np.where(more, mean, old.mean), np.where(more, cov, old.cov), old.seen + r.seen)


def _segments(group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of every segment (-1: none), which of them are rows, and whether a segment goes on with the group before it."""
    n = len(group)
    new = np.concatenate([[True], group[1:] != group[:-1]])
    place = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
    starts = np.flatnonzero(new | (place % SEGMENT == 0))
    sizes = np.diff(np.append(starts, n))
    at = starts[:, None] + np.arange(sizes.max())
    there = np.arange(sizes.max()) < sizes[:, None]
    return np.where(there, at, 0), there, ~new[starts]


def carried(x: np.ndarray, group: np.ndarray, alpha: float, adjust: bool, before: State | None = None) -> tuple[list[State], State, np.ndarray, np.ndarray]:
    """States after every row, as one array State a step of the segments, and the state after the last row. ``group`` are
    the numbers of the series, in order; ``before`` is the state before the first row."""
    at, there, goes_on = _segments(group)
    cells = np.where(there, x[at], np.nan)
    f = summary(cells, there, alpha, adjust)
    start = State.empty(len(at))
    now = before if before is not None else State.empty(1)
    for k in range(len(at)):
        if goes_on[k] or (k == 0 and before is not None):
            start.put(slice(k, k + 1), now)
        one = slice(k, k + 1)
        if k + 1 < len(at) and not goes_on[k + 1]:
            now = State.empty(1)
            continue
        now = passed(start.at(one), Stretch(f.lead[one], f.first[one], f.rest.at(one), f.kept[one]), alpha, adjust)
    states, s = [], start
    for k in range(at.shape[1]):
        moved = step(s, cells[:, k], alpha, adjust)
        s = State(*(np.where(there[:, k], a, b) for a, b in zip(moved.parts, s.parts, strict=True)))
        states.append(s)
    return states, s.at(slice(len(at) - 1, len(at))), at, there


def along(x: np.ndarray, group: np.ndarray, alpha: float, adjust: bool, how: str, least: int, before: State | None = None) -> tuple[np.ndarray, State]:
    """The statistic after every row and the state after the last."""
    out = np.full(len(x), np.nan)
    if not len(x):
        return out, before if before is not None else State.empty(1)
    states, last, at, there = carried(x, group, alpha, adjust, before)
    for k, s in enumerate(states):
        on = there[:, k]
        out[at[on, k]] = statistic(s, how, least)[on]
    return out, last


def joined(f: Stretch, g: Stretch, alpha: float, adjust: bool) -> Stretch:
    """What ``f`` and then ``g`` do, one stretch each."""
    if np.isnan(f.first[0]):
        return Stretch(f.lead + g.lead, g.first, g.rest, g.kept)
    decay, new = 1 - alpha, 1.0 if adjust else alpha
    here = ~np.isnan(g.first)
    fade = decay**g.lead
    r, value = f.rest, np.where(here, g.first, 0.0)
    mass, squares, kept = r.w * fade, r.w2 * fade * fade, f.kept * fade
    total = np.where(here, mass + new, 1.0)
    mean = np.where(here, (mass * r.mean + new * value) / total, r.mean)
    cov = np.where(here, (mass * (r.cov + (r.mean - mean) ** 2) + new * (value - mean) ** 2) / total, r.cov)
    mass, squares = np.where(here, mass + new, mass), np.where(here, squares + new * new, squares)
    if not adjust:
        scale = np.where(here, mass + kept, 1.0)
        mass, squares, kept = mass / scale, squares / scale**2, kept / scale
    old, both = mass * g.kept, mass * g.kept + g.rest.w
    share = np.where(both > 0, g.rest.w / np.where(both > 0, both, 1.0), 0.0)
    m = mean + share * (g.rest.mean - mean)
    c = (1 - share) * (cov + (mean - m) ** 2) + share * (g.rest.cov + (g.rest.mean - m) ** 2)
    rest = State(old + g.rest.w, squares * g.kept**2 + g.rest.w2, m, c, r.seen + here + g.rest.seen)
    return Stretch(f.lead, f.first, rest, kept * g.kept)


def one_summary(x: np.ndarray, alpha: float, adjust: bool) -> Stretch:
    """Of one series."""
    at, there, _ = _segments(np.zeros(len(x), dtype=np.int8))
    all_ = summary(np.where(there, x[at], np.nan), there, alpha, adjust)
    parts = [Stretch(all_.lead[k : k + 1], all_.first[k : k + 1], all_.rest.at(slice(k, k + 1)), all_.kept[k : k + 1]) for k in range(len(at))]
    while len(parts) > 1:  # pairwise
        parts = [joined(parts[k], parts[k + 1], alpha, adjust) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]
