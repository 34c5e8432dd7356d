"""Sliding statistics against plain loops over each window."""

import time

import numpy as np
import pandas as pd
import pytest

from panelwright.functions.sliding import Slide


def plain(x, s):
    out = []
    for i, v in enumerate(x):
        w = x[max(0, i - s.window + 1) : i + 1]
        some = w[~np.isnan(w)]
        y = np.nan
        if s.how in ("median", "quantile", "rank"):
            if len(some) >= max(1, min(s.least, s.window)):
                if s.how == "rank":
                    y = pd.Series(w).rank(method=s.method).iloc[-1] / len(some)
                else:
                    y = np.quantile(some, 0.5 if s.how == "median" else s.quantile)
        elif len(some) == s.window:
            top = np.maximum.accumulate(w)
            with np.errstate(divide="ignore", invalid="ignore"):
                falls = 1 - np.where(top == 0, np.nan, w / top)
            if s.how == "mad":
                y = np.abs(w - w.mean()).mean()
            elif s.how == "drawdown":
                y = np.maximum(0.0, falls.max())
            elif s.how == "ulcer":
                y = np.sqrt(((100 * falls) ** 2).mean())
            else:
                back = w[::-1]
                y = float(np.argmax(back) if s.how == "since_max" else np.argmin(back))
        out.append(y)
    return np.array(out)


SPECS = [Slide("x", n, how, least, q, m) for n in (1, 2, 5, 12, 300) for how, least, q, m in [("median", 1, 0.5, "average"), ("quantile", 3, 0.25, "average"), ("quantile", 4, 1.0, "average"), *(("rank", 2, 0.5, m) for m in ("average", "min", "max")), *((h, 1, 0.5, "average") for h in ("mad", "drawdown", "ulcer", "since_max", "since_min"))]]


@pytest.mark.parametrize("kind", ["prices", "ties", "signs", "none"])
def test_windows_match_loops(kind):
    rng = np.random.default_rng(len(kind))
    n = 800
    x = {"prices": rng.uniform(1, 9, n), "ties": rng.integers(1, 4, n).astype(float), "signs": rng.integers(-2, 3, n).astype(float), "none": np.full(n, np.nan)}[kind]
    x[rng.random(n) < 0.02] = np.nan
    group = np.repeat([0, 1, 2, 3], [500, 1, 250, 49])
    for s in SPECS:
        want = np.concatenate([plain(x[group == g], s) for g in range(4)])
        assert s.over(x, group) == pytest.approx(want, abs=1e-9, nan_ok=True), s
    assert len(SPECS[0].over(x[:0], group[:0])) == 0


@pytest.mark.parametrize("how", ["median", "rank", "drawdown", "since_max"])
def test_wide_windows_cost_no_more_a_row(how):
    x = np.random.default_rng(1).uniform(1, 9, 60_000)
    group = np.zeros(len(x), dtype=int)

    def seconds(window):
        t = time.perf_counter()
        Slide("x", window, how).over(x, group)
        return time.perf_counter() - t

    narrow, wide = (min(seconds(w) for _ in range(3)) for w in (12, 252))
    assert wide < 2.5 * narrow


def test_unknown_windows_are_refused():
    for bad in ({"how": "mode"}, {"how": "rank", "method": "dense"}, {"how": "median", "window": 0}):
        with pytest.raises(ValueError, match="window"):
            Slide(**{"column": "x", "window": 3, **bad})
