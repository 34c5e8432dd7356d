"""The 65 feature types. P, H, L, O, C, V are price, high, low, open, close and volume of a row."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ...functions.ewm import Ewm
from ...functions.nulls import expm1, log1p, nmax, nmin, sdiv, sign, slog, ssqrt
from ...functions.sliding import Slide
from ...functions.windows import REDUCERS
from .base import Col, Cols, FeatureError, Out, Outs, Recipe, feature  # noqa: F401

col = F.col


def _change(now: Column, then: Column, method: str) -> Column:
    if method not in ("simple", "log"):
        raise FeatureError(f"method must be simple or log, not {method!r}")
    return sdiv(now, then) - 1 if method == "simple" else slog(now) - slog(then)


# returns and prices


@feature("simple_returns")
def simple_returns(c: Recipe, input_column: Col, horizons, output_names: Outs):
    x = col(input_column)
    yield {o: _change(x, c.frames.lag(x, h), "simple") for h, o in zip(horizons, output_names, strict=True)}


@feature("log_returns")
def log_returns(c: Recipe, input_column: Col, horizons, output_names: Outs):
    x = slog(col(input_column))
    yield {o: x - c.frames.lag(x, h) for h, o in zip(horizons, output_names, strict=True)}


@feature("forward_returns")
def forward_returns(c: Recipe, input_column: Col, horizons, output_names: Outs, method):
    x = col(input_column)
    yield {o: _change(c.frames.lag(x, -h), x, method) for h, o in zip(horizons, output_names, strict=True)}


@feature("compound_returns")
def compound_returns(c: Recipe, return_column: Col, windows, output_names: Outs, method, min_periods):
    yield {c.tmp("g"): log1p(col(return_column))}
    total = [c.frames.roll("sum", col(c.tmp("g")), n, min_periods) for n in windows]
    yield {o: expm1(t) if method == "simple" else t for t, o in zip(total, output_names, strict=True)}


@feature("intraday_return")
def intraday_return(c: Recipe, open_column: Col, close_column: Col, output_name: Out, method):
    yield {output_name: _change(col(close_column), col(open_column), method)}


@feature("overnight_return")
def overnight_return(c: Recipe, open_column: Col, close_column: Col, output_name: Out, method):
    yield {output_name: _change(col(open_column), c.frames.lag(col(close_column)), method)}


@feature("log_price")
def log_price(c: Recipe, input_column: Col, output_name: Out):
    yield {output_name: slog(col(input_column))}


@feature("high_low_range")
def high_low_range(c: Recipe, high_column: Col, low_column: Col, close_column: Col, output_name: Out):
    yield {output_name: sdiv(col(high_column) - col(low_column), col(close_column))}


@feature("candle_position")
def candle_position(c: Recipe, high_column: Col, low_column: Col, close_column: Col, output_name: Out):
    yield {output_name: sdiv(col(close_column) - col(low_column), col(high_column) - col(low_column))}


# momentum and trend


@feature("momentum")
def momentum(c: Recipe, input_column: Col, near_offsets, far_offsets, output_names: Outs, method):
    x = col(input_column)
    if any(not 0 <= a < b for a, b in zip(near_offsets, far_offsets, strict=True)):
        raise FeatureError("momentum needs 0 <= near < far")
    yield {o: _change(c.frames.lag(x, a), c.frames.lag(x, b), method) for a, b, o in zip(near_offsets, far_offsets, output_names, strict=True)}


def _averages(c: Recipe, x: str, windows, kind: str, least: int, adjust: bool) -> dict[int, Column | Ewm]:
    if kind not in ("sma", "ema"):
        raise FeatureError(f"kind must be sma or ema, not {kind!r}")
    return {n: c.frames.roll("mean", col(x), n, least) if kind == "sma" else Ewm.span(x, n, adjust, least) for n in windows}


@feature("moving_average")
def moving_average(c: Recipe, input_column: Col, windows, output_names: Outs, kind, min_periods, adjust=False):
    made = _averages(c, input_column, windows, kind, min_periods, adjust)
    yield {o: made[n] for n, o in zip(windows, output_names, strict=True)}


@feature("price_to_moving_average")
def price_to_moving_average(c: Recipe, input_column: Col, windows, output_names: Outs, kind, min_periods, adjust=False):
    yield {c.tmp(f"ma{n}"): v for n, v in _averages(c, input_column, windows, kind, min_periods, adjust).items()}
    yield {o: sdiv(col(input_column), col(c.tmp(f"ma{n}"))) - 1 for n, o in zip(windows, output_names, strict=True)}


@feature("moving_average_ratio")
def moving_average_ratio(c: Recipe, input_column: Col, fast_windows, slow_windows, output_names: Outs, kind, min_periods, adjust=False):
    yield {c.tmp(f"ma{n}"): v for n, v in _averages(c, input_column, {*fast_windows, *slow_windows}, kind, min_periods, adjust).items()}
    yield {o: sdiv(col(c.tmp(f"ma{a}")), col(c.tmp(f"ma{b}"))) - 1 for a, b, o in zip(fast_windows, slow_windows, output_names, strict=True)}


@feature("macd")
def macd(c: Recipe, input_column: Col, fast_span, slow_span, signal_span, output_names: Outs, adjust, min_periods):
    if not 0 < fast_span < slow_span:
        raise FeatureError("macd needs 0 < fast_span < slow_span")
    line, signal, gap = output_names
    yield {c.tmp("f"): Ewm.span(input_column, fast_span, adjust, min_periods), c.tmp("s"): Ewm.span(input_column, slow_span, adjust, min_periods)}
    yield {line: col(c.tmp("f")) - col(c.tmp("s"))}
    yield {signal: Ewm.span(line, signal_span, adjust, min_periods)}
    yield {gap: col(line) - col(signal)}


@feature("distance_from_rolling_extreme")
def distance_from_rolling_extreme(c: Recipe, price_column: Col, extreme_column: Col, windows, output_names: Outs, kind, min_periods):
    yield {o: sdiv(col(price_column), c.frames.roll(kind, col(extreme_column), n, min_periods)) - 1 for n, o in zip(windows, output_names, strict=True)}


def _true_range(c: Recipe, high: str, low: str, close: str) -> Column:
    h, l, before = col(high), col(low), c.frames.lag(col(close))  # noqa: E741
    return F.when(before.isNull(), h - l).otherwise(nmax(h - l, F.abs(h - before), F.abs(l - before)))


@feature("adx")
def adx(c: Recipe, high_column: Col, low_column: Col, close_column: Col, period, output_names: Outs, min_periods):
    up = col(high_column) - c.frames.lag(col(high_column))
    down = c.frames.lag(col(low_column)) - col(low_column)
    known = up.isNotNull() & down.isNotNull()
    yield {
        c.tmp("tr"): _true_range(c, high_column, low_column, close_column),
        c.tmp("up"): F.when(known, F.when((up > down) & (up > 0), up).otherwise(0.0)),
        c.tmp("dn"): F.when(known, F.when((down > up) & (down > 0), down).otherwise(0.0)),
    }
    yield {c.tmp("a" + k): Ewm(c.tmp(k), 1 / period, False, min_periods) for k in ("tr", "up", "dn")}
    name, plus, minus = output_names
    yield {o: 100 * sdiv(col(c.tmp(k)), col(c.tmp("atr"))) for o, k in ((plus, "aup"), (minus, "adn"))}
    yield {c.tmp("dx"): 100 * sdiv(F.abs(col(plus) - col(minus)), col(plus) + col(minus))}
    yield {name: Ewm(c.tmp("dx"), 1 / period, False, min_periods)}


@feature("aroon")
def aroon(c: Recipe, high_column: Col, low_column: Col, window, output_names: Outs):
    up, down, gap = output_names
    yield {c.tmp("up"): Slide(high_column, window, "since_max"), c.tmp("down"): Slide(low_column, window, "since_min")}
    yield {o: 100.0 * (window - col(c.tmp(k))) / window for o, k in ((up, "up"), (down, "down"))}
    yield {gap: col(up) - col(down)}


@feature("true_strength_index")
def true_strength_index(c: Recipe, close_column: Col, long_span, short_span, output_name: Out, adjust, min_periods):
    move = col(close_column) - c.frames.lag(col(close_column))
    yield {c.tmp("d"): move, c.tmp("m"): F.abs(move)}
    yield {c.tmp("1" + k): Ewm.span(c.tmp(k), long_span, adjust, min_periods) for k in "dm"}
    yield {c.tmp("2" + k): Ewm.span(c.tmp("1" + k), short_span, adjust, min_periods) for k in "dm"}
    yield {output_name: 100 * sdiv(col(c.tmp("2d")), col(c.tmp("2m")))}


@feature("linear_trend_slope")
def linear_trend_slope(c: Recipe, input_column: Col, windows, output_names: Outs, use_log):
    yield {c.tmp("y"): slog(col(input_column)) if use_log else col(input_column), c.tmp("x"): F.row_number().over(c.frames.series).cast("double")}
    y, x = col(c.tmp("y")), col(c.tmp("x"))
    yield {o: F.when(F.count(y).over(c.frames.last(n)) == n, F.regr_slope(y, x).over(c.frames.last(n))) for n, o in zip(windows, output_names, strict=True)}


# volatility and risk


def _vol(variance: Column, scale: float) -> Column:
    return ssqrt(nmax(variance, F.lit(0.0))) * scale


@feature("realized_volatility")
def realized_volatility(c: Recipe, return_column: Col, windows, output_names: Outs, min_periods, ddof=1, annualization_factor=1.0):
    yield {o: _vol(c.frames.roll("var", col(return_column), n, min_periods, ddof), annualization_factor) for n, o in zip(windows, output_names, strict=True)}


@feature("ewma_volatility")
def ewma_volatility(c: Recipe, return_column: Col, output_name: Out, alpha, min_periods, annualization_factor=1.0):
    yield {c.tmp("sq"): col(return_column) * col(return_column)}
    yield {c.tmp("var"): Ewm(c.tmp("sq"), alpha, False, min_periods)}
    yield {output_name: _vol(col(c.tmp("var")), annualization_factor)}


def _range_volatility(c: Recipe, term: Column, windows, names, least: int, scale: float):
    yield {c.tmp("t"): term}
    yield {o: _vol(c.frames.roll("mean", col(c.tmp("t")), n, least), scale) for n, o in zip(windows, names, strict=True)}


@feature("parkinson_volatility")
def parkinson_volatility(c: Recipe, high_column: Col, low_column: Col, windows, output_names: Outs, min_periods, annualization_factor=1.0):
    r = slog(col(high_column)) - slog(col(low_column))
    yield from _range_volatility(c, r * r / (4 * math.log(2)), windows, output_names, min_periods, annualization_factor)


@feature("garman_klass_volatility")
def garman_klass_volatility(c: Recipe, open_column: Col, high_column: Col, low_column: Col, close_column: Col, windows, output_names: Outs, min_periods, annualization_factor=1.0):
    r, d = slog(col(high_column)) - slog(col(low_column)), slog(col(close_column)) - slog(col(open_column))
    yield from _range_volatility(c, 0.5 * r * r - (2 * math.log(2) - 1) * d * d, windows, output_names, min_periods, annualization_factor)


def _satchell(o: str, h: str, low: str, close: str) -> Column:
    base = slog(col(o))
    u, d, e = slog(col(h)) - base, slog(col(low)) - base, slog(col(close)) - base
    return u * (u - e) + d * (d - e)


@feature("rogers_satchell_volatility")
def rogers_satchell_volatility(c: Recipe, open_column: Col, high_column: Col, low_column: Col, close_column: Col, windows, output_names: Outs, min_periods, annualization_factor=1.0):
    yield from _range_volatility(c, _satchell(open_column, high_column, low_column, close_column), windows, output_names, min_periods, annualization_factor)


@feature("yang_zhang_volatility")
def yang_zhang_volatility(c: Recipe, open_column: Col, high_column: Col, low_column: Col, close_column: Col, windows, output_names: Outs, min_periods, annualization_factor=1.0):
    o, e = slog(col(open_column)), slog(col(close_column))
    yield {c.tmp("on"): o - c.frames.lag(e), c.tmp("oc"): e - o, c.tmp("rs"): _satchell(open_column, high_column, low_column, close_column)}
    out = {}
    for n, name in zip(windows, output_names, strict=True):
        k = 0.34 / (1.34 + (n + 1) / (n - 1))
        night, day = (c.frames.roll("var", col(c.tmp(x)), n, min_periods) for x in ("on", "oc"))
        out[name] = _vol(night + k * day + (1 - k) * c.frames.roll("mean", col(c.tmp("rs")), n, min_periods), annualization_factor)
    yield out


@feature("average_true_range")
def average_true_range(c: Recipe, high_column: Col, low_column: Col, close_column: Col, windows, output_names: Outs, min_periods, normalize):
    yield {c.tmp("tr"): _true_range(c, high_column, low_column, close_column)}
    yield {c.tmp(f"a{n}"): Ewm(c.tmp("tr"), 1 / n, False, min_periods) for n in windows}
    yield {o: sdiv(col(c.tmp(f"a{n}")), col(close_column)) if normalize else col(c.tmp(f"a{n}")) for n, o in zip(windows, output_names, strict=True)}


@feature("downside_deviation")
def downside_deviation(c: Recipe, return_column: Col, windows, output_names: Outs, min_periods, threshold=0.0, annualization_factor=1.0):
    short = nmin(col(return_column) - threshold, F.lit(0.0))
    yield from _range_volatility(c, short * short, windows, output_names, min_periods, annualization_factor)


@feature("bollinger_bands")
def bollinger_bands(c: Recipe, close_column: Col, windows, pct_b_names: Outs, bandwidth_names: Outs, num_std, min_periods, ddof):
    x, out = col(close_column), {}
    for n, place, width in zip(windows, pct_b_names, bandwidth_names, strict=True):
        middle, spread = c.frames.roll("mean", x, n, min_periods), c.frames.roll("std", x, n, min_periods, ddof)
        out[place] = sdiv(x - (middle - num_std * spread), 2 * num_std * spread)
        out[width] = sdiv(2 * num_std * spread, middle)
    yield out


@feature("ulcer_index")
def ulcer_index(c: Recipe, close_column: Col, windows, output_names: Outs):
    yield {o: Slide(close_column, n, "ulcer") for n, o in zip(windows, output_names, strict=True)}


@feature("max_drawdown")
def max_drawdown(c: Recipe, close_column: Col, windows, output_names: Outs):
    yield {o: Slide(close_column, n, "drawdown") for n, o in zip(windows, output_names, strict=True)}


# liquidity


@feature("amihud_illiquidity")
def amihud_illiquidity(c: Recipe, return_column: Col, dollar_volume_column: Col, windows, output_names: Outs, min_periods, scale):
    yield {c.tmp("i"): sdiv(F.abs(col(return_column)), col(dollar_volume_column))}
    yield {o: scale * c.frames.roll("mean", col(c.tmp("i")), n, min_periods) for n, o in zip(windows, output_names, strict=True)}


@feature("dollar_volume")
def dollar_volume(c: Recipe, price_column: Col, volume_column: Col, output_name: Out, log):
    x = col(price_column) * col(volume_column)
    yield {output_name: F.when(x >= 0, F.log1p(x)) if log else x}


@feature("turnover")
def turnover(c: Recipe, volume_column: Col, shares_column: Col, output_name: Out):
    yield {output_name: sdiv(col(volume_column), col(shares_column))}


@feature("market_cap")
def market_cap(c: Recipe, price_column: Col, shares_column: Col, output_name: Out, log):
    x = col(price_column) * col(shares_column)
    yield {output_name: slog(x) if log else x}


def _rolling_cov(c: Recipe, x: str, y: str, n: int, least: int, pairwise: bool) -> Column:
    """Population covariance of the last rows from three means, each over the rows where its own series has a value and
    centred on the whole entity; ``pairwise`` uses rows where both have one, and so no later row."""
    if pairwise:
        both = col(x).isNotNull() & col(y).isNotNull()
        seen = F.count(F.when(both, 1)).over(c.frames.last(n))
        return F.when(seen >= min(least, n), F.covar_pop(F.when(both, col(x)), F.when(both, col(y))).over(c.frames.last(n)))
    return c.frames.roll("mean", col(x) * col(y), n, least) - c.frames.roll("mean", col(x), n, least) * c.frames.roll("mean", col(y), n, least)


def _centred(c: Recipe, x: str) -> Column:
    return col(x) - F.avg(col(x)).over(c.frames.whole)


@feature("roll_spread")
def roll_spread(c: Recipe, price_column: Col, windows, output_names: Outs, min_periods, normalize, pairwise=False):
    yield {c.tmp("d"): col(price_column) - c.frames.lag(col(price_column))}
    yield {c.tmp("e"): c.frames.lag(col(c.tmp("d")))}
    yield {c.tmp(k + "c"): _centred(c, c.tmp(k)) for k in "de"}
    out = {}
    for n, o in zip(windows, output_names, strict=True):
        cov = _rolling_cov(c, c.tmp("dc"), c.tmp("ec"), n, min_periods, pairwise)
        spread = F.when(cov < 0, 2 * F.sqrt(-cov))
        out[o] = sdiv(spread, c.frames.roll("mean", col(price_column), n, min_periods)) if normalize else spread
    yield out


@feature("corwin_schultz_spread")
def corwin_schultz_spread(c: Recipe, high_column: Col, low_column: Col, close_column: Col, windows, output_names: Outs, min_periods):
    h, l = col(high_column), col(low_column)  # noqa: E741
    h1, l1, c1 = (c.frames.lag(col(x)) for x in (high_column, low_column, close_column))
    yield {c.tmp("h1"): h1, c.tmp("l1"): l1, c.tmp("h0"): F.when(c1 < l, h - (l - c1)).when(c1 > h, c1).otherwise(h), c.tmp("l0"): F.when(c1 < l, c1).when(c1 > h, l + (c1 - h)).otherwise(l)}
    h1, l1, h0, l0 = (col(c.tmp(k)) for k in ("h1", "l1", "h0", "l0"))
    one, two = slog(h1) - slog(l1), slog(h0) - slog(l0)
    wide = slog(nmax(h1, h0)) - slog(nmin(l1, l0))
    yield {c.tmp("b"): one * one + two * two, c.tmp("g"): wide * wide}
    k = 3 - 2 * math.sqrt(2)
    a = (F.sqrt(2 * col(c.tmp("b"))) - F.sqrt(col(c.tmp("b")))) / k - F.sqrt(col(c.tmp("g")) / k)
    yield {c.tmp("s"): nmax(2 * F.tanh(a / 2), F.lit(0.0))}
    yield {o: c.frames.roll("mean", col(c.tmp("s")), n, min_periods) for n, o in zip(windows, output_names, strict=True)}


@feature("kyle_lambda")
def kyle_lambda(c: Recipe, return_column: Col, dollar_volume_column: Col, windows, output_names: Outs, min_periods, pairwise=False):
    yield {c.tmp("r"): col(return_column), c.tmp("q"): sign(col(return_column)) * col(dollar_volume_column)}
    yield {c.tmp(k + "c"): _centred(c, c.tmp(k)) for k in "rq"}
    yield {o: sdiv(_rolling_cov(c, c.tmp("rc"), c.tmp("qc"), n, min_periods, pairwise), c.frames.roll("var", col(c.tmp("qc")), n, min_periods, 0)) for n, o in zip(windows, output_names, strict=True)}


@feature("zero_return_fraction")
def zero_return_fraction(c: Recipe, return_column: Col, windows, output_names: Outs, min_periods, tolerance):
    yield {c.tmp("z"): (F.abs(col(return_column)) < tolerance).cast("double")}
    yield {o: c.frames.roll("mean", col(c.tmp("z")), n, min_periods) for n, o in zip(windows, output_names, strict=True)}


# oscillators


@feature("rsi")
def rsi(c: Recipe, close_column: Col, periods, output_names: Outs, min_periods):
    d = col(close_column) - c.frames.lag(col(close_column))
    yield {c.tmp("g"): nmax(d, F.lit(0.0)), c.tmp("l"): nmax(-d, F.lit(0.0))}
    yield {c.tmp(f"{k}{n}"): Ewm(c.tmp(k), 1 / n, False, min_periods) for n in periods for k in "gl"}
    yield {o: 100 * sdiv(col(c.tmp(f"g{n}")), col(c.tmp(f"g{n}")) + col(c.tmp(f"l{n}"))) for n, o in zip(periods, output_names, strict=True)}


@feature("stochastic")
def stochastic(c: Recipe, high_column: Col, low_column: Col, close_column: Col, window, smooth_k, smooth_d, k_name: Out, d_name: Out, min_periods):
    top, floor = c.frames.roll("max", col(high_column), window, min_periods), c.frames.roll("min", col(low_column), window, min_periods)
    yield {c.tmp("k"): 100 * sdiv(col(close_column) - floor, top - floor)}
    yield {k_name: c.frames.roll("mean", col(c.tmp("k")), smooth_k, smooth_k)}
    yield {d_name: c.frames.roll("mean", col(k_name), smooth_d, smooth_d)}


@feature("williams_r")
def williams_r(c: Recipe, high_column: Col, low_column: Col, close_column: Col, window, output_name: Out, min_periods):
    top, floor = c.frames.roll("max", col(high_column), window, min_periods), c.frames.roll("min", col(low_column), window, min_periods)
    yield {output_name: -100 * sdiv(top - col(close_column), top - floor)}


def _typical(high: str, low: str, close: str) -> Column:
    return (col(high) + col(low) + col(close)) / 3


@feature("cci")
def cci(c: Recipe, high_column: Col, low_column: Col, close_column: Col, windows, output_names: Outs, constant):
    yield {c.tmp("tp"): _typical(high_column, low_column, close_column)}
    x = col(c.tmp("tp"))
    yield {c.tmp(f"mad{n}"): Slide(c.tmp("tp"), n, "mad") for n in windows}
    yield {o: sdiv(x - c.frames.roll("mean", x, n, n), constant * col(c.tmp(f"mad{n}"))) for n, o in zip(windows, output_names, strict=True)}


@feature("ultimate_oscillator")
def ultimate_oscillator(c: Recipe, high_column: Col, low_column: Col, close_column: Col, periods, weights, output_name: Out, min_periods):
    before = c.frames.lag(col(close_column))
    floor = nmin(col(low_column), before)
    yield {c.tmp("b"): col(close_column) - floor, c.tmp("t"): nmax(col(high_column), before) - floor}
    shares = [sdiv(c.frames.roll("sum", col(c.tmp("b")), n, min_periods), c.frames.roll("sum", col(c.tmp("t")), n, min_periods)) for n in periods]
    a, b, d = weights
    yield {output_name: 100 * (a * shares[0] + b * shares[1] + d * shares[2]) / (a + b + d)}


@feature("awesome_oscillator")
def awesome_oscillator(c: Recipe, high_column: Col, low_column: Col, fast_window, slow_window, output_name: Out, min_periods):
    mid = (col(high_column) + col(low_column)) / 2
    yield {output_name: c.frames.roll("mean", mid, fast_window, min_periods) - c.frames.roll("mean", mid, slow_window, min_periods)}


# volume


@feature("on_balance_volume")
def on_balance_volume(c: Recipe, close_column: Col, volume_column: Col, output_name: Out):
    yield {c.tmp("f"): sign(col(close_column) - c.frames.lag(col(close_column))) * col(volume_column)}
    yield {output_name: c.frames.running(col(c.tmp("f")))}


def _multiplier(high: str, low: str, close: str) -> Column:
    h, l, e = col(high), col(low), col(close)  # noqa: E741
    return F.when(h - l == 0, F.lit(0.0)).otherwise(sdiv((e - l) - (h - e), h - l))


@feature("accumulation_distribution")
def accumulation_distribution(c: Recipe, high_column: Col, low_column: Col, close_column: Col, volume_column: Col, output_name: Out):
    yield {c.tmp("f"): _multiplier(high_column, low_column, close_column) * col(volume_column)}
    yield {output_name: c.frames.running(col(c.tmp("f")))}


@feature("chaikin_money_flow")
def chaikin_money_flow(c: Recipe, high_column: Col, low_column: Col, close_column: Col, volume_column: Col, windows, output_names: Outs, min_periods):
    yield {c.tmp("f"): _multiplier(high_column, low_column, close_column) * col(volume_column)}
    yield {o: sdiv(c.frames.roll("sum", col(c.tmp("f")), n, min_periods), c.frames.roll("sum", col(volume_column), n, min_periods)) for n, o in zip(windows, output_names, strict=True)}


@feature("money_flow_index")
def money_flow_index(c: Recipe, high_column: Col, low_column: Col, close_column: Col, volume_column: Col, windows, output_names: Outs, min_periods):
    x = _typical(high_column, low_column, close_column)
    move, flow = x - c.frames.lag(x), x * col(volume_column)
    yield {c.tmp("p"): F.when(move.isNotNull(), F.when(move > 0, flow).otherwise(0.0)), c.tmp("n"): F.when(move.isNotNull(), F.when(move < 0, flow).otherwise(0.0))}
    out = {}
    for n, o in zip(windows, output_names, strict=True):
        p, q = (c.frames.roll("sum", col(c.tmp(k)), n, min_periods) for k in "pn")
        out[o] = 100 * sdiv(p, p + q)
    yield out


@feature("force_index")
def force_index(c: Recipe, close_column: Col, volume_column: Col, span, output_name: Out, adjust, min_periods):
    yield {c.tmp("f"): (col(close_column) - c.frames.lag(col(close_column))) * col(volume_column)}
    yield {output_name: Ewm.span(c.tmp("f"), span, adjust, min_periods)}


@feature("ease_of_movement")
def ease_of_movement(c: Recipe, high_column: Col, low_column: Col, volume_column: Col, window, output_name: Out, volume_scale, min_periods):
    mid = (col(high_column) + col(low_column)) / 2
    yield {c.tmp("e"): sdiv((mid - c.frames.lag(mid)) * (col(high_column) - col(low_column)), col(volume_column) / volume_scale)}
    yield {output_name: c.frames.roll("mean", col(c.tmp("e")), window, min_periods)}


@feature("volume_price_trend")
def volume_price_trend(c: Recipe, close_column: Col, volume_column: Col, output_name: Out):
    before = c.frames.lag(col(close_column))
    yield {c.tmp("f"): col(volume_column) * (sdiv(col(close_column), before) - 1)}
    yield {output_name: c.frames.running(col(c.tmp("f")))}


# across a date


@feature("cross_sectional_rank")
def cross_sectional_rank(c: Recipe, input_columns: Cols, output_names: Outs, method, ascending, scaling):
    yield {o: c.frames.rank(col(x), method, ascending, scaling) for x, o in zip(input_columns, output_names, strict=True)}


@feature("cross_sectional_zscore")
def cross_sectional_zscore(c: Recipe, input_columns: Cols, output_names: Outs, ddof):
    yield {o: c.frames.zscore(col(x), c.frames.section, ddof) for x, o in zip(input_columns, output_names, strict=True)}


@feature("cross_sectional_demean")
def cross_sectional_demean(c: Recipe, input_columns: Cols, output_names: Outs):
    yield {o: col(x) - F.avg(x).over(c.frames.section) for x, o in zip(input_columns, output_names, strict=True)}


@feature("cross_sectional_minmax")
def cross_sectional_minmax(c: Recipe, input_columns: Cols, output_names: Outs):
    w = c.frames.section
    yield {o: sdiv(col(x) - F.min(x).over(w), F.max(x).over(w) - F.min(x).over(w)) for x, o in zip(input_columns, output_names, strict=True)}


@feature("cross_sectional_winsorize")
def cross_sectional_winsorize(c: Recipe, input_columns: Cols, output_names: Outs, lower, upper):
    w = c.frames.section
    yield {o: nmin(nmax(col(x), F.percentile(x, lower).over(w)), F.percentile(x, upper).over(w)) for x, o in zip(input_columns, output_names, strict=True)}


@feature("cross_sectional_bucket")
def cross_sectional_bucket(c: Recipe, input_columns: Cols, output_names: Outs, n_buckets):
    yield {o: nmin(nmax(F.ceil(c.frames.rank(col(x), by="pct") * n_buckets).cast("double"), F.lit(1.0)), F.lit(float(n_buckets))) for x, o in zip(input_columns, output_names, strict=True)}


@feature("group_neutralize")
def group_neutralize(c: Recipe, input_columns: Cols, output_names: Outs, group_column: Col, mode, ddof=1):
    w = Window.partitionBy(c.frames.date, group_column)
    made = {o: c.frames.zscore(col(x), w, ddof) if mode == "zscore" else col(x) - F.avg(x).over(w) for x, o in zip(input_columns, output_names, strict=True)}
    yield {o: F.when(col(group_column).isNotNull(), v) for o, v in made.items()}


# normalisation, generic, calendar


@feature("rolling_zscore")
def rolling_zscore(c: Recipe, input_column: Col, windows, output_names: Outs, min_periods, ddof):
    x = col(input_column)
    yield {o: sdiv(x - c.frames.roll("mean", x, n, min_periods), c.frames.roll("std", x, n, min_periods, ddof)) for n, o in zip(windows, output_names, strict=True)}


@feature("rolling_minmax")
def rolling_minmax(c: Recipe, input_column: Col, windows, output_names: Outs, min_periods):
    x, out = col(input_column), {}
    for n, o in zip(windows, output_names, strict=True):
        low, high = c.frames.roll("min", x, n, min_periods), c.frames.roll("max", x, n, min_periods)
        out[o] = sdiv(x - low, high - low)
    yield out


@feature("rolling_rank")
def rolling_rank(c: Recipe, input_column: Col, windows, output_names: Outs, min_periods, method):
    yield {o: Slide(input_column, n, "rank", min_periods, method=method) for n, o in zip(windows, output_names, strict=True)}


@feature("rolling_aggregation")
def rolling_aggregation(c: Recipe, input_column: Col, windows, output_names: Outs, how, min_periods, ddof=1, quantile=None):
    if how not in REDUCERS or (how == "quantile") != (quantile is not None):
        raise FeatureError(f"how must be one of {REDUCERS}, with a quantile for quantile only")
    if how in ("median", "quantile"):
        yield {o: Slide(input_column, n, how, min_periods, 0.5 if quantile is None else quantile) for n, o in zip(windows, output_names, strict=True)}
    else:
        yield {o: c.frames.roll(how, col(input_column), n, min_periods, ddof) for n, o in zip(windows, output_names, strict=True)}


@feature("temporal_shift")
def temporal_shift(c: Recipe, input_column: Col, periods, output_names: Outs):
    if 0 in periods:
        raise FeatureError("periods must not be 0")
    yield {o: c.frames.lag(col(input_column), p) for p, o in zip(periods, output_names, strict=True)}


@feature("difference")
def difference(c: Recipe, input_column: Col, periods, output_names: Outs):
    if min(periods) <= 0:
        raise FeatureError("periods must be positive")
    yield {o: col(input_column) - c.frames.lag(col(input_column), p) for p, o in zip(periods, output_names, strict=True)}


def calendar_attribute(d: Column, name: str) -> Column:
    d = d.cast("date")
    made = {
        "day_of_week": lambda: F.weekday(d),
        "day_of_month": lambda: F.dayofmonth(d),
        "day_of_year": lambda: F.dayofyear(d),
        "week_of_year": lambda: F.weekofyear(d),
        "month": lambda: F.month(d),
        "quarter": lambda: F.quarter(d),
        "year": lambda: F.year(d),
        "is_month_start": lambda: F.dayofmonth(d) == 1,
        "is_month_end": lambda: F.last_day(d) == d,
        "is_quarter_start": lambda: F.trunc(d, "quarter") == d,
        "is_quarter_end": lambda: (F.last_day(d) == d) & (F.month(d) % 3 == 0),
        "is_year_start": lambda: F.dayofyear(d) == 1,
        "is_year_end": lambda: (F.last_day(d) == d) & (F.month(d) == 12),
    }
    if name not in made:
        raise FeatureError(f"unknown calendar attribute {name!r}; there are {sorted(made)}")
    return made[name]().cast("double")


@feature("calendar_features")
def calendar_features(c: Recipe, attributes, output_names: Outs):
    yield {o: calendar_attribute(col(c.frames.date), a) for a, o in zip(attributes, output_names, strict=True)}
