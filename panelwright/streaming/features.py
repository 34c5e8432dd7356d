"""Rolling, lagged and exponentially weighted features on a stream of panel rows, one state an entity, kept in buckets.

An entity's state is what later rows need and no more: the last rows of the longest window (a ring of input values), the
state of every exponential weight, the last date that was settled, and rows that wait for the watermark. Rows are settled in
date order, each once, and give the same numbers as the batch columns over the whole panel, however the panel is cut into
micro-batches.

Without ``late``, a panel arrives in date order (in any order inside a micro-batch) and rows are settled as they come. With
``late``, rows wait until the watermark (the latest date seen, less ``late``) has passed them, so they may arrive in any
order within that bound. A row that is not later than the last settled row of its entity is left out; of rows of one entity
and date the one with the smallest values stays, NULL last. Rows without entity or date are left out."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..functions.ewm import Ewm, add_along
from ..functions.nulls import finite, sdiv, slog
from ..functions.recursion import State, statistic, step
from ..functions.windows import REDUCERS, Frames
from ..panel import Panel, PanelError

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Cells of windows that are laid out at a time.
CELLS = 1 << 21
NEVER = np.iinfo(np.int64).min
#: Entities are dealt by a hash to so many buckets, whose states are kept together.
BUCKETS, BUCKET = 1024, "_bucket"


@dataclass(frozen=True)
class Roll:
    """A reducer over the last ``window`` rows where min(least, window) of them have a value."""

    column: str
    window: int
    how: str
    least: int
    ddof: int = 1
    quantile: float | None = None

    def __post_init__(self) -> None:
        if self.how not in REDUCERS or self.window < 1 or (self.how == "quantile") != (self.quantile is not None):
            raise PanelError(f"no such window: {self}")


@dataclass(frozen=True)
class Lag:
    """The value ``rows`` earlier, or the difference, simple or log return since then."""

    column: str
    rows: int
    how: str = "value"

    def __post_init__(self) -> None:
        if self.how not in ("value", "difference", "simple", "log") or self.rows < 1:
            raise PanelError(f"no such lag: {self}")


Spec = Roll | Lag | Ewm


def batch_features(panel: Panel, specs: dict[str, Spec]) -> DataFrame:
    """The keys and the same features over a whole panel at once."""
    frames, col = Frames(panel.date, panel.entity), F.col
    columns = list(dict.fromkeys(s.column for s in specs.values()))
    df = panel.df.select(*panel.keys, *(finite(col(c).cast("double")).alias(c) for c in columns))
    plain = {}
    for name, s in specs.items():
        if isinstance(s, Roll):
            plain[name] = frames.roll(s.how, col(s.column), s.window, s.least, s.ddof, s.quantile)
        elif isinstance(s, Lag):
            x, before = col(s.column), frames.lag(col(s.column), s.rows)
            plain[name] = {"value": before, "difference": x - before, "simple": sdiv(x, before) - 1, "log": slog(x) - slog(before)}[s.how]
    df = add_along(df.withColumns(plain), {n: s for n, s in specs.items() if isinstance(s, Ewm)}, panel.date, panel.entity)
    return df.select(*panel.keys, *specs)


def _reduced(view: np.ndarray, s: Roll) -> np.ndarray:
    """The reducer over each row of windows (NaN: no value)."""
    seen = (~np.isnan(view)).sum(axis=1)
    some = seen > 0
    out = np.full(len(view), np.nan)
    x = view[some]
    n = seen[some].astype(float)
    if not len(x):
        return out
    mean = np.nansum(x, axis=1) / n
    moment = lambda k: np.nansum((x - mean[:, None]) ** k, axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        if s.how in ("var", "std"):
            y = np.where(n > s.ddof, moment(2) / (n - s.ddof), np.nan)
            y = np.sqrt(y) if s.how == "std" else y
        elif s.how == "skew":
            m2, m3 = moment(2) / n, moment(3) / n
            y = np.where((n > 2) & (m2 > 0), np.sqrt(n * (n - 1)) / (n - 2) * m3 / m2**1.5, np.nan)
        elif s.how == "kurt":
            m2, m4 = moment(2) / n, moment(4) / n
            y = np.where((n > 3) & (m2 > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / m2**2 - 3) + 6), np.nan)
        elif s.how in ("median", "quantile"):
            place = (n - 1) * (0.5 if s.how == "median" else s.quantile)
            low, high, ordered = np.floor(place).astype(int), np.ceil(place).astype(int), np.sort(x, axis=1)  # NaN last
            ends = [ordered[np.arange(len(x)), k] for k in (low, high)]
            y = np.where(low == high, ends[0], (high - place) * ends[0] + (place - low) * ends[1])
        else:
            y = {"mean": lambda: mean, "sum": lambda: np.nansum(x, axis=1), "min": lambda: np.nanmin(x, axis=1), "max": lambda: np.nanmax(x, axis=1)}[s.how]()
    out[some] = y
    out[seen < min(s.least, s.window)] = np.nan
    return out


def rolled(x: np.ndarray, at: np.ndarray, s: Roll) -> np.ndarray:
    """The reducer at the places ``at`` of ``x``, each of which has a whole window before it."""
    view = np.lib.stride_tricks.sliding_window_view(x, s.window) if len(at) else None
    rows = max(1, CELLS // s.window)
    made = [_reduced(view[at[lo : lo + rows] - s.window + 1], s) for lo in range(0, len(at), rows)]
    return np.concatenate(made) if made else np.zeros(0)


def lagged(x: np.ndarray, at: np.ndarray, s: Lag) -> np.ndarray:
    before, now = x[at - s.rows], x[at]
    with np.errstate(invalid="ignore", divide="ignore"):
        if s.how == "value":
            return before
        if s.how == "difference":
            return now - before
        if s.how == "simple":
            return np.where(before != 0, now / np.where(before != 0, before, 1.0), np.nan) - 1
        return np.log(np.where(now > 0, now, np.nan)) - np.log(np.where(before > 0, before, np.nan))


def weighted(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, s: Ewm, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The statistic after every row of many series side by side, and their states (a row of five numbers each) after the
    last; series k has ``sizes[k]`` rows from ``starts[k]`` on."""
    order = np.argsort(-sizes, kind="stable")
    from_, left, out = starts[order], -sizes[order], np.full(len(x), np.nan)
    state = State(*(before[order, i].copy() for i in range(5)))
    for k in range(int(sizes.max(initial=0))):
        some = slice(0, int(np.searchsorted(left, -k)))  # series of more than k rows
        now = step(state.at(some), x[from_[some] + k], s.alpha, s.adjust)
        state.put(some, now)
        out[from_[some] + k] = statistic(now, s.how, s.least)
    after = np.empty_like(before)
    after[order] = np.stack(state.parts, axis=1)
    return out, after


class BucketFeatures(StatefulProcessor):
    """The states and the work of a bucket's entities, side by side in arrays: one read and one write of state a bucket and
    micro-batch, as each costs a round trip between Python and the JVM."""

    def __init__(self, date: str, entity: T.StructField, specs: dict[str, Spec], wait: bool):
        self.date, self.entity, self.kind, self.specs, self.wait = date, entity.name, entity.dataType, specs, wait
        self.columns = list(dict.fromkeys(s.column for s in specs.values()))
        self.ewms = [s for s in dict.fromkeys(specs.values()) if isinstance(s, Ewm)]
        self.back = max([s.window - 1 for s in specs.values() if isinstance(s, Roll)] + [s.rows for s in specs.values() if isinstance(s, Lag)], default=0)

    def init(self, handle) -> None:
        names, longs = T.ArrayType(self.kind), T.ArrayType(T.LongType())
        # entities with their last settled dates, weights and rings (oldest first, NaN where there was no row); waiting rows
        parts = {"names": names, "at": longs, "weights": T.BinaryType(), "ring": T.BinaryType(), "w_names": names, "w_at": longs, "w_x": T.BinaryType()}
        self.kept = handle.getValueState("kept", T.StructType([T.StructField(n, t) for n, t in parts.items()]))
        self.handle = handle

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fresh = pd.concat(list(rows), ignore_index=True)
        moments = fresh[self.date].astype("datetime64[us]").astype("int64").to_numpy()
        values = fresh[self.columns].to_numpy(dtype=float, na_value=np.nan)
        yield from self._settle(fresh[self.entity].tolist(), moments, values, timerValues.getCurrentWatermarkInMs() if self.wait else None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        none = np.zeros((0, len(self.columns)))
        yield from self._settle([], np.zeros(0, dtype=np.int64), none, max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()))

    def _settle(self, who: list, at: np.ndarray, x: np.ndarray, until: int | None) -> Iterator[pd.DataFrame]:
        c = len(self.columns)
        names, last, weights, ring, w_names, w_at, w_x = self.kept.get() if self.kept.exists() else ([], [], b"", b"", [], [], b"")
        who, at = [*w_names, *who], np.concatenate([np.array(w_at, dtype=np.int64), at])
        x = np.concatenate([np.frombuffer(w_x).reshape(-1, c), x])
        known = {n: i for i, n in enumerate(names)}
        code = np.array([known.setdefault(n, len(known)) for n in who], dtype=np.int64)
        names, old = list(known), len(names)
        more = len(names) - old
        last = np.concatenate([np.array(last, dtype=np.int64), np.full(more, NEVER)])
        weights = np.concatenate([np.frombuffer(weights).reshape(old, len(self.ewms), 5), np.zeros((more, len(self.ewms), 5))])
        ring = np.concatenate([np.frombuffer(ring).reshape(old, self.back, c), np.full((more, self.back, c), np.nan)])
        order = np.lexsort([*x.T[::-1], at, code])  # NaN last
        order = order[at[order] > last[code[order]]]
        code, at, x = code[order], at[order], x[order]
        first = np.ones(len(at), dtype=bool)
        first[1:] = (code[1:] != code[:-1]) | (at[1:] != at[:-1])
        ready = first if until is None else first & (at // 1000 <= until)
        held = first & ~ready
        if ready.any():
            yield self._features(names, code[ready], at[ready], x[ready], last, weights, ring)
        w_at = at[held].tolist()
        self.kept.update((names, last.tolist(), weights.tobytes(), ring.tobytes(), [names[i] for i in code[held]], w_at, x[held].tobytes()))
        if self.wait:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if w_at:
                self.handle.registerTimer(min(w_at) // 1000)

    def _features(self, names: list, code: np.ndarray, at: np.ndarray, x: np.ndarray, last: np.ndarray, weights: np.ndarray, ring: np.ndarray) -> pd.DataFrame:
        """Of rows in order of entity and date; ``last``, ``weights`` and ``ring`` move on."""
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        sizes, own = np.diff(np.append(starts, len(code))), code[starts]
        # every entity's ring, then its rows
        heads = starts + self.back * np.arange(len(own))
        places = np.arange(len(code)) + self.back * (1 + np.repeat(np.arange(len(own)), sizes))
        whole = np.empty((len(code) + self.back * len(own), len(self.columns)))
        whole[places] = x
        whole[heads[:, None] + np.arange(self.back)] = ring[own]
        made = {}
        for k, s in enumerate(self.ewms):
            made[s], weights[own, k] = weighted(np.ascontiguousarray(x[:, self.columns.index(s.column)]), starts, sizes, s, weights[own, k])
        for s in self.specs.values():
            if s not in made:
                column = np.ascontiguousarray(whole[:, self.columns.index(s.column)])
                made[s] = rolled(column, places, s) if isinstance(s, Roll) else lagged(column, places, s)
        ring[own] = whole[(heads + sizes)[:, None] + np.arange(self.back)]
        last[own] = at[starts + sizes - 1]
        out = {self.entity: [names[i] for i in code], self.date: at.astype("datetime64[us]")}
        return pd.DataFrame(out | {n: made[s] for n, s in self.specs.items()})

    def close(self) -> None:
        pass


def stream_features(rows: DataFrame, specs: dict[str, Spec], date: str = "date", entity: str = "entity", late: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(entity, date, features) of a streaming DataFrame of panel rows. ``date`` is a timestamp; the session keeps state in
    RocksDB, as user-defined state demands. ``buckets`` stays as it is for the life of a checkpoint."""
    spark = rows.sparkSession
    spark.conf.set(STORE, ROCKS)
    columns = list(dict.fromkeys(s.column for s in specs.values()))
    kinds = rows.schema
    moment = F.col(date).cast("timestamp")
    fed = rows.dropna(subset=[date, entity]).select(F.col(entity), moment.alias(date), *(finite(F.col(c).cast("double")).alias(c) for c in columns))
    fed = (fed.withWatermark(date, late) if late else fed).withColumn(BUCKET, F.pmod(F.xxhash64(entity), F.lit(buckets)))
    schema = T.StructType([kinds[entity], T.StructField(date, T.TimestampType()), *(T.StructField(n, T.DoubleType()) for n in specs)])
    worker = BucketFeatures(date, kinds[entity], dict(specs), late is not None)
    out = fed.groupBy(BUCKET).transformWithStateInPandas(statefulProcessor=worker, outputStructType=schema, outputMode="Append", timeMode="EventTime" if late else "None")
    return out.select(entity, F.col(date).cast(kinds[date].dataType).alias(date), *(finite(F.col(n)).alias(n) for n in specs))


def settle_features(rows: DataFrame, specs: dict[str, Spec], target: str, checkpoint: str, date: str = "date", entity: str = "entity", late: str | None = None, buckets: int = BUCKETS, **trigger):
    """Features appended as Parquet to ``target``; a restart from ``checkpoint`` goes on where it stopped."""
    out = stream_features(rows, specs, date, entity, late, buckets)
    return out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


