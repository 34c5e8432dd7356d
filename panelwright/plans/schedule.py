"""Fold schedules over ordered dates: single cuts and walk-forward windows, as half-open position ranges."""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranges import numbered
from ..panel import Panel

log = logging.getLogger(__name__)


class SplitError(ValueError):
    pass


@dataclass(frozen=True)
class Bounds:
    """Train, validation and test positions [start, stop) of one fold."""

    fold: int
    train: tuple[int, int]
    val: tuple[int, int]
    test: tuple[int, int]


@dataclass(frozen=True)
class WalkForward:
    train_size: int
    val_size: int
    test_size: int
    mode: str = "rolling"
    step: int | None = None
    purge: int = 0
    max_folds: int | None = None

    def __post_init__(self) -> None:
        if self.mode not in ("rolling", "expanding"):
            raise SplitError(f"mode must be rolling or expanding, not {self.mode!r}")
        if min(self.train_size, self.test_size) <= 0 or min(self.val_size, self.purge) < 0 or (self.step or 1) <= 0:
            raise SplitError("sizes and step must be positive, val_size and purge not negative")

    @property
    def span(self) -> int:
        return self.train_size + self.purge + self.val_size + self.purge + self.test_size

    def folds(self, n: int) -> list[Bounds]:
        """Whole folds only; the test windows advance by ``step`` (their size by default)."""
        step = self.step or self.test_size
        if n < self.span:
            raise SplitError(f"{n} dates can't hold a fold of {self.span}")
        count = (n - self.span) // step + 1
        if self.max_folds is not None:
            count = min(count, self.max_folds)
        if step < self.test_size:
            log.warning("test windows overlap: step %d < test_size %d counts dates twice", step, self.test_size)
        out = []
        for k in range(count):
            at = k * step
            end = at + self.train_size
            val = (end + self.purge, end + self.purge + self.val_size)
            test = (val[1] + self.purge, val[1] + self.purge + self.test_size)
            out.append(Bounds(k, (0 if self.mode == "expanding" else at, end), val, test))
        return out


@dataclass(frozen=True)
class Split:
    scheme: str = "single"
    train_end: str | None = None
    val_end: str | None = None
    train_fraction: float = 0.6
    val_fraction: float = 0.8
    burn_in: int = 0
    walk_forward: WalkForward | None = None

    def __post_init__(self) -> None:
        if self.scheme not in ("single", "walk_forward") or (self.scheme == "walk_forward") != (self.walk_forward is not None):
            raise SplitError("scheme must be single, or walk_forward with its windows")
        if not 0 < self.train_fraction <= self.val_fraction < 1 or self.burn_in < 0:
            raise SplitError("need 0 < train_fraction <= val_fraction < 1 and burn_in >= 0")

    def plan(self, dates: Sequence) -> list[Bounds]:
        """Folds over sorted distinct dates; positions count from the first date, burnt-in ones included."""
        if len(dates) <= self.burn_in:
            raise SplitError(f"burn_in {self.burn_in} leaves none of {len(dates)} dates")
        kept = dates[self.burn_in :]
        if self.walk_forward is not None:
            folds = self.walk_forward.folds(len(kept))
        else:
            cut = lambda end, share: next((i for i, d in enumerate(kept) if d > _moment(end)), len(kept)) if end else next(i for i, d in enumerate(kept) if d >= kept[int(len(kept) * share)]) + 1
            a, b = cut(self.train_end, self.train_fraction), cut(self.val_end, self.val_fraction)
            if a == 0 or b < a:
                raise SplitError("the train range is empty or ends after the validation range")
            folds = [Bounds(0, (0, a), (a, b), (b, len(kept)))]
        off = self.burn_in
        move = lambda r: (r[0] + off, r[1] + off)
        return [Bounds(f.fold, move(f.train), move(f.val), move(f.test)) for f in folds]

    def rebased(self, dates: Sequence, surviving: Sequence) -> Split:
        """The same cuts for a table that keeps only the ``surviving`` dates: burn-in counts those before the same date,
        fractional cuts become dates."""
        if not surviving:
            raise SplitError("no date survives")
        first = dates[self.burn_in] if self.burn_in < len(dates) else None
        burn = len(surviving) if first is None else sum(d < first for d in surviving)
        out = replace(self, burn_in=burn)
        if self.scheme == "single":
            kept = dates[self.burn_in :]
            pin = lambda end, share: end or str(kept[int(len(kept) * share)])
            out = replace(out, train_end=pin(self.train_end, self.train_fraction), val_end=pin(self.val_end, self.val_fraction))
        return out


def _moment(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def panel_dates(panel: Panel) -> list[dt.datetime]:
    """Sorted distinct dates: one value a period comes to the driver."""
    rows = panel.df.select(F.col(panel.date).cast("timestamp_ntz").alias("d")).dropna().distinct().orderBy("d").collect()
    return [r["d"] for r in rows]


def positions(panel: Panel) -> DataFrame:
    """(date, pos) with pos counting the panel's dates from 0."""
    return numbered(panel.df.select(F.col(panel.date).alias("date")).dropna().distinct(), "date", "pos")


def fold_table(spark, folds: Sequence[Bounds]) -> DataFrame:
    rows = [(f.fold, part, *getattr(f, part)) for f in folds for part in ("train", "val", "test")]
    return spark.createDataFrame(rows, "fold int, part string, start long, stop long")


def fold_members(panel: Panel, folds: Sequence[Bounds]) -> DataFrame:
    """(fold, part, date) of all periods of all folds; joined to a panel it tells each row's folds."""
    at = positions(panel)
    table = fold_table(panel.df.sparkSession, folds)
    days = table.select("fold", "part", F.explode(F.when(F.col("start") < F.col("stop"), F.sequence("start", F.col("stop") - 1))).alias("pos"))
    return days.join(at, "pos").select("fold", "part", "date")


def slices(panel: Panel, folds: Sequence[Bounds]) -> Iterator[tuple[Bounds, Panel, Panel, Panel]]:
    """Each fold with its three panels, as filters that reach the scan."""
    dates = panel_dates(panel)

    def part(r: tuple[int, int]) -> Panel:
        if r[0] >= r[1]:
            return panel.with_df(panel.df.limit(0))
        at = F.col(panel.date).cast("timestamp_ntz")
        return panel.with_df(panel.df.filter(at.between(F.lit(dates[r[0]]).cast("timestamp_ntz"), F.lit(dates[r[1] - 1]).cast("timestamp_ntz"))))

    for f in folds:
        yield f, part(f.train), part(f.val), part(f.test)
