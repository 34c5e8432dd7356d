"""Column builders over one panel's windows: rows within an entity (in date order) and rows of a date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from .nulls import sdiv, ssqrt

REDUCERS = ("mean", "std", "var", "sum", "min", "max", "median", "skew", "kurt", "quantile")


def between(ordered: Column, share: float) -> Column:
    """The linearly interpolated quantile of a sorted array; NULL of an empty one."""
    at = (F.size(ordered) - 1) * F.lit(float(share))
    low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
    some = F.when(F.size(ordered) > 0, F.get(ordered, low))
    return F.when(low == high, some).otherwise((high - at) * some + (at - low) * F.get(ordered, high))


class Frames:
    def __init__(self, date: str, entity: str):
        self.date, self.entity = date, entity
        self.series = Window.partitionBy(entity).orderBy(date)
        self.whole = Window.partitionBy(entity)
        self.section = Window.partitionBy(date)

    def last(self, n: int) -> WindowSpec:
        return self.series.rowsBetween(-(n - 1), 0)

    @property
    def sofar(self) -> WindowSpec:
        return self.series.rowsBetween(Window.unboundedPreceding, 0)

    def lag(self, x: Column, k: int = 1) -> Column:
        return F.lag(x, k).over(self.series) if k >= 0 else F.lead(x, -k).over(self.series)

    def running(self, x: Column, how=F.sum) -> Column:
        """Accumulates over rows that have a value and is NULL on those that have none."""
        return F.when(x.isNotNull(), how(x).over(self.sofar))

    def roll(self, how: str, x: Column, n: int, least: int, ddof: int = 1, quantile: float | None = None) -> Column:
        """A reducer over the last n rows where at least min(least, n) of them have a value."""
        w = self.last(n)
        seen = F.count(x).over(w)
        if how in ("var", "std"):
            spread = F.var_samp(x).over(w) if ddof == 1 else F.var_pop(x).over(w) * seen / (seen - ddof)
            out = F.when(seen > ddof, spread)
            out = ssqrt(out) if how == "std" else out
        elif how == "skew":
            out = F.when(seen > 2, F.sqrt(seen * (seen - 1)) / (seen - 2) * F.skewness(x).over(w))
        elif how == "kurt":
            out = F.when(seen > 3, (seen - 1) / ((seen - 2) * (seen - 3)) * ((seen + 1) * F.kurtosis(x).over(w) + 6))
        elif how in ("median", "quantile"):
            out = between(F.array_sort(F.collect_list(x).over(w)), 0.5 if how == "median" else quantile)
        else:
            out = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}[how](x).over(w)
        return F.when(seen >= min(least, n), out)

    # per date

    def rank(self, x: Column, method: str = "average", ascending: bool = True, by: str = "raw") -> Column:
        tied = Window.partitionBy(self.date, x)
        order = Window.partitionBy(self.date, x.isNull()).orderBy(x if ascending else x.desc(), *([self.entity] if method == "first" else []))
        rank = F.dense_rank().over(order) if method == "dense" else F.row_number().over(order) if method == "first" else F.rank().over(order)
        if method in ("average", "max"):
            rank = rank + (F.count(x).over(tied) - 1) / (2 if method == "average" else 1)
        seen = F.count(x).over(self.section)
        if by == "pct":
            back = Window.partitionBy(self.date, x.isNull()).orderBy(x.desc() if ascending else x)
            rank = rank / (rank + F.dense_rank().over(back) - 1 if method == "dense" else seen)  # distinct values of the date
        elif by == "signed":
            rank = F.when(seen > 1, 2 * (rank - 1) / (seen - 1) - 1).otherwise(F.lit(0.0))
        return F.when(x.isNotNull(), rank.cast("double"))

    def std(self, x: Column, w: WindowSpec, ddof: int) -> Column:
        seen = F.count(x).over(w)
        return F.when(seen > ddof, F.sqrt(F.var_pop(x).over(w) * seen / (seen - ddof)))

    def zscore(self, x: Column, w: WindowSpec, ddof: int) -> Column:
        spread = self.std(x, w, ddof)
        return F.when(spread > 0, sdiv(x - F.avg(x).over(w), spread))
