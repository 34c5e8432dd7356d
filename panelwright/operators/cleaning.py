"""Cleaning transforms: each takes a panel and returns one; names and parameters are those of the configuration."""

from __future__ import annotations

import operator
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.sessions import sessions as xnys_sessions
from ..panel import Grain, Panel


class CleaningError(ValueError):
    pass


TRANSFORMS: dict[str, tuple[Callable[..., Panel], tuple[Grain, ...]]] = {}


def transform(name: str, *grains: Grain):
    def add(f):
        if name in TRANSFORMS:
            raise CleaningError(f"transform {name!r} is registered already")
        TRANSFORMS[name] = (f, grains or (Grain.PANEL,))
        return f

    return add


def clean(panel: Panel, steps: Sequence[tuple[str, dict]]) -> Panel:
    """Apply transforms in order; a transform refuses grains that it has no meaning for."""
    for name, params in steps:
        if name not in TRANSFORMS:
            raise CleaningError(f"unknown transform {name!r}; there are {sorted(TRANSFORMS)}")
        f, grains = TRANSFORMS[name]
        if panel.grain not in grains:
            raise CleaningError(f"{name} works on {[g.value for g in grains]} panels, not on {panel.grain.value}")
        try:
            panel = f(panel, **params)
        except TypeError as e:
            raise CleaningError(f"{name}: {e}") from e
    return panel


def _need(panel: Panel, columns: Sequence[str]) -> None:
    if missing := [c for c in columns if c not in panel.df.columns]:
        raise CleaningError(f"missing columns {missing}")


def weekday_sessions(panel: Panel, holidays: DataFrame | None = None) -> DataFrame:
    """(session) dates from the panel's first to its last: Monday to Friday without the given (date) holidays."""
    span = panel.df.agg(F.min(panel.date).cast("date").alias("a"), F.max(panel.date).cast("date").alias("b")).filter("a is not null")
    days = span.select(F.explode(F.sequence("a", "b")).alias("session")).filter(F.weekday("session") < 5)
    return days if holidays is None else days.join(holidays.select(F.col("date").cast("date").alias("session")), "session", "left_anti")


@transform("trading_calendar", Grain.PANEL, Grain.TIME_SERIES)
def trading_calendar(panel: Panel, calendar: str | DataFrame = "XNYS") -> Panel:
    """Rows on sessions of the calendar: ``XNYS``, ``weekdays``, or a table with a ``session`` column (a row a day)."""
    if not isinstance(calendar, str):
        sessions = calendar.select(F.col("session").cast("date").alias("session"))
    elif calendar == "weekdays":
        sessions = weekday_sessions(panel)
    elif calendar == "XNYS":
        span = panel.df.agg(F.min(panel.date).cast("date"), F.max(panel.date).cast("date")).first()
        days = xnys_sessions(*span) if span[0] else []
        sessions = panel.df.sparkSession.createDataFrame([(d,) for d in days], "session date")
    else:
        raise CleaningError(f"calendar {calendar!r} isn't built in; give its sessions as a table")
    day = F.col(panel.date).cast("date")
    return panel.with_df(panel.df.withColumn("session", day).join(sessions.distinct(), "session", "left_semi").select(panel.df.columns))


@transform("deduplicate", Grain.PANEL, Grain.TIME_SERIES, Grain.CROSS_SECTION)
def deduplicate(panel: Panel, keys: Sequence[str] = ()) -> Panel:
    """One row a key: numbers are averaged over their values, others take the first value there is.

    First is by the other columns' order, as rows have none of their own. Keys of the panel that are not among ``keys``
    take their smallest value and are never averaged."""
    keys = list(keys) or panel.keys
    _need(panel, keys)
    rest = [c for c in panel.df.columns if c not in keys]
    order = F.struct(*(F.col(c) for c in rest if not isinstance(panel.kind(c), T.MapType)))

    def merged(c: str):
        if c in panel.keys:
            return F.min(c).alias(c)
        if isinstance(panel.kind(c), T.DoubleType | T.FloatType):
            return F.avg(F.when(~F.isnan(c), F.col(c))).alias(c)
        if isinstance(panel.kind(c), T.NumericType):
            return F.avg(c).alias(c)
        return F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)

    return panel.with_df(panel.df.groupBy(*keys).agg(*map(merged, rest)).select(panel.df.columns))


@transform("nan_entity_filter")
def nan_entity_filter(panel: Panel, threshold: float, columns: Sequence[str] = (), subgroup_keys: Sequence[str] = ()) -> Panel:
    """Without entities (or subgroups of them) that lack more than ``threshold`` of any evaluated column."""
    columns = list(columns) or panel.values
    _need(panel, [*columns, *subgroup_keys])
    w = Window.partitionBy(panel.entity, *subgroup_keys)
    missing = lambda c: F.isnan(c) | F.col(c).isNull() if isinstance(panel.kind(c), T.FractionalType) and not isinstance(panel.kind(c), T.DecimalType) else F.col(c).isNull()
    bad = F.greatest(F.lit(0.0), *(F.avg(missing(c).cast("double")).over(w) for c in columns))
    return panel.with_df(panel.df.withColumn("_missing", bad).filter(F.col("_missing") <= threshold).drop("_missing"))


@transform("cumulative_factor")
def cumulative_factor(panel: Panel, factor_column: str, output_column: str) -> Panel:
    """Product of all strictly later factors of the entity; absent, infinite and non-positive ones count as 1."""
    _need(panel, [factor_column])
    x = F.col(factor_column).cast("double")
    usable = F.coalesce(F.when((x > 0) & (x < float("inf")), x), F.lit(1.0))
    later = Window.partitionBy(panel.entity).orderBy(panel.date).rowsBetween(1, Window.unboundedFollowing)
    return panel.with_df(panel.df.withColumn(output_column, F.coalesce(F.product(usable).over(later), F.lit(1.0))))


@transform("corporate_adjustment", *Grain)
def corporate_adjustment(panel: Panel, adjustments: Sequence[dict]) -> Panel:
    """Columns divided or multiplied by a factor column, in order; division by 0 gives NULL."""
    df = panel.df
    for a in adjustments:
        _need(panel, [*a["columns"], a["factor_column"]])
        if a["operation"] not in ("divide", "multiply"):
            raise CleaningError(f"operation must be divide or multiply, not {a['operation']!r}")
        by = F.col(a["factor_column"]).cast("double")
        df = df.withColumns({c: F.try_divide(F.col(c).cast("double"), by) if a["operation"] == "divide" else F.col(c) * by for c in a["columns"]})
    return panel.with_df(df)


@transform("consistency", *Grain)
def consistency(panel: Panel, rules: Sequence[dict]) -> Panel:
    """Values (or ``target``) that break a rule become NULL; rules apply one after the other and see earlier NULLs."""
    df = panel.df
    for r in rules:
        if r["op"] not in ("gt", "ge", "lt", "le") or (r.get("bound") is None) == (r.get("other_column") is None):
            raise CleaningError(f"a rule needs an op of gt, ge, lt, le and a bound or another column: {r}")
        _need(panel, [c for c in (r["column"], r.get("other_column"), r.get("target")) if c])
        right = F.lit(r["bound"]) if r.get("other_column") is None else F.col(r["other_column"])
        target = r.get("target") or r["column"]
        broken = ~getattr(operator, r["op"])(F.col(r["column"]), right)
        df = df.withColumn(target, F.when(F.coalesce(broken, F.lit(False)), F.lit(None)).otherwise(F.col(target)))
    return panel.with_df(df)


@transform("forward_fill")
def forward_fill(panel: Panel, columns: Sequence[str] = (), limit: int | None = None) -> Panel:
    """The last value of the entity, carried over at most ``limit`` rows."""
    columns = list(columns) or panel.values
    _need(panel, columns)
    if limit is not None and limit <= 0:
        raise CleaningError("limit must be positive")
    w = Window.partitionBy(panel.entity).orderBy(panel.date).rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0)
    return panel.with_df(panel.df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns}))


@transform("constant_fill", *Grain)
def constant_fill(panel: Panel, columns: Sequence[str], value: float) -> Panel:
    _need(panel, columns)
    return panel.with_df(panel.df.withColumns({c: F.coalesce(F.col(c), F.lit(value).cast(panel.kind(c))) for c in columns}))
