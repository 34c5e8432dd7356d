"""Alignment of panels of any grain onto the keys of a spine; never adds, drops or multiplies spine rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranges import carried_forward
from ..panel import Grain, Panel, PanelError, PanelSet, as_moment, require_comparable, require_unique


class AlignmentError(PanelError):
    pass


ALIGNERS: dict[str, tuple[Callable[..., DataFrame], Grain]] = {}
_UNITS = {"D": 86_400_000_000, "H": 3_600_000_000, "T": 60_000_000, "MIN": 60_000_000, "S": 1_000_000, "MS": 1_000, "US": 1, "W": 7 * 86_400_000_000, "DAY": 86_400_000_000, "DAYS": 86_400_000_000, "HOURS": 3_600_000_000}


def microseconds(span: str) -> int:
    """Of a text such as ``45D`` or ``1D 12h``."""
    parts = re.findall(r"([-+]?\d+(?:\.\d+)?)\s*([A-Za-z]+)", span)
    if not parts or re.sub(r"[-+]?\d+(?:\.\d+)?\s*[A-Za-z]+|\s", "", span) or any(u.upper() not in _UNITS for _, u in parts):
        raise AlignmentError(f"{span!r} is not a time span such as 45D")
    return sum(round(float(n) * _UNITS[u.upper()]) for n, u in parts)


def aligner(name: str, grain: Grain):
    def add(f):
        ALIGNERS[name] = (f, grain)
        return f

    return add


def _same_kind(spine: Panel, source: Panel, *keys: tuple[str | None, str | None]) -> None:
    for a, b in keys:
        require_comparable(spine.kind(a), source.kind(b), f"{a} and {b}")


@aligner("exact", Grain.PANEL)
def exact(spine: Panel, source: Panel, take: dict[str, str]) -> DataFrame:
    _same_kind(spine, source, (spine.date, source.date), (spine.entity, source.entity))
    require_unique(source.df, source.keys, "exact alignment")
    side = source.df.dropna(subset=source.keys).select(F.col(source.date).alias("_d"), F.col(source.entity).alias("_e"), *(F.col(c).alias(o) for c, o in take.items()))
    on = (spine.df[spine.date] == side["_d"]) & (spine.df[spine.entity] == side["_e"])
    return spine.df.join(side, on, "left").drop("_d", "_e")


def _as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str], inclusive: bool, order: Sequence[str], limit: int | None) -> DataFrame:
    """For each row of ``left`` (keys, ``at``) the values of the latest row of ``right`` (keys, ``at``, order, values) at or
    before it: both sides run through one window, the source before the spine where equal times match."""
    first, then = (0, 1) if inclusive else (1, 0)
    payload = F.struct(F.col("at").alias("since"), *values)
    kind = payload
    rows = left.select(*keys, "at", F.lit(then).alias("side"), F.struct(*(c for c in left.columns if c not in keys and c != "at")).alias("row"), F.lit(None).alias("hit"), *(F.lit(None).cast(right.schema[o].dataType).alias(f"_o{i}") for i, o in enumerate(order)))
    src = right.select(*keys, "at", F.lit(first).alias("side"), F.lit(None).alias("row"), kind.alias("hit"), *(F.col(o).alias(f"_o{i}") for i, o in enumerate(order)))
    both = rows.unionByName(src)
    w = Window.partitionBy(*keys).orderBy("at", "side", *(f"_o{i}" for i in range(len(order)))).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("hit", F.last("hit", ignorenulls=True).over(w)).filter(F.col("side") == then)
    fresh = F.lit(True) if limit is None else F.timestamp_diff("MICROSECOND", F.col("hit.since"), F.col("at")) <= limit
    return out.select(*keys, "at", "row.*", *(F.when(fresh, F.col(f"hit.{v}")).alias(v) for v in values))


@aligner("asof_entity", Grain.PANEL)
def asof_entity(spine: Panel, source: Panel, take: dict[str, str], availability_column: str | None = None, lag: str | None = None, tolerance: str | None = None, allow_exact: bool = True) -> DataFrame:
    """The latest source row of the entity that was available (after ``lag``) at the spine's date. Of equal times the one
    last in (date, entity, values) order holds. ``tolerance`` judges that row only: no older one stands in for it."""
    _same_kind(spine, source, (spine.entity, source.entity))
    when = availability_column or source.date
    src = as_moment(source.df, when)
    src = src.withColumn("at", F.col(when) + F.expr(f"interval {microseconds(lag)} microseconds") if lag else F.col(when))
    src = src.dropna(subset=["at", source.entity]).select(F.col(source.entity).alias("_e"), "at", F.col(source.date).alias("_by"), *(F.col(c).alias(o) for c, o in take.items()))
    left = as_moment(spine.df, spine.date).withColumn("at", F.col(spine.date)).withColumn("_e", F.col(spine.entity))
    out = _as_of(left, src, ["_e"], list(take.values()), allow_exact, ["_by", *take.values()], microseconds(tolerance) if tolerance else None)
    return out.drop("_e", "at")


@aligner("broadcast_time", Grain.TIME_SERIES)
def broadcast_time(spine: Panel, source: Panel, take: dict[str, str], as_of: bool = False, tolerance: str | None = None) -> DataFrame:
    """Each date's values for every entity of that date. As of: the distinct spine dates and the source run through one order
    that is dealt by ranges of time, so any number of stamps may be resolved; then joined by date."""
    if tolerance and not as_of:
        raise AlignmentError("tolerance needs as_of")
    _same_kind(spine, source, (spine.date, source.date))
    require_unique(source.df, [source.date], "broadcast_time")
    side = source.df.dropna(subset=[source.date]).select(F.col(source.date).alias("_d"), *(F.col(c).alias(o) for c, o in take.items()))
    if as_of:
        kind = spine.df.schema[spine.date].dataType
        given = as_moment(side, "_d").select(F.col("_d").alias("at"), F.lit(0).alias("side"), F.struct(F.col("_d").alias("since"), *take.values()).alias("hit"))
        dates = as_moment(spine.df.select(F.col(spine.date).alias("at")).dropna().distinct(), "at")
        asked = dates.select("at", F.lit(1).alias("side"), F.lit(None).cast(given.schema["hit"].dataType).alias("hit"))
        found = carried_forward(given.unionByName(asked), ["at", "side"], "hit").filter("side = 1")
        fresh = F.lit(True) if tolerance is None else F.timestamp_diff("MICROSECOND", F.col("hit.since"), F.col("at")) <= microseconds(tolerance)
        side = found.select(F.col("at").cast(kind).alias("_d"), *(F.when(fresh, F.col(f"hit.{o}")).alias(o) for o in take.values()))
    return spine.df.join(side, spine.df[spine.date] == side["_d"], "left").drop("_d")


@aligner("broadcast_entity", Grain.CROSS_SECTION)
def broadcast_entity(spine: Panel, source: Panel, take: dict[str, str]) -> DataFrame:
    _same_kind(spine, source, (spine.entity, source.entity))
    require_unique(source.df, [source.entity], "broadcast_entity")
    side = source.df.dropna(subset=[source.entity]).select(F.col(source.entity).alias("_e"), *(F.col(c).alias(o) for c, o in take.items()))
    return spine.df.join(side, spine.df[spine.entity] == side["_e"], "left").drop("_e")


@dataclass(frozen=True)
class Join:
    panel: str
    aligner: str
    params: dict = field(default_factory=dict)
    columns: Sequence[str] | None = None
    exclude: Sequence[str] = ()
    prefix: str = ""
    rename: dict[str, str] = field(default_factory=dict)  # of prefixed names
    required: bool = False
    min_coverage: float = 0.0

    def take(self, source: Panel) -> dict[str, str]:
        wanted = [c for c in (self.columns if self.columns is not None else source.values) if c not in self.exclude]
        if missing := [c for c in [*wanted, *self.exclude] if c not in source.df.columns]:
            raise AlignmentError(f"{self.panel} has no columns {missing}")
        named = {c: self.prefix + c for c in wanted}
        if unknown := [k for k in self.rename if k not in named.values()]:
            raise AlignmentError(f"{self.panel}: nothing is named {unknown} after the prefix")
        return {c: self.rename.get(o, o) for c, o in named.items()}


def merge_panels(panels: PanelSet, spine: str, joins: Sequence[Join], spine_columns: Sequence[str] | None = None) -> Panel:
    base = panels[spine]
    if base.grain is not Grain.PANEL:
        raise AlignmentError(f"the spine must be a (date, entity) panel, not {base.grain.value}")
    require_unique(base.df, base.keys, f"spine {spine}")
    columns = base.values if spine_columns is None else list(spine_columns)
    out = base.with_df(base.df.select(*base.keys, *columns))
    checks: dict[str, Column] = {}
    for k, j in enumerate(joins):
        source = panels[j.panel]
        if j.aligner not in ALIGNERS:
            raise AlignmentError(f"unknown aligner {j.aligner!r}; there are {sorted(ALIGNERS)}")
        f, grain = ALIGNERS[j.aligner]
        if source.grain is not grain:
            raise AlignmentError(f"{j.aligner} takes {grain.value} panels; {j.panel} is {source.grain.value}")
        take = j.take(source)
        if clash := [o for o in take.values() if o in out.df.columns] or len(set(take.values())) < len(take):
            raise AlignmentError(f"{j.panel}: columns {clash} collide")
        out = out.with_df(f(out, source, take, **j.params))
        if j.required or j.min_coverage:
            any_ = reduce(lambda a, b: a | b, (F.col(o).isNotNull() for o in take.values()), F.lit(False))
            checks[f"c{k}"] = F.avg(any_.cast("int"))
    if checks:  # one action for all joins
        seen = out.df.agg(*(c.alias(n) for n, c in checks.items())).first()
        for k, j in enumerate(joins):
            share = seen[f"c{k}"] or 0.0 if f"c{k}" in checks else 1.0
            if share < j.min_coverage or (j.required and share == 0.0):
                raise AlignmentError(f"{j.panel} covers {share:.4f} of the spine; {j.min_coverage} is required")
    return out
