"""Row selection and cross-sectional filters at ingestion."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..panel import Panel, PanelError

FILTERS: dict[str, Callable[..., Panel]] = {}


def register_filter(name: str):
    def add(f):
        FILTERS[name] = f
        return f

    return add


@dataclass(frozen=True)
class RowSelection:
    """Inclusive date range and entities; both reach the scan as pushed filters."""

    start_date: str | None = None
    end_date: str | None = None
    entities: tuple[Any, ...] | None = None

    def apply(self, panel: Panel) -> Panel:
        df = panel.df
        if self.start_date or self.end_date:
            if panel.date is None:
                raise PanelError("a date range needs a date key")
            at, kind = F.col(panel.date), panel.kind(panel.date)
            if self.start_date:
                df = df.filter(at >= F.lit(self.start_date).cast(kind))
            if self.end_date:
                df = df.filter(at <= F.lit(self.end_date).cast(kind))
        if self.entities is not None:
            if panel.entity is None:
                raise PanelError("selected entities need an entity key")
            df = df.filter(F.col(panel.entity).isin([self._coerced(e, panel.kind(panel.entity)) for e in self.entities]))
        return panel.with_df(df)

    @staticmethod
    def _coerced(value: Any, kind: T.DataType) -> Any:
        if isinstance(kind, T.IntegralType):
            try:
                whole = int(value)
                if float(value) != whole:
                    raise ValueError(value)
                return whole
            except (TypeError, ValueError) as e:
                raise PanelError(f"entity {value!r} isn't a whole number like its key") from e
        return str(value) if isinstance(kind, T.StringType) else value


@register_filter("top_n_market_cap")
def top_n_market_cap(panel: Panel, n: int, market_cap_column: str | None = None, price_column: str | None = None, shares_column: str | None = None) -> Panel:
    """The n largest of each date by |cap| or |price| * shares; without a cap a row goes; ties by entity."""
    if (market_cap_column is None) == (price_column is None or shares_column is None):
        raise PanelError("give market_cap_column, or price_column and shares_column")
    cap = F.abs(F.col(market_cap_column)) if market_cap_column else F.abs(F.col(price_column)) * F.col(shares_column)
    w = Window.partitionBy(panel.date).orderBy(F.col("_cap").desc(), panel.entity)
    df = panel.df.withColumn("_cap", cap.cast("double")).filter("_cap is not null and not isnan(_cap)")
    return panel.with_df(df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n", "_cap"))


def apply_filters(panel: Panel, specs: list[tuple[str, dict]]) -> Panel:
    for name, params in specs:
        if name not in FILTERS:
            raise PanelError(f"unknown filter {name!r}; there are {sorted(FILTERS)}")
        panel = FILTERS[name](panel, **params)
    return panel
