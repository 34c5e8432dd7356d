"""The data model: a panel is a DataFrame plus the names of its key columns."""

from __future__ import annotations

import enum
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class PanelError(ValueError):
    pass


class Grain(enum.Enum):
    PANEL = "panel"  # date and entity
    TIME_SERIES = "time_series"  # date
    CROSS_SECTION = "cross_section"  # entity
    TABLE = "table"  # no key


@dataclass(frozen=True)
class Panel:
    df: DataFrame
    date: str | None = "date"
    entity: str | None = "entity"

    def __post_init__(self) -> None:
        missing = [k for k in self.keys if k not in self.df.columns]
        if missing:
            raise PanelError(f"key columns {missing} are not among {self.df.columns}")
        if self.date is not None and self.date == self.entity:
            raise PanelError("date and entity need distinct columns")

    @property
    def keys(self) -> list[str]:
        return [k for k in (self.date, self.entity) if k is not None]

    @property
    def grain(self) -> Grain:
        return {(True, True): Grain.PANEL, (True, False): Grain.TIME_SERIES, (False, True): Grain.CROSS_SECTION, (False, False): Grain.TABLE}[self.date is not None, self.entity is not None]

    @property
    def values(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.keys]

    def with_df(self, df: DataFrame) -> Panel:
        return replace(self, df=df)

    def kind(self, column: str) -> T.DataType:
        return self.df.schema[column].dataType


class PanelSet(dict):
    """Named panels; an unknown name is both a PanelError and a KeyError."""

    class Unknown(PanelError, KeyError):
        pass

    def __missing__(self, name: str):
        raise PanelSet.Unknown(f"no panel named {name!r}; there are {sorted(self)}")


def require_unique(df: DataFrame, keys: list[str], what: str) -> None:
    """Refuse rows that share non-null keys: a join would multiply them."""
    some = df.dropna(subset=keys).groupBy(*keys).count().filter("count > 1").limit(5).collect()
    if some:
        raise PanelError(f"{what}: keys {keys} repeat, e.g. {[tuple(r[k] for k in keys) for r in some]}")


def kind_of(dtype: T.DataType) -> str:
    """The family within which keys may be compared; Spark would cast silently across families."""
    if isinstance(dtype, T.TimestampType):
        return "instant with zone"
    if isinstance(dtype, T.DateType | T.TimestampNTZType):
        return "datetime"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    return "number" if isinstance(dtype, T.NumericType) else dtype.typeName()


def require_comparable(left: T.DataType, right: T.DataType, what: str) -> None:
    if kind_of(left) != kind_of(right):
        raise PanelError(f"{what}: {kind_of(left)} keys can't be matched with {kind_of(right)} keys")


def as_moment(df: DataFrame, column: str) -> DataFrame:
    """Dates and local timestamps as local timestamps; zoned ones are refused."""
    kind = df.schema[column].dataType
    if kind_of(kind) != "datetime":
        raise PanelError(f"{column} is {kind.simpleString()}, not a date or a timestamp without zone")
    return df.withColumn(column, F.col(column).cast("timestamp_ntz")) if isinstance(kind, T.DateType) else df
