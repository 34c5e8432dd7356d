"""Panel sources: declared schemas over CSV and Parquet, behind a registry of formats."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..panel import Panel, PanelError
from .filters import RowSelection, apply_filters

#: Declared type names and their SQL types.
TYPES = {"int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "float32": "float", "float64": "double", "string": "string", "category": "string", "bool": "boolean", "datetime": "timestamp_ntz"}
#: Texts that read as missing unless keep_default_na is off.
DEFAULT_NA = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
_CODES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%j": "DDD", "%%": "%"}


class MissingColumns(PanelError):
    pass


def java_pattern(strptime: str) -> str:
    """``%d/%m/%Y`` as ``dd/MM/yyyy``; letters that aren't codes are quoted."""
    return re.sub(r"%.|[A-Za-z]+", lambda m: _CODES[m[0]] if m[0] in _CODES else f"'{m[0]}'", strptime)


@dataclass(frozen=True)
class Schema:
    """Declared, never inferred: every column that is read from text needs a type or is a date. Parquet files carry types of
    their own, which declared ones must agree with."""

    date: str | None = None
    entity: str | None = None
    dtypes: dict[str, str] = field(default_factory=dict)
    date_columns: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    date_format: str = "%Y-%m-%d"
    out_of_bounds_dates: str = "raise"

    def __post_init__(self) -> None:
        if self.date is not None and self.date == self.entity:
            raise PanelError("date and entity need distinct columns")
        if bad := sorted({*self.dtypes.values()} - {*TYPES, *(t.capitalize() for t in TYPES)}):
            raise PanelError(f"unknown types {bad}; there are {sorted(TYPES)}")
        if self.out_of_bounds_dates not in ("raise", "coerce"):
            raise PanelError("out_of_bounds_dates must be raise or coerce")

    @property
    def dates(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((*((self.date,) if self.date else ()), *self.date_columns)))

    def kind(self, column: str) -> str:
        if column in self.dates:
            return "timestamp_ntz"
        if column in self.categorical:
            return "string"
        if column not in self.dtypes:
            raise PanelError(f"column {column!r} has no declared type")
        return TYPES[self.dtypes[column].lower()]

    def parsed(self, column: str, text: Column, decimal: str = ".") -> Column:
        kind = self.kind(column)
        if column in self.dates:
            made = F.to_timestamp_ntz if self.out_of_bounds_dates == "raise" else F.try_to_timestamp
            return made(text, F.lit(java_pattern(self.date_format))).cast("timestamp_ntz")
        if kind in ("double", "float") and decimal != ".":
            text = F.replace(text, F.lit(decimal), F.lit("."))
        return text.cast(kind)

    def declares(self, column: str) -> bool:
        return column in self.dates or column in self.categorical or column in self.dtypes

    def typed(self, column: str, have: T.DataType) -> Column:
        """A column of a typed file as its declared type. Text is parsed; numbers widen or narrow with a check of range, but
        fractions never become whole numbers; other kinds must be the declared one."""
        x = F.col(f"`{column}`")
        if not self.declares(column):
            return x
        kind = self.kind(column)
        if isinstance(have, T.StringType):
            return self.parsed(column, x)
        whole = isinstance(have, T.IntegralType)
        fits = {
            "timestamp_ntz": isinstance(have, T.TimestampNTZType | T.TimestampType | T.DateType),
            "boolean": isinstance(have, T.BooleanType),
            "string": False,
            "double": isinstance(have, T.NumericType),
            "float": isinstance(have, T.NumericType),
        }.get(kind, whole)
        if not fits:
            raise PanelError(f"column {column!r} is {have.simpleString()} in the file but declared {kind}")
        return x.cast(kind)


@dataclass(frozen=True)
class CsvOptions:
    delimiter: str = ","
    encoding: str = "utf-8"
    decimal: str = "."
    na_values: tuple[str, ...] = ()
    keep_default_na: bool = True


def read_csv(spark: SparkSession, path: str, schema: Schema, columns: Sequence[str] | None = None, options: CsvOptions = CsvOptions()) -> DataFrame:
    """Typed columns in file order. The header is checked against the schema; texts that mean missing become NULL; a value
    that doesn't parse fails the job."""
    raw = spark.read.csv(path, header=True, sep=options.delimiter, encoding=options.encoding, inferSchema=False, nullValue=None, emptyValue="")
    named = [k for k in (schema.entity, schema.date) if k]
    wanted = list(raw.columns) if columns is None else [*named, *(c for c in columns if c not in named)]
    if missing := [c for c in {*wanted, *named, *schema.dtypes, *schema.dates, *schema.categorical} if c not in raw.columns]:
        raise MissingColumns(f"{path} has no columns {sorted(missing)}; it has {raw.columns}")
    absent = [*options.na_values, *(DEFAULT_NA if options.keep_default_na else ())]
    clear = lambda c: F.when(~F.col(f"`{c}`").isin(absent), F.col(f"`{c}`")) if absent else F.col(f"`{c}`")
    return raw.select(*(schema.parsed(c, clear(c), options.decimal).alias(c) for c in wanted))


def read_parquet(spark: SparkSession, path: str, schema: Schema, columns: Sequence[str] | None = None, options: CsvOptions | None = None) -> DataFrame:
    """Declared columns as their declared types, or refused; others as the file has them."""
    df = spark.read.parquet(path)
    named = [k for k in (schema.entity, schema.date) if k]
    wanted = list(df.columns) if columns is None else [*named, *(c for c in columns if c not in named)]
    if missing := sorted({*wanted, *named, *schema.dtypes, *schema.dates, *schema.categorical} - {*df.columns}):
        raise MissingColumns(f"{path} has no columns {missing}; it has {df.columns}")
    return df.select(*(schema.typed(c, df.schema[c].dataType).alias(c) for c in wanted))


SOURCES: dict[str, Callable[..., DataFrame]] = {"csv": read_csv, "parquet": read_parquet}


def register_source(name: str, reader: Callable[..., DataFrame]) -> None:
    if name in SOURCES:
        raise PanelError(f"source format {name!r} is registered already")
    SOURCES[name] = reader


@dataclass(frozen=True)
class PanelSpec:
    path: str
    schema: Schema
    format: str = "csv"
    columns: tuple[str, ...] | None = None
    exclude: tuple[str, ...] = ()
    rows: RowSelection = RowSelection()
    filters: tuple[tuple[str, dict], ...] = ()
    options: CsvOptions = CsvOptions()

    def load(self, spark: SparkSession) -> Panel:
        """Lazy: row selection reaches the scan, cross-sectional filters run on the selected rows."""
        if self.format not in SOURCES:
            raise PanelError(f"unknown source format {self.format!r}; there are {sorted(SOURCES)}")
        df = SOURCES[self.format](spark, self.path, self.schema, self.columns, self.options)
        panel = self.rows.apply(Panel(df, self.schema.date, self.schema.entity))
        real = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType) and f.name not in panel.keys]
        panel = panel.with_df(panel.df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in real}) if real else panel.df)  # missing is NULL
        panel = apply_filters(panel, list(self.filters))
        return panel.with_df(panel.df.drop(*(c for c in self.exclude if c not in panel.keys)))
