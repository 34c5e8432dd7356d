"""A feature pipeline: recipes checked against each other and layered before any job runs.

Steps that can be computed together make one layer, so the plan has as many projections as the dependency graph is deep
and not as many as there are features; windows of one entity order share a single exchange and sort."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ewm import Ewm, add_along, scan_ewms
from ..functions.nulls import finite
from ..functions.windows import Frames
from ..operators.features import Feature, FeatureError
from ..operators.features.base import Step
from ..panel import Grain, Panel


@dataclass(frozen=True)
class Selection:
    """Which columns to keep: include (None: all) in its order, without exclude; unknown names are refused if strict."""

    include: tuple[str, ...] | None = None
    exclude: tuple[str, ...] = ()
    strict: bool = True

    def of(self, columns: Sequence[str]) -> list[str]:
        unknown = [c for c in (*(self.include or ()), *self.exclude) if c not in columns]
        if unknown and self.strict:
            raise KeyError(f"no such columns: {unknown}; there are {list(columns)}")
        return [c for c in (columns if self.include is None else self.include) if c in columns and c not in self.exclude]


@dataclass(frozen=True)
class FeaturePipeline:
    features: tuple[Feature, ...]
    keep_inputs: Selection = Selection(include=())
    keep_features: Selection = Selection()
    intermediate: frozenset[str] = frozenset()  # outputs that only feed later features
    output_dtype: str | None = None
    drop_warmup: bool = False
    long_entities: bool = False  # exponential weights by a scan over ranges, so that an entity needn't meet in one task
    made: tuple[str, ...] = field(init=False, default=())

    def __post_init__(self) -> None:
        by: dict[str, str] = {}
        for f in self.features:
            for o in f.outputs:
                if o in by:
                    raise FeatureError(f"{o} is produced by both {by[o]} and {f.type}")
                by[o] = f.type
        seen: set[str] = set()
        for f in self.features:
            if early := [i for i in f.inputs if i in by and i not in seen]:
                raise FeatureError(f"{f.type} reads {early} before they are produced")
            seen.update(f.outputs)
        used = {i for f in self.features for i in f.inputs}
        if idle := sorted(self.intermediate - set(by)) or sorted(self.intermediate - used):
            raise FeatureError(f"intermediate columns {idle} are never produced and consumed")
        object.__setattr__(self, "made", tuple(by))
        self.keep_features.of(self.made)

    def layers(self, frames: Frames, given: Sequence[str]) -> list[Step]:
        depth = dict.fromkeys(given, 0)
        out: list[Step] = []
        for f in self.features:
            at = max((depth[i] for i in f.inputs), default=0)
            for step in f.steps(frames):
                at += 1
                while len(out) < at:
                    out.append({})
                out[at - 1].update(step)
                depth.update(dict.fromkeys(step, at))
        return out

    def apply(self, panel: Panel) -> Panel:
        if panel.grain is not Grain.PANEL:
            raise FeatureError(f"features need a (date, entity) panel, not {panel.grain.value}")
        columns = panel.df.columns
        if clash := [o for o in self.made if o in columns]:
            raise FeatureError(f"outputs {clash} are columns already")
        needed = list(dict.fromkeys(i for f in self.features for i in f.inputs if i not in self.made))
        if missing := [c for c in needed if c not in columns]:
            raise FeatureError(f"missing input columns {missing}")
        inputs = self.keep_inputs.of(panel.values)
        numeric = {c for c in needed if isinstance(panel.kind(c), T.NumericType) and c not in panel.keys}
        df = panel.df.select(*panel.keys, *(F.col(c).alias(f"kept {c}") for c in inputs), *((finite(F.col(c).cast("double")).alias(c) if c in numeric else F.col(c)) for c in needed if c not in panel.keys))
        df = self._run(df, Frames(panel.date, panel.entity), [*columns])
        kept = [c for c in self.keep_features.of(self.made) if c not in self.intermediate]
        cast = (lambda c: F.col(c).cast(self.output_dtype).alias(c)) if self.output_dtype else F.col
        df = df.select(*panel.keys, *(F.col(f"kept {c}").alias(c) for c in inputs), *(cast(c) for c in kept))
        return panel.with_df(self._warm(df, panel.date, kept) if self.drop_warmup else df)

    def _run(self, df: DataFrame, frames: Frames, given: list[str]) -> DataFrame:
        for layer in self.layers(frames, given):
            if plain := {k: v for k, v in layer.items() if isinstance(v, Column)}:
                df = df.withColumns(plain)
            passes = {k: v for k, v in layer.items() if not isinstance(v, Column)}
            if self.long_entities and (ewms := {k: v for k, v in passes.items() if isinstance(v, Ewm)}):
                df = scan_ewms(df, ewms, frames.date, frames.entity)
                passes = {k: v for k, v in passes.items() if k not in ewms}
            if passes:
                df = add_along(df, passes, frames.date, frames.entity)
        return df

    @staticmethod
    def _warm(df: DataFrame, date: str, kept: list[str]) -> DataFrame:
        """From the first date on which every feature that is ever defined has been defined for some entity."""
        first = df.agg(*(F.min(F.when(F.col(c).isNotNull(), F.col(date))).alias(c) for c in kept)).first() if kept else None
        starts = [d for d in first or () if d is not None]
        return df.filter(F.col(date) >= F.lit(max(starts))) if starts else df


def add_features(panel: Panel, *specs: tuple[str, dict], **options) -> Panel:
    return FeaturePipeline(tuple(Feature(t, p) for t, p in specs), **options).apply(panel)
