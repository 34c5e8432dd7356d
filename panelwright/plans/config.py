"""Configuration: plain mappings (YAML or dicts) into specifications, resolved completely before any data is read."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

import yaml
from pyspark.sql import SparkSession

from ..operators.alignment import ALIGNERS, Join, merge_panels
from ..operators.cleaning import TRANSFORMS, clean
from ..operators.features import Feature
from ..operators.linking import LinkTable, Normalization, normalized, relink
from ..panel import Grain, Panel, PanelSet
from ..sources.filters import FILTERS, RowSelection
from ..sources.tables import CsvOptions, PanelSpec, Schema
from .feature_plan import FeaturePipeline, Selection
from .schedule import Bounds, Split, WalkForward, panel_dates
from .stages import Stage, StageCache, resolve, source_identity, stage_key


class ConfigError(ValueError):
    pass


def load_yaml(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def _known(what: str, given: Mapping, names: set[str]) -> None:
    if unknown := sorted(set(given) - names):
        raise ConfigError(f"{what}: unknown settings {unknown}; there are {sorted(names)}")


def _steps(items, registry: Mapping, what: str) -> tuple[tuple[str, dict], ...]:
    out = []
    for s in items or ():
        if s["type"] not in registry:
            raise ConfigError(f"unknown {what} {s['type']!r}; there are {sorted(registry)}")
        out.append((s["type"], dict(s.get("params") or {})))
    return tuple(out)


def panel_spec(c: Mapping) -> PanelSpec:
    _known("panel", c, {"path", "format", "schema", "columns", "exclude", "selection", "filters", "options"})
    tup = lambda x: None if x is None else tuple(x)
    s, sel, opt = dict(c.get("schema") or {}), dict(c.get("selection") or {}), dict(c.get("options") or {})
    schema = Schema(**{k: tup(v) if isinstance(v, list) else v for k, v in s.items()})
    rows = RowSelection(sel.get("start_date"), sel.get("end_date"), tup(sel.get("entities")))
    options = CsvOptions(**{k: tup(v) if isinstance(v, list) else v for k, v in opt.items()})
    return PanelSpec(c["path"], schema, c.get("format", "csv"), tup(c.get("columns")), tuple(c.get("exclude") or ()), rows, _steps(c.get("filters"), FILTERS, "filter"), options)


def selection(c: Mapping | None, default: Selection) -> Selection:
    if c is None:
        return default
    inc = c.get("include", None)
    return Selection(None if inc is None else tuple(inc), tuple(c.get("exclude") or ()), c.get("strict", True))


def feature_pipeline(c: Mapping) -> FeaturePipeline:
    _known("features", c, {"featurizers", "keep_inputs", "keep_features", "output_dtype", "drop_warmup"})
    items = c.get("featurizers") or []
    made = tuple(Feature(f["type"], dict(f.get("params") or {})) for f in items)
    inner = frozenset(i for f in items for i in f.get("intermediate") or ())
    dtype = {None: None, "float32": "float", "float64": "double"}[c.get("output_dtype")]
    return FeaturePipeline(made, selection(c.get("keep_inputs"), Selection(include=())), selection(c.get("keep_features"), Selection()), inner, dtype, bool(c.get("drop_warmup", True)))


@dataclass(frozen=True)
class LinkSpec:
    mode: str
    source_keys: tuple[str, ...]
    target: str
    table: str | None = None
    table_keys: tuple[str, ...] | None = None
    valid_from: str | None = None
    valid_to: str | None = None
    normalize: tuple[tuple[str, Normalization], ...] = ()
    on_ambiguous: str = "error"
    on_unmatched: str = "drop"
    on_collision: str = "error"

    @classmethod
    def of(cls, c: Mapping) -> LinkSpec:
        if c.get("mode", "table") not in ("table", "spine", "identity") or (c.get("mode", "table") == "table") != bool(c.get("table")):
            raise ConfigError("a link's mode is table (with a table), spine or identity")
        norm = tuple((k, Normalization(**v)) for k, v in (c.get("normalize") or {}).items())
        rest = {k: v for k, v in c.items() if k not in ("mode", "source_keys", "table_keys", "normalize")}
        return cls(c.get("mode", "table"), tuple(c["source_keys"]), normalize=norm, table_keys=tuple(c["table_keys"]) if c.get("table_keys") else None, **rest)

    def apply(self, source: Panel, panels: PanelSet, spine: Panel) -> Panel:
        keys = list(self.table_keys or self.source_keys)
        rules = dict(self.normalize)
        if self.mode == "identity":
            table = LinkTable.identity(normalized(source.df, rules), self.source_keys[0], self.target)
        elif self.mode == "spine":
            table = LinkTable.from_spine(spine, keys)
        else:
            df = normalized(panels[self.table].df, {k: rules[s] for k, s in zip(keys, self.source_keys, strict=True) if s in rules})
            table = LinkTable.over_time(df, keys, self.target, self.valid_from, self.valid_to, self.on_ambiguous) if self.valid_from else LinkTable.fixed(df, keys, self.target, self.on_ambiguous)
        return relink(source, table, self.source_keys, spine.entity, self.on_unmatched, self.on_collision, rules)


@dataclass(frozen=True)
class Adapter:
    """Ingest -> clean -> features a panel; link and align onto the spine; clean and features of the merged panel; split."""

    panels: dict[str, PanelSpec]
    spine: str
    joins: tuple[tuple[Join, LinkSpec | None], ...]
    spine_columns: tuple[str, ...] | None
    cleaning: dict[str, tuple[tuple[str, dict], ...]]
    panel_features: dict[str, FeaturePipeline]
    merged_cleaning: tuple[tuple[str, dict], ...]
    features: FeaturePipeline | None
    split: Split

    @classmethod
    def of(cls, c: Mapping) -> Adapter:
        _known("adapter", c, {"ingestion", "preprocessing", "panel_features", "alignment", "merged_preprocessing", "features", "split"})
        panels = {k: panel_spec(v) for k, v in c["ingestion"]["panels"].items()}
        a = c.get("alignment") or {"spine": next(iter(panels))}
        joins = []
        for j in a.get("joins") or ():
            al = j["aligner"]
            if al["type"] not in ALIGNERS:
                raise ConfigError(f"unknown aligner {al['type']!r}; there are {sorted(ALIGNERS)}")
            rest = {k: v for k, v in j.items() if k not in ("aligner", "link")}
            joins.append((Join(aligner=al["type"], params=dict(al.get("params") or {}), **rest), LinkSpec.of(j["link"]) if j.get("link") else None))
        unknown = {a["spine"], *(j.panel for j, _ in joins), *(k.table for _, k in joins if k and k.table)} - set(panels)
        if unknown:
            raise ConfigError(f"no panels named {sorted(unknown)}")
        s = dict(c.get("split") or {})
        wf = s.pop("walk_forward", None)
        split = Split(**s, walk_forward=WalkForward(**wf) if wf and s.get("scheme") == "walk_forward" else None)
        cols = a.get("spine_columns")
        return cls(
            panels, a["spine"], tuple(joins), None if cols is None else tuple(cols),
            {k: _steps(v, TRANSFORMS, "transform") for k, v in (c.get("preprocessing") or {}).items()},
            {k: feature_pipeline(v) for k, v in (c.get("panel_features") or {}).items()},
            _steps(c.get("merged_preprocessing"), TRANSFORMS, "transform"),
            feature_pipeline(c["features"]) if c.get("features") else None, split,
        )

    @property
    def referenced(self) -> list[str]:
        used = {self.spine, *(j.panel for j, _ in self.joins), *(k.table for _, k in self.joins if k and k.table)}
        return [p for p in self.panels if p in used]

    def build(self, spark: SparkSession, cache: StageCache | None = None) -> Panel:
        """All stage keys are known before any data is read; each chain resumes after its deepest artifact."""
        keys, made = {}, PanelSet()
        for name in self.referenced:
            spec = self.panels[name]
            keys[name] = stage_key(spec, "", source_identity(spark, spec.path) if cache else ())
            stages = [Stage(f"ingest {name}", keys[name], lambda _, s=spec: s.load(spark).df)]
            shape = Panel(spec.load(spark).df.limit(0), spec.schema.date, spec.schema.entity)
            for label, step in (("clean", self.cleaning.get(name)), ("features", self.panel_features.get(name))):
                if step:
                    keys[name] = stage_key([label, step], keys[name])
                    run = (lambda df, p=shape, s=step: clean(p.with_df(df), s).df) if label == "clean" else (lambda df, p=shape, s=step: s.apply(p.with_df(df)).df)
                    stages.append(Stage(f"{label} {name}", keys[name], run))
            made[name] = shape.with_df(resolve(stages, cache))
        spine = made[self.spine]

        def merged(_):
            panels = PanelSet(made)
            for j, link in self.joins:
                if link:
                    panels[j.panel] = link.apply(made[j.panel], made, spine)
            return merge_panels(panels, self.spine, [j for j, _ in self.joins], self.spine_columns).df

        key = stage_key(["merge", self.spine, self.joins, self.spine_columns], [keys[n] for n in self.referenced])
        stages = [Stage("merge", key, merged)]
        if self.merged_cleaning:
            key = stage_key(["clean", self.merged_cleaning], key)
            stages.append(Stage("clean merged", key, lambda df: clean(Panel(df, spine.date, spine.entity), self.merged_cleaning).df))
        if self.features:
            key = stage_key(["features", self.features], key)
            stages.append(Stage("features", key, lambda df: self.features.apply(Panel(df, spine.date, spine.entity)).df))
        return Panel(resolve(stages, cache), spine.date, spine.entity)

    def folds(self, panel: Panel) -> list[Bounds]:
        if panel.grain is not Grain.PANEL:
            raise ConfigError("folds need a (date, entity) panel")
        return self.split.plan(panel_dates(panel))


def check(config: Mapping) -> list[str]:
    """Resolve every type name and parameter without data; the problems found."""
    try:
        Adapter.of(config)
    except (ValueError, TypeError, KeyError) as e:
        return [f"{type(e).__name__}: {e}"]
    return []
