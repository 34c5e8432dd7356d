"""Featurizers: named recipes that add columns to a panel.

A recipe is a generator of steps. A step is a dict of new columns, each a Column, an Ewm or a Slide; it may read the inputs and
the columns of earlier steps. Inputs and outputs are told by the annotations of the recipe's parameters, so a pipeline
knows its whole dependency graph before any job."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column

from ...functions.ewm import Ewm
from ...functions.sliding import Slide
from ...functions.windows import Frames

Col, Cols, Out, Outs = "Col", "Cols", "Out", "Outs"
Step = dict[str, "Column | Ewm | Slide"]


class FeatureError(ValueError):
    pass


REGISTRY: dict[str, Callable[..., Iterator[Step]]] = {}


def feature(name: str):
    def add(recipe):
        if name in REGISTRY:
            raise FeatureError(f"feature type {name!r} is registered already")
        REGISTRY[name] = recipe
        return recipe

    return add


@dataclass(frozen=True)
class Feature:
    """A feature type with its parameters, checked on construction."""

    type: str
    params: dict[str, Any]

    def __post_init__(self) -> None:
        if self.type not in REGISTRY:
            raise FeatureError(f"unknown feature type {self.type!r}; there are {sorted(REGISTRY)}")
        try:
            bound = inspect.signature(REGISTRY[self.type]).bind(None, **self.params)
        except TypeError as e:
            raise FeatureError(f"{self.type}: {e}") from e
        bound.apply_defaults()
        fixed = {k: tuple(v) if isinstance(v, list) else v for k, v in bound.arguments.items() if k != "c"}
        object.__setattr__(self, "params", fixed)
        names = self.outputs
        if len(set(names)) != len(names) or not names:
            raise FeatureError(f"{self.type}: output names {names} must be distinct")
        listed = {k: len(v) for k, v in fixed.items() if isinstance(v, tuple) and k in ("windows", "horizons", "periods", "near_offsets", "far_offsets", "fast_windows", "slow_windows", "input_columns", "attributes")}
        for k, n in listed.items():
            if self._kinds("Outs") and self.type != "ultimate_oscillator" and any(n != len(fixed[o]) for o in self._kinds("Outs")):
                raise FeatureError(f"{self.type}: {k} and the output names differ in number")
        for k in ("windows", "horizons", "fast_windows", "slow_windows"):
            if any(int(w) <= 0 for w in fixed.get(k, ()) or ()):
                raise FeatureError(f"{self.type}: {k} must be positive")
        for _ in REGISTRY[self.type].__dict__.get("check", lambda **_: ())(**fixed):
            raise FeatureError(f"{self.type}: {_}")

    def _kinds(self, *kinds: str) -> list[str]:
        notes = REGISTRY[self.type].__annotations__
        return [k for k, note in notes.items() if note in kinds]

    def _names(self, *kinds: str) -> tuple[str, ...]:
        out: list[str] = []
        for k in self._kinds(*kinds):
            v = self.params[k]
            out += [v] if isinstance(v, str) else [] if v is None else list(v)
        return tuple(out)

    @property
    def inputs(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(self._names("Col", "Cols")))

    @property
    def outputs(self) -> tuple[str, ...]:
        return self._names("Out", "Outs")

    def steps(self, frames: Frames) -> list[Step]:
        return list(REGISTRY[self.type](Recipe(frames, f"_{self.type}_{self.outputs[0]}_"), **self.params))


class Recipe:
    """What recipes build columns with: the panel's frames and names for scratch columns."""

    def __init__(self, frames: Frames, prefix: str):
        self.frames, self.prefix = frames, prefix

    def tmp(self, name: str) -> str:
        return self.prefix + name
