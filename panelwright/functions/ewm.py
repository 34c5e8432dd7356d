"""Exponentially weighted means and spreads: a recursion along each entity, all columns of a layer in one pass.

``add_along`` brings an entity's rows together in one task. ``scan_ewms`` gives the same columns by a parallel prefix scan
over ranges of (entity, date), for entities too long for that: every range tells what it does to the state before it, the
few numbers of each range are composed in order, and every range then goes on from the state that reaches it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.taskcontext import TaskContext

from ..plans.shared import kept_partitions
from .recursion import State, Stretch, along, joined, one_summary, passed
from .sliding import Slide


@dataclass(frozen=True)
class Ewm:
    """Mean, variance or deviation of a column (by name) with decay alpha; absent rows decay the weights and carry the
    value on."""

    column: str
    alpha: float
    adjust: bool
    least: int
    how: str = "mean"

    def over(self, x: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Along each run of equal group numbers, all runs in one pass; NaN is missing."""
        w = pd.Series(x).groupby(group, sort=False).ewm(alpha=self.alpha, adjust=self.adjust, ignore_na=False, min_periods=self.least)
        return {"mean": w.mean, "var": w.var, "std": w.std}[self.how]().to_numpy()

    @classmethod
    def span(cls, column: str, span: float, adjust: bool, least: int) -> Ewm:
        return cls(column, 2.0 / (span + 1.0), adjust, least)


def add_along(df: DataFrame, specs: dict[str, Ewm | Slide], date: str, entity: str) -> DataFrame:
    """``df`` with a column for each spec, all in one pass. An entity's rows meet in one task; entities are taken as they
    come, many at a time."""
    distinct: dict[Ewm | Slide, list[str]] = {}
    for name, spec in specs.items():
        distinct.setdefault(spec, []).append(name)

    def change(column: pa.ChunkedArray) -> np.ndarray:
        """Whether each row but the first has another entity than the row before it."""
        code = pc.fill_null(column.combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        return code[1:] != code[:-1]

    def grown(parts: list[pa.Table]) -> list[pa.RecordBatch]:
        table = pa.concat_tables(parts)
        group = np.concatenate([[0], np.cumsum(change(table[entity]))])
        for spec, names in distinct.items():
            y = spec.over(np.asarray(table[spec.column].to_numpy(), dtype=float), group)
            made = pa.array(y, mask=np.isnan(y))
            for name in names:
                table = table.append_column(name, made)
        return table.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # the last entity may go on in the next batch
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            if held and change(pa.chunked_array([held[-1][entity].chunk(0).slice(len(held[-1]) - 1), table[entity].chunk(0).slice(0, 1)]))[0]:
                yield from grown(held)
                held = []
            cut = np.flatnonzero(change(table[entity]))
            if len(cut):
                yield from grown([*held, table.slice(0, int(cut[-1]) + 1)])
                held, table = [], table.slice(int(cut[-1]) + 1).combine_chunks()
            held.append(table)
        if held:
            yield from grown(held)

    order = [n for names in distinct.values() for n in names]
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in order)])
    return df.repartition(F.col(f"`{entity}`")).sortWithinPartitions(f"`{entity}`", f"`{date}`").mapInArrow(run, schema)


def in_ranges(df: DataFrame, *order: str, parts: int | None = None) -> DataFrame:
    """``df`` dealt and sorted by ranges of ``order`` and kept so: the same rows are in the same partitions at every use."""
    keys = [F.col(f"`{c}`") for c in order]
    dealt = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    return kept_partitions(dealt.sortWithinPartitions(*keys))


def _runs(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Numbers, in order, of the runs of equal values."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    code = pc.fill_null(whole.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(code[1:] != code[:-1])])


def _doubles(column: pa.Array) -> np.ndarray:
    return np.asarray(column.cast(pa.float64()).to_numpy(zero_copy_only=False), dtype=float)


def scan_ewms(df: DataFrame, specs: dict[str, Ewm], date: str, entity: str, parts: int | None = None) -> DataFrame:
    """As ``add_along``, but an entity's rows may lie in any number of tasks. ``parts`` ranges are made, or as many as Spark
    shuffles into; the driver composes one small row a range. Rows of one (entity, date) stay together."""
    distinct: dict[Ewm, list[str]] = {}
    for name, spec in specs.items():
        distinct.setdefault(spec, []).append(name)
    dealt = in_ranges(df, entity, date, parts=parts)
    kind = df.schema[entity].dataType

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """First and last entity of the range, what its rows do if there is one entity, else the state after the last."""
        first = last = None
        runs = 0
        whole: dict[Ewm, Stretch] = {}
        state: dict[Ewm, State] = {}
        for batch in batches:
            if not len(batch):
                continue
            group = _runs(batch.column(0))
            goes_on = runs > 0 and batch.column(0)[0].as_py() == last
            if not runs:
                first = batch.column(0)[0].as_py()
            runs += int(group[-1]) + (not goes_on)
            last = batch.column(0)[len(batch) - 1].as_py()
            tail = group == group[-1]
            for spec in distinct:
                x = _doubles(batch.column(1 + columns.index(spec.column)))
                if runs == 1:
                    f = one_summary(x, spec.alpha, spec.adjust)
                    whole[spec] = joined(whole[spec], f, spec.alpha, spec.adjust) if spec in whole else f
                else:
                    before = State.empty(1)
                    if goes_on and group[-1] == 0:
                        before = state[spec] if spec in state else passed(before, whole[spec], spec.alpha, spec.adjust)
                    state[spec] = passed(before, one_summary(x[tail], spec.alpha, spec.adjust), spec.alpha, spec.adjust)
        if not runs:
            return
        told = [(f.lead, f.first, *f.rest.parts, f.kept) for f in whole.values()] if runs == 1 else [s.parts for s in state.values()]
        numbers = [[float(v[0]) for v in t] for t in told]
        yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "one": runs == 1, "first": first, "last": last, "numbers": numbers}], schema=pa_ends)

    columns = list(dict.fromkeys(s.column for s in distinct))
    pa_ends = pa.schema([("part", pa.int32()), ("one", pa.bool_()), ("first", to_arrow_type(kind)), ("last", to_arrow_type(kind)), ("numbers", pa.list_(pa.list_(pa.float64())))])
    slim = dealt.select(F.col(f"`{entity}`"), *(F.col(f"`{c}`").cast("double") for c in columns))
    told = slim.mapInArrow(ends, T.StructType([T.StructField("part", T.IntegerType()), T.StructField("one", T.BooleanType()), T.StructField("first", kind), T.StructField("last", kind), T.StructField("numbers", T.ArrayType(T.ArrayType(T.DoubleType())))])).collect()  # a row a range

    reached: dict[int, list[State] | None] = {}
    after: tuple | None = None  # the last entity so far and its states
    for r in sorted(told, key=lambda r: r["part"]):
        before = after[1] if after is not None and after[0] == r["first"] else None
        reached[r["part"]] = before
        now = []
        for k, spec in enumerate(distinct):
            v = [np.array([x]) for x in r["numbers"][k]]
            now.append(passed(before[k] if before else State.empty(1), Stretch(v[0], v[1], State(*v[2:7]), v[7]), spec.alpha, spec.adjust) if r["one"] else State(*v))
        after = (r["last"], now)
    shared = df.sparkSession.sparkContext.broadcast(reached)  # a few numbers a range

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = shared.value.get(TaskContext.get().partitionId())
        last: tuple | None = None
        for batch in batches:
            if not len(batch):
                continue
            names = batch.column(batch.schema.get_field_index(entity))
            if last is not None and last[0] != names[0].as_py():
                states = None
            group, after, made = _runs(names), [], {}
            for k, (spec, outs) in enumerate(distinct.items()):
                y, state = along(_doubles(batch.column(batch.schema.get_field_index(spec.column))), group, spec.alpha, spec.adjust, spec.how, spec.least, states[k] if states else None)
                after.append(state)
                made.update(dict.fromkeys(outs, pa.array(y, mask=np.isnan(y))))
            states, last = after, (names[len(batch) - 1].as_py(),)
            yield pa.RecordBatch.from_arrays([*batch.columns, *made.values()], names=[*batch.schema.names, *made])

    order = [n for names in distinct.values() for n in names]
    return dealt.mapInArrow(finish, T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in order)]))
