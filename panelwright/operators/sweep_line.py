"""Overlapping validity windows cut into disjoint pieces by a sweep over their starts and ends.

Windows of a key come in order of their start. Those that may still hold wait in a heap by preference; the one on top holds
until it ends or a better one starts, and ended ones are thrown out when they come up. So n windows of a key take n log n
steps and as much memory as windows overlap."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Sweep:
    """Pieces (first, last, target) of one key, fed by start; touching pieces of one target are one."""

    def __init__(self) -> None:
        self.waiting: list[tuple[int, int, object]] = []  # (preference, last, target)
        self.at: int | None = None  # from here on nothing is emitted
        self.piece: tuple[int, int, object] | None = None
        self.longest: list[tuple[int, object]] = []  # the last moments of the two targets that hold longest
        self.clash = False

    def _hold(self, first: int, last: int, target: object) -> Iterator[tuple[int, int, object]]:
        if self.piece is not None and self.piece[2] == target and self.piece[1] + 1 == first:
            self.piece = (self.piece[0], last, target)
            return
        if self.piece is not None:
            yield self.piece
        self.piece = (first, last, target)

    def advance(self, to: int | None) -> Iterator[tuple[int, int, object]]:
        """Settle what holds before ``to`` (None: all that is left)."""
        while self.waiting and (to is None or self.at < to):
            _, last, target = self.waiting[0]
            if last < self.at:
                heapq.heappop(self.waiting)
                continue
            until = last if to is None else min(last, to - 1)
            yield from self._hold(self.at, until, target)
            self.at = until + 1
        if to is not None:
            self.at = to
        elif self.piece is not None:
            yield self.piece
            self.piece = None

    def add(self, first: int, last: int, preference: int, target: object) -> Iterator[tuple[int, int, object]]:
        yield from self.advance(first)
        self.clash |= any(end >= first and other != target for end, other in self.longest)
        mine = max([last, *(end for end, other in self.longest if other == target)])
        others = [x for x in self.longest if x[1] != target]
        self.longest = sorted([*others, (mine, target)], key=lambda x: -x[0])[:2]
        heapq.heappush(self.waiting, (preference, last, target))


def disjoint_pieces(windows: DataFrame, keys: list[str], target: str) -> DataFrame:
    """(keys, target, valid_from, valid_to, clash) of rows (keys, target, _a, _b, _p): windows from _a to _b, both included,
    of which the smaller _p is preferred. ``clash`` marks the pieces of keys whose windows of different targets overlap."""
    shape = windows.schema
    columns = [*keys, target]
    kind = T.TimestampNTZType()
    schema = T.StructType([*(shape[c] for c in columns), T.StructField("valid_from", kind), T.StructField("valid_to", kind), T.StructField("clash", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sweep, types = None, Sweep(), None
        out: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                cols = list(zip(*out, strict=True))
                moments = [pa.array(c, pa.int64()).cast(pa.timestamp("us")) for c in cols[-3:-1]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols[:-3], types, strict=True)), *moments, pa.array(cols[-1], pa.bool_())], names=schema.names)
                out.clear()

        for batch in batches:
            if not len(batch):
                continue
            types = [batch.schema.field(c).type for c in columns]
            plain = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            codes = [plain(c).dictionary_encode().indices.to_pylist() for c in keys]
            changed = [True, *(a != b for a, b in pairwise(zip(*codes, strict=True)))]
            first, last = (pc.cast(plain(c), pa.int64()).to_pylist() for c in ("_a", "_b"))
            prefer, goal = plain("_p").to_pylist(), plain(target).to_pylist()
            for i, new in enumerate(changed):
                if new:
                    own = tuple(plain(c)[i].as_py() for c in keys)
                    if own != key:
                        if key is not None:
                            out += [(*key, t, a, b, sweep.clash) for a, b, t in sweep.advance(None)]
                        key, sweep = own, Sweep()
                out += [(*key, t, a, b, sweep.clash) for a, b, t in sweep.add(first[i], last[i], prefer[i], goal[i])]
            yield from flush()
        if key is not None:
            out += [(*key, t, a, b, sweep.clash) for a, b, t in sweep.advance(None)]
        yield from flush()

    dealt = windows.select(*columns, "_a", "_b", "_p").repartition(*(F.col(k) for k in keys)).sortWithinPartitions(*keys, "_a", "_p")
    return dealt.mapInArrow(run, schema)
