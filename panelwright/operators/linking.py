"""Translation of identifiers through link tables, fixed or with validity windows (both ends inclusive)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.ranges import carried_forward, numbered
from ..panel import Panel, PanelError, require_comparable
from ..plans.shared import settled
from .sweep_line import disjoint_pieces

ALWAYS, OPEN = "1678-01-01", "9999-12-31"


def tick() -> Column:
    return F.expr("interval 1 microsecond")


class LinkError(PanelError):
    pass


@dataclass(frozen=True)
class Normalization:
    strip: bool = True
    upper: bool = False
    zfill: int | None = None
    empty_as_missing: bool = True

    def apply(self, x: Column) -> Column:
        x = F.trim(x) if self.strip else x
        x = F.nullif(x, F.lit("")) if self.empty_as_missing else x
        x = F.upper(x) if self.upper else x
        if self.zfill:  # lpad would cut longer keys
            x = F.when(F.length(x) < self.zfill, F.lpad(x, self.zfill, "0")).otherwise(x)
        return x


def normalized(df: DataFrame, rules: dict[str, Normalization]) -> DataFrame:
    for c in rules:
        if not isinstance(df.schema[c].dataType, T.StringType):
            raise LinkError(f"{c} isn't text; only text keys are normalised")
    return df.withColumns({c: r.apply(F.col(c)) for c, r in rules.items()}) if rules else df


@dataclass(frozen=True)
class LinkTable:
    """(keys..., target[, valid_from, valid_to]) with at most one target a key at a time."""

    df: DataFrame
    keys: tuple[str, ...]
    target: str
    windowed: bool = False

    @classmethod
    def identity(cls, df: DataFrame, key: str, target: str) -> LinkTable:
        some = df.select(F.col(key).alias(key), F.col(key).alias(target)).dropna().distinct()
        if some.isEmpty():
            raise LinkError(f"{key} has no values")
        return cls(some, (key,), target)

    @classmethod
    def fixed(cls, df: DataFrame, keys: Sequence[str], target: str, on_ambiguous: str = "error", order: Sequence[str] = ()) -> LinkTable:
        """One target a key. ``order`` (else the target itself) says which row is first where several disagree."""
        some = df.dropna(subset=[*keys, target])
        groups = some.groupBy(*keys)
        if on_ambiguous == "error":
            table = groups.agg(F.min(target).alias(target), F.count_distinct(target).alias("_n"))
            if bad := table.filter("_n > 1").limit(5).collect():
                raise LinkError(f"keys with several targets, e.g. {[tuple(r[k] for k in keys) for r in bad]}")
            return cls(table.drop("_n"), tuple(keys), target)
        by = F.struct(*(order or [target]), target)
        return cls(groups.agg({"first": F.min_by, "last": F.max_by}[on_ambiguous](target, by).alias(target)), tuple(keys), target)

    @classmethod
    def over_time(cls, df: DataFrame, keys: Sequence[str], target: str, valid_from: str, valid_to: str | None = None, on_ambiguous: str = "error", order: Sequence[str] = ()) -> LinkTable:
        """Validity windows made disjoint a key. Without ``valid_to`` a row holds until the key's next. Windows that
        overlap with different targets are refused or cut into pieces of which the first or last row's target wins."""
        keys = list(keys)
        moment = lambda c, default: F.coalesce(F.col(c).cast("timestamp_ntz"), F.lit(default).cast("timestamp_ntz"))
        some = df.dropna(subset=[*keys, target]).select(*keys, F.col(target).alias("_t"), moment(valid_from, ALWAYS).alias("_a"), *([moment(valid_to, OPEN).alias("_b")] if valid_to else []), F.struct(*(order or [valid_from, target])).alias("_o"))
        if not valid_to:
            pick = {"error": F.min_by, "first": F.min_by, "last": F.max_by}[on_ambiguous]
            steps = some.groupBy(*keys, "_a").agg(pick("_t", "_o").alias("_t"), F.count_distinct("_t").alias("_n"))
            cls._refuse(steps.filter("_n > 1"), keys, on_ambiguous)
            w = Window.partitionBy(*keys).orderBy("_a")
            steps = steps.withColumn("_b", F.coalesce(F.lead("_a").over(w) - tick(), F.lit(OPEN).cast("timestamp_ntz")))
            return cls(steps.select(*keys, F.col("_t").alias(target), F.col("_a").alias("valid_from"), F.col("_b").alias("valid_to")), tuple(keys), target, True)
        if back := some.filter("_b < _a").limit(5).collect():
            raise LinkError(f"windows that end before they start, e.g. {[tuple(r[k] for k in keys) for r in back]}")
        # preference among windows that hold at once: their order, else their place in it from the end
        order = [F.col("_o"), F.col("_t")] if on_ambiguous != "last" else [F.col("_o").desc(), F.col("_t").desc()]
        ranked = some.withColumn("_p", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).withColumnRenamed("_t", target)
        pieces = settled(disjoint_pieces(ranked, keys, target), "links")
        cls._refuse(pieces.filter("clash"), keys, on_ambiguous)
        return cls(pieces.drop("clash"), tuple(keys), target, True)

    @staticmethod
    def _refuse(bad: DataFrame, keys: list[str], on_ambiguous: str) -> None:
        if on_ambiguous == "error" and (some := bad.limit(5).collect()):
            raise LinkError(f"overlapping windows with different targets, e.g. {[tuple(r[k] for k in keys) for r in some]}")

    @classmethod
    def from_spine(cls, spine: Panel, keys: Sequence[str], close_last: bool = False) -> LinkTable:
        """The spine's own identifier columns as windows; a window ends where the pair skips a date that the spine has."""
        keys = list(keys)
        dates = spine.df.select(F.col(spine.date).cast("timestamp_ntz").alias("_d")).dropna().distinct()
        place = numbered(dates, "_d", "_i")
        pairs = spine.df.select(*keys, F.col(spine.entity).alias("_t"), F.col(spine.date).cast("timestamp_ntz").alias("_d")).dropna().distinct().join(place, "_d")
        w = Window.partitionBy(*keys, "_t").orderBy("_i")
        runs = pairs.withColumn("_run", F.col("_i") - F.row_number().over(w)).groupBy(*keys, "_t", "_run").agg(F.min("_d").alias("_a"), F.max("_d").alias("_b"))
        if not close_last:
            last = Window.partitionBy(*keys)
            runs = runs.withColumn("_b", F.when(F.col("_b") == F.max("_b").over(last), F.lit(OPEN).cast("timestamp_ntz")).otherwise(F.col("_b")))
        return cls.over_time(runs.withColumnRenamed("_t", spine.entity), keys, spine.entity, "_a", "_b")

    def resolve(self, df: DataFrame, source_keys: Sequence[str], date: str | None, out: str) -> DataFrame:
        """``df`` with the target as ``out``: NULL where a key part is NULL or no window holds the date."""
        for a, b in zip(source_keys, self.keys, strict=True):
            require_comparable(df.schema[a].dataType, self.df.schema[b].dataType, f"{a} and {b}")
        places = [f"_k{i}" for i in range(len(self.keys))]
        named = [F.col(k).alias(p) for k, p in zip(self.keys, places, strict=True)]
        if not self.windowed:
            link = self.df.select(*named, F.col(self.target).alias(out))
            return df.join(link, [df[a] == link[p] for a, p in zip(source_keys, places, strict=True)], "left").drop(*places)
        # pieces and the asked moments run through one order of (keys, time), dealt by ranges: linear in both
        hit = F.struct(*(F.col(p) for p in places), F.col(self.target).alias("to"), "valid_to")
        pieces = self.df.select(*named, F.col("valid_from").alias("_at"), F.lit(0).alias("_side"), self.target, "valid_to").select(*places, "_at", "_side", hit.alias("hit"))
        asked = df.select(*(F.col(a).alias(p) for a, p in zip(source_keys, places, strict=True)), F.col(date).cast("timestamp_ntz").alias("_at")).dropna().distinct()
        asked = asked.select(*places, "_at", F.lit(1).alias("_side"), F.lit(None).cast(pieces.schema["hit"].dataType).alias("hit"))
        found = carried_forward(pieces.unionByName(asked), [*places, "_at", "_side"], "hit").filter("_side = 1")
        holds = reduce(lambda x, y: x & y, (F.col(f"hit.{p}") == F.col(p) for p in places)) & (F.col("_at") <= F.col("hit.valid_to"))
        link = found.filter(holds).select(*places, "_at", F.col("hit.to").alias(out))
        on = [df[a] == link[p] for a, p in zip(source_keys, places, strict=True)] + [df[date].cast("timestamp_ntz") == link["_at"]]
        return df.join(link, on, "left").drop(*places, "_at")


def relink(panel: Panel, table: LinkTable, source_keys: Sequence[str], target: str, on_unmatched: str = "drop", on_collision: str = "error", normalize: dict[str, Normalization] | None = None) -> Panel:
    """``panel`` with ``target`` as its entity in place of the source keys.

    Rows that several sources bring to one (date, target) are refused, or the first or last by source keys and values
    stays, or numbers are summed or averaged. Unmatched rows that are kept never collide."""
    df = normalized(panel.df, normalize or {})
    source = [k for k in source_keys]
    hit = table.resolve(df, source, panel.date, "_to")
    if on_unmatched == "error" and (bad := hit.filter("_to is null").limit(5).collect()):
        raise LinkError(f"unmatched keys, e.g. {[tuple(r[k] for k in source) for r in bad]}")
    keys = [k for k in (panel.date,) if k is not None]
    values = [c for c in panel.df.columns if c not in (*keys, *source, target)]
    loose = hit.filter("_to is null") if on_unmatched == "keep" else None
    some = hit.filter("_to is not null")
    if on_collision == "error":
        if bad := some.groupBy(*keys, "_to").count().filter("count > 1").limit(5).collect():
            raise LinkError(f"several rows come to one key, e.g. {[tuple(r)[:-1] for r in bad]}")
    elif on_collision in ("first", "last"):
        up = on_collision == "first"
        order = [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_first() for c in (*source, *values)]
        some = some.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_to").orderBy(*order))).filter("_n = 1").drop("_n")
    else:
        if odd := [c for c in values if not isinstance(panel.kind(c), T.NumericType)]:
            raise LinkError(f"{on_collision} needs numbers; {odd} aren't")
        made = (F.coalesce(F.sum(c), F.lit(0)) if on_collision == "sum" else F.avg(c) for c in values)
        some = some.groupBy(*keys, "_to").agg(*(m.cast("double").alias(c) for m, c in zip(made, values, strict=True)))
        loose = loose.withColumns({c: F.col(c).cast("double") for c in values}) if loose is not None else None
    shape = [*keys, F.col("_to").alias(target), *values]
    out = some.select(*shape)
    return Panel(out if loose is None else out.unionByName(loose.select(*shape)), panel.date, target)


def link_report(panel: Panel, table: LinkTable, source_keys: Sequence[str], linked: Panel | None = None) -> DataFrame:
    """One row: rows, unmatched rows, distinct keys, keys never matched, rows that collisions took away."""
    hit = table.resolve(panel.df, list(source_keys), panel.date, "_to")
    by_key = hit.groupBy(*source_keys).agg(F.count("*").alias("rows"), F.count("_to").alias("matched"))
    out = by_key.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("rows") - F.col("matched")), F.lit(0)).alias("n_unmatched"), F.count("*").alias("n_keys"), F.count_if(F.col("matched") == 0).alias("n_keys_unmatched"))
    return out if linked is None else out.withColumn("n_collapsed", F.col("n_rows") - F.col("n_unmatched") - F.lit(linked.df.count()))
