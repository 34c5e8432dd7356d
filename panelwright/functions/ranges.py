"""Order across partitions: running sums, ranks, quantiles and carried values over one long order, in three steps.

Rows are dealt by ranges of the order and written once with their range's number; windows run inside a range; and what a
range adds or hands on is a few numbers, put in order over as many rows as there are ranges. So neither a date with very
many names nor a source with very many stamps meets in one task. Everything is columns; nothing is collected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.shared import settled
from .nulls import nmax, nmin

PART = "_part"
METHODS = ("average", "min", "max", "first", "dense")


def by_ranges(df: DataFrame, order: Sequence[Column | str], parts: int | None = None) -> DataFrame:
    """``df`` dealt by ranges of ``order`` and settled, with the range's number in ``_part``; ranges ascend with the order."""
    dealt = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    return settled(dealt.withColumn(PART, F.spark_partition_id()), "ranges")


def with_offsets(cells: DataFrame, groups: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """``cells`` with, for each sum, its total over the earlier ranges of the row's group (``<name>_before``) and over the
    whole group (``<name>_all``)."""
    totals = cells.groupBy(PART, *groups).agg(*(c.alias(n) for n, c in sums.items()))  # a row a range and group in it
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    before = whole.orderBy(PART)
    kept = [x for n in sums for x in ((F.sum(n).over(before) - F.col(n)).alias(f"{n}_before"), F.sum(n).over(whole).alias(f"{n}_all"))]
    return cells.join(totals.select(PART, *groups, *kept), [PART, *groups])


def value_places(df: DataFrame, sections: Sequence[str], value: str, parts: int | None = None) -> DataFrame:
    """(sections, value, n, below, level, rows_all, levels_all): for each distinct value of each section the rows that have
    it, the rows of smaller values, its number among the values (from 1), and the section's rows and values. Ties are counted
    before anything is dealt, so a value that a third of all rows have is one row here. Missing values take no part, nor do
    rows with a missing section."""
    counted = df.dropna(subset=[*sections, value]).groupBy(*sections, value).agg(F.count("*").alias("n"))
    cells = with_offsets(by_ranges(counted, [*sections, value], parts), sections, {"rows": F.sum("n"), "levels": F.count("*")})
    inside = Window.partitionBy(PART, *sections).orderBy(value)
    below = F.col("rows_before") + F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    level = F.col("levels_before") + F.row_number().over(inside)
    return cells.select(*sections, value, "n", below.alias("below"), level.alias("level"), "rows_all", "levels_all")


def _scaled(rank: Column, rows: Column, by: str, most: Column) -> Column:
    if by == "pct":
        rank = rank / most
    elif by == "signed":
        rank = F.when(rows > 1, 2 * (rank - 1) / (rows - 1) - 1).otherwise(F.lit(0.0))
    return rank.cast("double")


def section_rank(df: DataFrame, date: str, entity: str, value: str, output: str, method: str = "average", ascending: bool = True, by: str = "raw", parts: int | None = None) -> DataFrame:
    """``df`` with the rank of ``value`` among its date's rows, as ``Frames.rank`` has it, however many rows a date has."""
    if method not in METHODS or by not in ("raw", "pct", "signed"):
        raise ValueError(f"no such rank: {method}, {by}")
    if method == "first":
        order = F.col(value) if ascending else F.col(value).desc()
        some = df.dropna(subset=[date, value])
        cells = with_offsets(by_ranges(some, [date, order, entity], parts), [date], {"rows": F.count("*")})
        place = F.col("rows_before") + F.row_number().over(Window.partitionBy(PART, date).orderBy(order, entity))
        ranked = cells.withColumn(output, _scaled(place, F.col("rows_all"), by, F.col("rows_all"))).select(*df.columns, output)
        none = df.filter(F.col(date).isNull() | F.col(value).isNull()).withColumn(output, F.lit(None).cast("double"))
        return ranked.unionByName(none)
    at, rows = value_places(df, [date], value, parts), F.col("rows_all")
    below = F.col("below") if ascending else rows - F.col("below") - F.col("n")
    level = F.col("level") if ascending else F.col("levels_all") - F.col("level") + 1
    rank = {"average": below + (F.col("n") + 1) / 2, "min": below + 1, "max": below + F.col("n"), "dense": level}[method]
    known = at.select(F.col(date).alias("_d"), F.col(value).alias("_v"), _scaled(rank, rows, by, F.col("levels_all") if method == "dense" else rows).alias(output))
    return df.join(known, (F.col(date) == F.col("_d")) & (F.col(value) == F.col("_v")), "left").drop("_d", "_v")


def section_quantiles(df: DataFrame, sections: Sequence[str], value: str, shares: dict[str, float], parts: int | None = None) -> DataFrame:
    """(sections, a column a share): exact linearly interpolated quantiles, picked from the places of the values."""
    at = value_places(df, sections, value, parts)
    picks = []
    for name, share in shares.items():
        place = (F.col("rows_all") - 1) * F.lit(float(share))
        for end, k in (("low", F.floor(place)), ("high", F.ceil(place))):
            picks.append(F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("n")), F.col(value))).alias(f"{name}_{end}"))
        picks.append(F.max(place - F.floor(place)).alias(f"{name}_part"))
    out = at.groupBy(*sections).agg(*picks)
    part = lambda n: F.col(f"{n}_part")
    return out.select(*sections, *(F.when(part(n) == 0, F.col(f"{n}_low")).otherwise((1 - part(n)) * F.col(f"{n}_low") + part(n) * F.col(f"{n}_high")).alias(n) for n in shares))


def section_winsorize(df: DataFrame, date: str, value: str, output: str, lower: float, upper: float, parts: int | None = None) -> DataFrame:
    """``value`` held between two quantiles of its date."""
    cuts = section_quantiles(df, [date], value, {"_low": lower, "_high": upper}, parts).withColumnRenamed(date, "_d")
    held = nmin(nmax(F.col(value), F.col("_low")), F.col("_high"))
    return df.join(cuts, F.col(date) == F.col("_d"), "left").withColumn(output, held).select(*df.columns, output)


def clip_quantiles(df: DataFrame, value: str, output: str, lower: float, upper: float, parts: int | None = None) -> DataFrame:
    """``value`` held between two quantiles of the whole column."""
    cuts = section_quantiles(df, [], value, {"_low": lower, "_high": upper}, parts).withColumn("_one", F.lit(1))  # one row
    out = df.withColumn("_one", F.lit(1)).join(F.broadcast(cuts), "_one", "left")
    return out.withColumn(output, nmin(nmax(F.col(value), F.col("_low")), F.col("_high"))).select(*df.columns, output)


def section_bucket(df: DataFrame, date: str, entity: str, value: str, output: str, n_buckets: int, parts: int | None = None) -> DataFrame:
    """The bucket 1 to ``n_buckets`` of the average percentage rank in the date."""
    ranked = section_rank(df, date, entity, value, output, by="pct", parts=parts)
    return ranked.withColumn(output, nmin(nmax(F.ceil(F.col(output) * n_buckets).cast("double"), F.lit(1.0)), F.lit(float(n_buckets))))


def numbered(df: DataFrame, order: str, output: str, parts: int | None = None) -> DataFrame:
    """``df`` with each row's number from 0 in the order of the (distinct) column ``order``."""
    cells = with_offsets(by_ranges(df, [order], parts), [], {"rows": F.count("*")})
    place = F.col("rows_before") + F.row_number().over(Window.partitionBy(PART).orderBy(order)) - 1
    return cells.withColumn(output, place.cast("long")).select(*df.columns, output)


def carried_forward(rows: DataFrame, order: Sequence[str], value: str, parts: int | None = None) -> DataFrame:
    """``rows`` with ``value`` of the latest row that has one, itself included, along one order of all rows."""
    cells = by_ranges(rows, order, parts)
    inside = Window.partitionBy(PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = cells.groupBy(PART).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_last"))
    before = Window.partitionBy(F.lit(0)).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    reached = last.select(PART, F.last("_last", ignorenulls=True).over(before).alias("_reached"))
    found = F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("_reached"))
    return cells.join(reached, PART).withColumn(value, found).select(*rows.columns)
