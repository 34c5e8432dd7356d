"""Residual panels and the windows that sequence models read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranges import numbered
from ..plans.schedule import Bounds, fold_table
from .factor_model import dot


def residual_panel(scored: DataFrame) -> DataFrame:
    """(date, entity, u) with u = r - beta . f of a frozen model."""
    return scored.select("date", "entity", (F.col("r") - dot(F.col("beta"), F.col("factor"))).alias("u"))


def with_positions(residuals: DataFrame) -> DataFrame:
    """``pos``: the place of the date among all dates of the panel."""
    dates = numbered(residuals.select("date").dropna().distinct(), "date", "pos")
    return residuals.join(dates, "date")


def window_ends(residuals: DataFrame, seq_len: int, stride: int = 1) -> DataFrame:
    """Rows (date, entity, u, pos) that end a run of ``seq_len`` periods without a gap in the panel's own dates."""
    rows = with_positions(residuals.filter("u is not null and not isnan(u)"))
    w = Window.partitionBy("entity").orderBy("pos")
    rows = rows.withColumn("_run", F.col("pos") - F.row_number().over(w))
    length = F.row_number().over(Window.partitionBy("entity", "_run").orderBy("pos"))
    return rows.withColumn("_len", length).filter((F.col("_len") >= seq_len) & (F.col("pos") % stride == 0)).drop("_run", "_len")


def windows_of(residuals: DataFrame, folds: Sequence[Bounds], seq_len: int, stride: int = 1, horizon: int | None = None) -> DataFrame:
    """(fold, part, entity, date, pos[, target]): a window belongs to the part that holds its last date; its look-back may
    reach over. With a horizon the target's date must be in the same part and have a value."""
    ends = window_ends(residuals, seq_len, stride)
    ranges = F.broadcast(fold_table(residuals.sparkSession, folds))  # three rows a fold
    out = ends.join(ranges, (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("stop")))
    if horizon is not None:
        ahead = with_positions(residuals).select("entity", (F.col("pos") - horizon).alias("pos"), F.col("u").alias("target")).filter("target is not null and not isnan(target)")
        out = out.filter(F.col("pos") + horizon < F.col("stop")).join(ahead, ["entity", "pos"])
    return out.select("fold", "part", "entity", "date", "pos", *(["target"] if horizon is not None else []))


def series_blocks(residuals: DataFrame, size: int = 256) -> DataFrame:
    """(entity, block, values, before): each entity's series once, in arrays of ``size`` periods with NULL for gaps, and
    beside each the array of the block before it."""
    rows = with_positions(residuals.filter("u is not null and not isnan(u)"))
    cells = rows.groupBy("entity", F.floor(F.col("pos") / size).alias("block")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("pos") % size).cast("int").alias("i"), "u"))).alias("at"))
    whole = cells.select("entity", "block", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.try_element_at("at", i)).alias("values"))
    w = Window.partitionBy("entity").orderBy("block")
    before = F.when(F.lag("block").over(w) == F.col("block") - 1, F.lag("values").over(w))
    return whole.withColumn("before", F.coalesce(before, F.array_repeat(F.lit(None).cast("double"), size)))


def gather(residuals: DataFrame, ends: DataFrame, seq_len: int) -> DataFrame:
    """``ends`` (of ``window_ends``, so without gaps) with ``seq``, the last ``seq_len`` residuals, oldest first. A window is
    its entity and its end; its values are cut from one or two neighbouring blocks of the series when they are asked for, so
    what is kept doesn't grow with ``seq_len``."""
    size = max(seq_len, 256)
    blocks = series_blocks(residuals, size)
    asked = ends.withColumn("block", F.floor(F.col("pos") / size))
    last = (size + F.col("pos") % size + 1).cast("int")
    return asked.join(blocks, ["entity", "block"]).withColumn("seq", F.slice(F.concat("before", "values"), last - seq_len + 1, F.lit(seq_len))).drop("block", "before", "values")


def per_date_loss(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, date, loss, n): squared errors of rows (by, date, score, target) summed by date, missing targets left out."""
    some = scored.filter("score is not null and target is not null")
    return some.groupBy(*by, "date").agg(F.sum(F.pow(F.col("score") - F.col("target"), 2)).alias("loss"), F.count("*").alias("n"))


def pooled_loss(dates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A ratio of sums over dates and not a mean of daily means."""
    return dates.groupBy(*by).agg((F.sum("loss") / F.sum("n")).alias("loss"), F.count("*").alias("dates"))
