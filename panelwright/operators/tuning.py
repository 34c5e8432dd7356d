"""Statistics over fold scores: spread of a sweep, noise floor of seeds, paired comparison of configurations."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def t_quantile(df: int, p: float = 0.975) -> float:
    """Student-t quantile by bisection on the regularised incomplete beta function's integral."""

    def cdf(t: float, n: int = 4000) -> float:
        c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        f = lambda x: c * (1 + x * x / df) ** (-(df + 1) / 2)
        h = t / n
        return 0.5 + h / 3 * (f(0) + f(t) + 4 * sum(f((2 * i + 1) * h) for i in range(n // 2)) + 2 * sum(f(2 * i * h) for i in range(1, n // 2)))

    lo, hi = 0.0, 1.0
    while cdf(hi) < p:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def aggregate_spread(folds: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, mean, median, min, max, std, sem, iqr) over completed folds; failed ones don't count as 0."""
    done = folds.filter("status = 'completed'")
    long = done.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns)))).filter("x is not null and not isnan(x)")
    x = F.col("x")
    many = F.count(x) > 1
    return long.groupBy("column").agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.percentile(x, 0.5).alias("median"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.stddev_samp(x).alias("std"), (F.stddev_samp(x) / F.sqrt(F.count(x))).alias("sem"), F.when(many, F.percentile(x, 0.75) - F.percentile(x, 0.25)).alias("iqr"),
    )


def aggregate_convergence(folds: DataFrame) -> DataFrame:
    """Of rows (status, stopped_early, hit_cap, seconds, epochs)."""
    done = F.col("status") == "completed"
    return folds.agg(F.count_if(done).alias("completed"), F.count_if(~done).alias("failed"), F.count_if(done & F.col("stopped_early")).alias("stopped_early"), F.count_if(done & F.col("hit_cap")).alias("hit_cap"), F.sum(F.when(done, F.col("seconds"))).alias("seconds"), F.percentile(F.when(done, F.col("epochs")), 0.5).alias("median_epochs"))


def noise_floor(runs: DataFrame) -> DataFrame:
    """Of one configuration's rows (run, score): spread over seeds and what a difference has to clear."""
    seen = runs.agg(F.count("score").alias("replicates"), F.avg("score").alias("pooled_mean"), F.stddev_samp("score").alias("sigma_seed"), (F.max("score") - F.min("score")).alias("range_band"))
    n = int(seen.first()["replicates"])
    if n < 2:
        raise ValueError("a noise floor needs at least two replicates of one configuration")
    q = t_quantile(n - 1)
    return seen.withColumns({"screen_band_1_seed": q * F.col("sigma_seed") * math.sqrt(1 / n + 1), "confirm_band_3_seeds": q * F.col("sigma_seed") * math.sqrt(1 / n + 1 / 3), "t_quantile": F.lit(q), "degrees_of_freedom": F.lit(n - 1)})


def compare(incumbent: DataFrame, candidate: DataFrame, window_ratio: float) -> DataFrame:
    """Of rows (run, fold, score): seeds averaged within a fold, folds paired, the error of their mean difference corrected
    for overlapping training windows (Nadeau and Bengio, 2003)."""
    side = lambda df, name: df.groupBy("fold").agg(F.avg("score").alias(name))
    both = side(incumbent, "a").join(side(candidate, "b"), "fold").withColumn("d", F.col("b") - F.col("a"))
    d = F.col("d")
    out = both.agg(F.count(d).alias("folds_compared"), F.avg(d).alias("delta"), F.stddev_samp(d).alias("delta_sd"), F.count_if(d > 0).alias("fold_wins"), F.avg((d > 0).cast("double")).alias("fold_win_rate"))
    k = F.col("folds_compared")
    out = out.withColumns({"se_naive": F.col("delta_sd") / F.sqrt(k), "se_corrected": F.col("delta_sd") * F.sqrt(F.try_divide(F.lit(1.0), k) + window_ratio)})
    return out.withColumn("t_corrected", F.try_divide("delta", F.nullif("se_corrected", F.lit(0.0))))


def failed_gates(folds: DataFrame, expected_folds: int, column: str) -> DataFrame:
    """(gate, failed): why a set of runs (run, fold, status, ``column``) may not be compared."""
    by = folds.groupBy("run").agg(F.count_if(F.col("status") != "completed").alias("broken"), F.count_distinct("fold").alias("folds"), F.count_if(F.col(column).isNull() | F.isnan(column)).alias("holes"))
    seen = by.agg(F.sum("broken").alias("failed folds"), F.count_if(F.col("folds") != expected_folds).alias("runs with other fold counts"), F.sum("holes").alias("missing scores"))
    return seen.select(F.inline(F.array(*(F.struct(F.lit(c).alias("gate"), F.col(c).alias("failed")) for c in seen.columns)))).filter("failed > 0")
