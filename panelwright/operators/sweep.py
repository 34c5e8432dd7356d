"""A sweep: one body run for each fold, failures recorded or raised, results pooled from sums."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.schedule import Bounds
from .factor_model import pooled_r_squared

log = logging.getLogger(__name__)


class SweepError(RuntimeError):
    pass


@dataclass(frozen=True)
class SweepResult:
    """``periods``: period errors (fold, date, sse_total, sst_total, sse_pred, sst_pred) of completed folds; ``summary``: a
    row a fold with its status, seconds, error and own R2."""

    periods: DataFrame
    summary: DataFrame

    def pooled(self) -> DataFrame:
        return pooled_r_squared(self.periods)


def fold_seed(seed: int, fold: int, mode: str = "fixed") -> int:
    if mode not in ("fixed", "per_fold"):
        raise SweepError(f"seed_mode must be fixed or per_fold, not {mode!r}")
    return seed + fold if mode == "per_fold" else seed


def run_sweep(spark: SparkSession, folds: Sequence[Bounds], body: Callable[[Bounds, int], DataFrame], keep: Callable[[DataFrame, int], DataFrame], on_fold_error: str = "raise", seed: int = 42, seed_mode: str = "fixed") -> SweepResult:
    """``body`` gives a fold's period errors; ``keep`` writes them and returns a reader, so a later failure loses nothing."""
    if on_fold_error not in ("raise", "skip"):
        raise SweepError(f"on_fold_error must be raise or skip, not {on_fold_error!r}")
    done, status = [], []
    for f in folds:
        began = time.time()
        try:
            rows = keep(body(f, fold_seed(seed, f.fold, seed_mode)).withColumn("fold", F.lit(f.fold)), f.fold)
            done.append(rows)
            status.append((f.fold, "completed", time.time() - began, None))
        except Exception as e:  # noqa: BLE001  recorded below or raised
            if on_fold_error == "raise":
                raise
            log.warning("fold %d failed: %s", f.fold, e)
            status.append((f.fold, "failed", time.time() - began, str(e)[:500]))
    if not done:
        raise SweepError("every fold failed")
    periods = done[0]
    for d in done[1:]:
        periods = periods.unionByName(d)
    table = spark.createDataFrame(status, "fold int, status string, seconds double, error string")
    return SweepResult(periods, table.join(pooled_r_squared(periods, ["fold"]), "fold", "left"))
