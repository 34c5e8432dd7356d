"""Runs that resume: a table of folds whose results are kept, and what an audit says about it.

A fold's rows are written to a fresh folder; a commit record, written last and as a whole, names it. A run that was stopped
left folds with a record, which are not computed again, and folds without, whose rows nobody reads. The run's configuration
is recorded before any fold; another one is refused."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.schedule import Bounds
from ..plans.stages import canonical, digest
from .factor_model import pooled_r_squared
from .sweep import SweepResult, run_sweep

NOTE = "fold int, data string, rows long, seconds double, config string, at double"


class RunError(RuntimeError):
    pass


class RunTable:
    """Below ``root``: the configuration, commit records and data of one run."""

    def __init__(self, spark: SparkSession, root: str, config: object):
        self.spark, self.root, self.config, self.began = spark, root.rstrip("/"), digest(config), time.time()
        known = {r["config"]: r["text"] for r in self._notes("config", "config string, text string").collect()}  # one, or a few of a race
        if any(c != self.config for c in known):
            raise RunError(f"{root} holds a run of another configuration: {sorted(known.values())[0]}")
        if not known:
            self._note("config", {"config": self.config, "text": canonical(config)})

    def _note(self, kind: str, note: dict) -> None:
        self.spark.createDataFrame([(json.dumps(note),)], "value string").coalesce(1).write.text(f"{self.root}/{kind}/{uuid.uuid4().hex}")

    def _notes(self, kind: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).json(f"{self.root}/{kind}/*")
        except AnalysisException:  # nothing there yet
            return self.spark.createDataFrame([], schema)

    def commits(self) -> DataFrame:
        """(fold, data, rows, seconds, config, at): every record there is."""
        return self._notes("commits", NOTE)

    def folds(self) -> DataFrame:
        """The latest record of each committed fold."""
        last = F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("at"), "data"))
        return self.commits().withColumn("_n", last).filter("_n = 1").drop("_n")

    def open(self, planned: Sequence[Bounds]) -> list[Bounds]:
        """Planned folds without a record."""
        plan = self.spark.createDataFrame([(f.fold,) for f in planned], "fold int")
        left = {r["fold"] for r in plan.join(self.commits(), "fold", "left_anti").collect()}
        return [f for f in planned if f.fold in left]

    def keep(self, rows: DataFrame, fold: int) -> DataFrame:
        """Write a fold's rows and then its record; a reader of what was written."""
        began, path = time.time(), f"{self.root}/data/{fold}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        kept = self.spark.read.schema(rows.schema).parquet(path)
        self._note("commits", {"fold": fold, "data": path, "rows": kept.count(), "seconds": time.time() - began, "config": self.config, "at": time.time()})
        return kept

    def periods(self) -> DataFrame:
        """The rows of all committed folds."""
        paths = [r["data"] for r in self.folds().select("data").collect()]  # a path a fold
        if not paths:
            raise RunError(f"{self.root} has no committed fold")
        return self.spark.read.parquet(*sorted(paths))

    def audit(self, planned: Sequence[Bounds]) -> DataFrame:
        """(fold, state, commits, rows_told, rows_found): ``whole``, ``open``, ``unplanned``, ``short`` (the data have other
        rows than the record says) or ``foreign`` (a record of another configuration)."""
        plan = self.spark.createDataFrame([(f.fold,) for f in planned], "fold int").withColumn("planned", F.lit(True))
        many = self.commits().groupBy("fold").agg(F.count("*").alias("commits"), F.count_if(F.col("config") != self.config).alias("foreign"))
        last = self.folds().select("fold", F.col("rows").alias("rows_told"))
        found = self.periods().groupBy("fold").agg(F.count("*").alias("rows_found")) if not last.isEmpty() else self.spark.createDataFrame([], "fold int, rows_found long")
        all_ = plan.join(many, "fold", "full").join(last, "fold", "left").join(found, "fold", "left")
        told, have = F.coalesce("rows_told", F.lit(0)), F.coalesce("rows_found", F.lit(0))
        state = F.when(F.col("planned").isNull(), "unplanned").when(F.col("commits").isNull(), "open").when(F.col("foreign") > 0, "foreign").when(told != have, "short").otherwise("whole")
        return all_.select("fold", state.alias("state"), F.coalesce("commits", F.lit(0)).alias("commits"), told.alias("rows_told"), have.alias("rows_found"))


def resume_sweep(table: RunTable, folds: Sequence[Bounds], body: Callable[[Bounds, int], DataFrame], on_fold_error: str = "raise", seed: int = 42, seed_mode: str = "fixed") -> SweepResult:
    """``run_sweep`` over the folds that are still open; the result is that of all folds."""
    left = table.open(folds)
    failed = None
    if left:
        done = run_sweep(table.spark, left, body, table.keep, on_fold_error, seed, seed_mode)
        failed = done.summary.filter("status = 'failed'").select("fold", "status", "seconds", "error")
    state = table.folds().select("fold", F.when(F.col("at") < F.lit(table.began), "kept").otherwise("completed").alias("status"), "seconds", F.lit(None).cast("string").alias("error"))
    state = state.unionByName(failed) if failed is not None else state
    periods = table.periods()
    return SweepResult(periods, state.join(pooled_r_squared(periods, ["fold"]), "fold", "left"))
