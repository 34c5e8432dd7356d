"""Incremental panels: files that arrive in a folder are cleaned and appended, late rows within a bound included.

Row-count windows can't run on a stream, so features stay a batch over the appended table; what streams is ingestion:
rows are de-duplicated by key within the watermark and written by date, so that a batch over recent dates prunes the
rest."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..panel import Panel


def stream_rows(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", **options) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def append_panel(rows: DataFrame, keys: Sequence[str], moment: str, late: str, target: str, checkpoint: str, step: Callable[[Panel], Panel] | None = None, **trigger) -> StreamingQuery:
    """Append each key's first row. ``moment`` is a timestamp column; rows later than ``late`` are left out; ``step`` cleans
    each micro-batch. Batches overwrite the files of their own number, so a replayed batch adds nothing twice."""
    fresh = rows.withWatermark(moment, late).dropDuplicatesWithinWatermark(list(keys))

    def write(batch: DataFrame, number: int) -> None:
        df = step(Panel(batch, moment, next(k for k in keys if k != moment))).df if step else batch
        df.withColumn("day", F.to_date(moment)).write.mode("overwrite").partitionBy("day").parquet(f"{target}/batch={number}")

    return fresh.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start()
