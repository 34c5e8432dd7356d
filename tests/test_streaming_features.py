"""Features on a stream give what the batch gives, however rows are cut into micro-batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelwright.functions.ewm import Ewm
from panelwright.panel import Panel, PanelError
from panelwright.streaming.append import stream_rows
from panelwright.streaming.features import REDUCERS, Lag, Roll, batch_features, settle_features

SPECS = {f"roll_{how}": Roll("x", 5, how, 3, quantile=0.3 if how == "quantile" else None) for how in REDUCERS}
SPECS |= {"var0": Roll("y", 4, "var", 1, ddof=0), "ema": Ewm("x", 0.3, False, 2), "ema_adjust": Ewm("y", 0.2, True, 1), "ewm_std": Ewm("x", 0.3, True, 3, "std")}
SPECS |= {f"lag_{how}": Lag("x", 2, how) for how in ("value", "difference", "simple", "log")}
SCHEMA = "date timestamp, entity string, x double, y double"
START = dt.datetime(2024, 1, 1)


def panel_rows(seed, days=24):
    rng = random.Random(seed)
    value = lambda: None if rng.random() < 0.2 else rng.choice([0.0, -1.5, rng.uniform(1, 9), float("inf")])
    return [(START + dt.timedelta(days=d), e, value(), value()) for e in "abc" for d in range(days) if rng.random() < 0.9]


@pytest.fixture()
def few_tasks(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def arrive(spark, folder, rows, number):
    """One file, and so one micro-batch (the source reads one file a batch, oldest first)."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in/{number:03d}")


def run(spark, folder, late=None):
    rows = stream_rows(spark, f"{folder}/in/*", spark.createDataFrame([], SCHEMA).schema, maxFilesPerTrigger=1)
    query = settle_features(rows, SPECS, f"{folder}/out", f"{folder}/check", late=late)
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def same(spark, got, rows):
    want = batch_features(Panel(spark.createDataFrame(rows, SCHEMA)), SPECS).collect()
    got = {(r.entity, r.date): r for r in got.collect()}
    assert len(got) == len(want)
    for w in want:
        for c in SPECS:
            assert got[w.entity, w.date][c] == (pytest.approx(w[c], rel=1e-9, abs=1e-9) if w[c] is not None else None), (w.entity, w.date, c)


def test_in_order_with_a_restart(spark, tmp_path, few_tasks):
    rows = sorted(panel_rows(1), key=lambda r: r[0])
    cuts = [0, 1, 20, 21, 45, len(rows)]
    cuts = [next((i for i in range(c, len(rows)) if i == 0 or rows[i][0] != rows[i - 1][0]), len(rows)) for c in cuts]
    for k in range(3):
        arrive(spark, tmp_path, random.Random(k).sample(rows[cuts[k] : cuts[k + 1]], cuts[k + 1] - cuts[k]), k)
    run(spark, tmp_path)
    for k in range(3, 5):
        arrive(spark, tmp_path, rows[cuts[k] : cuts[k + 1]], k)
    same(spark, run(spark, tmp_path), rows)
    # late rows and repeats change nothing
    arrive(spark, tmp_path, [(START - dt.timedelta(days=1), "a", 5.0, 5.0), rows[0], (None, "a", 1.0, 1.0), (START, None, 1.0, 1.0)], 9)
    same(spark, run(spark, tmp_path), rows)


def test_any_order_within_the_watermark(spark, tmp_path, few_tasks):
    rows = panel_rows(2)
    rng = random.Random(5)
    # each row arrives at most three days after later ones
    shuffled = sorted(rows, key=lambda r: r[0] + dt.timedelta(days=rng.uniform(0, 3)))
    size = len(rows) // 3
    for k in range(3):
        arrive(spark, tmp_path, shuffled[k * size : (k + 1) * size if k < 2 else None], k)
    out = run(spark, tmp_path, late="4 days")
    end = max(r[0] for r in rows) - dt.timedelta(days=4)
    same(spark, out, [r for r in rows if r[0] <= end])  # later rows wait
    arrive(spark, tmp_path, [(START + dt.timedelta(days=400), "z", 1.0, 1.0)], 5)
    arrive(spark, tmp_path, [(START + dt.timedelta(days=401), "z", 1.0, 1.0)], 6)
    assert run(spark, tmp_path, late="4 days").filter(F.col("entity") != "z").count() == len(rows)


def test_specs_are_checked():
    for make in (lambda: Roll("x", 0, "mean", 1), lambda: Roll("x", 3, "mode", 1), lambda: Roll("x", 3, "quantile", 1), lambda: Lag("x", 0), lambda: Lag("x", 1, "cube")):
        with pytest.raises(PanelError):
            make()


def test_one_read_and_one_write_of_state_a_bucket():
    import numpy as np
    import pandas as pd
    from pyspark.sql import types as T

    from panelwright.functions.recursion import along
    from panelwright.streaming.features import BucketFeatures

    calls = []

    class Kept:
        row = None

        def exists(self):
            return self.row is not None

        def get(self):
            calls.append("get")
            return self.row

        def update(self, row):
            calls.append("update")
            self.row = row

    class Handle:
        getValueState = staticmethod(lambda name, schema: Kept())  # noqa: N815

    class Timers:
        getCurrentWatermarkInMs = staticmethod(lambda: 0)  # noqa: N815

    specs = {"mean": Roll("x", 3, "mean", 1), "lag": Lag("x", 2), "ema": Ewm("x", 0.3, False, 1)}
    worker = BucketFeatures("date", T.StructField("entity", T.LongType()), specs, False)
    worker.init(Handle())
    rng = np.random.default_rng(3)
    # entity e has e % 7 rows in each micro-batch, so the series differ in length
    parts = [pd.DataFrame([(e, pd.Timestamp(2024, 1, 1) + pd.Timedelta(days=10 * k + i), rng.normal() if rng.random() < 0.8 else None) for e in range(500) for i in range(e % 7)], columns=["entity", "date", "x"]) for k in range(3)]
    out = pd.concat([o for p in parts for o in worker.handleInputRows((0,), iter([p.sample(frac=1, random_state=1)]), Timers)])
    assert calls.count("get") <= 3 and calls.count("update") == 3  # not once an entity
    want = pd.concat(parts).sort_values(["entity", "date"]).astype({"x": float})
    by = want.groupby("entity")["x"]
    got = out.sort_values(["entity", "date"])
    assert got["entity"].tolist() == want["entity"].tolist()
    np.testing.assert_allclose(got["mean"], by.rolling(3, min_periods=1).mean(), atol=1e-12)
    np.testing.assert_allclose(got["lag"], by.shift(2))
    np.testing.assert_allclose(got["ema"], along(want["x"].to_numpy(), want["entity"].to_numpy(), 0.3, False, "mean", 1)[0], atol=1e-12)
