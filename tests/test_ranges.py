"""Order across partitions against windows and plain loops, in many ranges and in few."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.functions import ranges
from panelwright.functions.ewm import Ewm, add_along, in_ranges, scan_ewms
from panelwright.functions.windows import Frames
from panelwright.operators.alignment import broadcast_time
from panelwright.panel import Panel
from panelwright.plans.schedule import positions

PARTS = (1, 20)


@pytest.fixture(scope="module")
def sections(spark):
    """A huge date of many ties (a third of the rows is 0), small dates, a date without values, null dates."""
    rng = random.Random(1)
    value = lambda: None if rng.random() < 0.1 else rng.choice([0.0, -0.0, rng.randint(-3, 3) / 2, rng.random()])
    rows = [(d, i, 0.5 if d == 3 else value()) for i, d in enumerate([1] * 900 + [2] * 7 + [3] + [None] * 5)] + [(4, 2000 + i, None) for i in range(3)]
    return spark.createDataFrame(rows, "date int, entity int, x double").repartition(6)


@pytest.mark.parametrize("method", ranges.METHODS)
@pytest.mark.parametrize("parts", (2, 20))
def test_ranks_match_windows(sections, method, parts):
    frames = Frames("date", "entity")
    for ascending, by in ((True, "raw"), (False, "pct"), (parts == 2, "signed")):
        got = ranges.section_rank(sections, "date", "entity", "x", "r", method, ascending, by, parts)
        want = sections.withColumn("r", F.when(F.col("date").isNotNull(), frames.rank(F.col("x"), method, ascending, by)))
        key = lambda df: sorted((r.entity, r.date, r.x, r.r) for r in df.collect())
        assert str(key(got)) == str(key(want)), (ascending, by)


@pytest.mark.parametrize("parts", PARTS)
def test_quantiles_match_numpy(sections, parts):
    rows = [r for r in sections.collect() if r.x is not None]
    shares = {"a": 0.0, "b": 0.01, "c": 0.5, "d": 0.977, "e": 1.0}
    got = {r.date: r for r in ranges.section_quantiles(sections, ["date"], "x", shares, parts).collect()}
    assert set(got) == {1, 2, 3}
    for d, r in got.items():
        x = [v.x for v in rows if v.date == d]
        assert [r[n] for n in shares] == pytest.approx([np.quantile(x, s) for s in shares.values()])
    whole = [v.x for v in rows]
    low, high = np.quantile(whole, [0.05, 0.8])
    for r in ranges.clip_quantiles(sections, "x", "y", 0.05, 0.8, parts).collect():
        assert r.y == (None if r.x is None else pytest.approx(min(max(r.x, low), high)))
    held = ranges.section_winsorize(sections, "date", "x", "y", 0.1, 0.9, parts).collect()
    assert len(held) == sections.count()
    for r in held:
        if r.x is not None and r.date is not None:
            own = [v.x for v in rows if v.date == r.date]
            assert r.y == pytest.approx(np.clip(r.x, *np.quantile(own, [0.1, 0.9])))


def test_no_range_holds_a_large_share_of_a_date(sections):
    cells = ranges.by_ranges(sections.filter("x is not null and date = 1").groupBy("date", "x").count(), ["date", "x"], 20)
    sizes = [r["count"] for r in cells.groupBy(ranges.PART).count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 4 * sum(sizes) / len(sizes)


def test_empty_tables(spark, sections):
    none = sections.limit(0)
    assert ranges.section_rank(none, "date", "entity", "x", "r").collect() == []
    assert ranges.clip_quantiles(none, "x", "y", 0.1, 0.9).collect() == []
    assert ranges.numbered(none.select("entity"), "entity", "n").collect() == []


@pytest.mark.parametrize("parts", PARTS)
def test_numbers_and_carried_values(spark, parts):
    rng = random.Random(2)
    rows = [(t, rng.random() if rng.random() < 0.05 else None) for t in rng.sample(range(10_000), 700)]
    df = spark.createDataFrame(rows, "t int, v double").repartition(3)
    assert {r.t: r.n for r in ranges.numbered(df, "t", "n", parts).collect()} == {t: i for i, (t, _) in enumerate(sorted(rows))}
    last, want = None, {}
    for t, v in sorted(rows):
        last = want[t] = v if v is not None else last
    assert {r.t: r.v for r in ranges.carried_forward(df, ["t"], "v", parts).collect()} == want


def test_broadcast_time_as_of_intraday(spark):
    rng = random.Random(3)
    moment = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randint(0, 50_000))
    spine = [(moment(), e) for e in "ab" for _ in range(150)] + [(None, "a")]
    spine = list(dict.fromkeys(spine))
    source = {moment(): None if rng.random() < 0.2 else rng.random() for _ in range(60)}
    left = Panel(spark.createDataFrame(spine, "date timestamp_ntz, entity string"))
    right = Panel(spark.createDataFrame(list(source.items()), "date timestamp_ntz, v double"), entity=None)
    for tolerance, seconds in ((None, 10**9), ("20MIN", 1200)):
        got = broadcast_time(left, right, {"v": "w"}, as_of=True, tolerance=tolerance).collect()
        assert len(got) == len(spine)
        for r in got:
            before = [t for t in source if r.date is not None and t <= r.date]
            hit = max(before, default=None)
            fresh = hit is not None and (r.date - hit).total_seconds() <= seconds
            assert r.w == (source[hit] if fresh else None)
    assert [r.pos for r in positions(left).orderBy("date").collect()] == list(range(len({d for d, _ in spine if d})))


@pytest.mark.parametrize("parts", PARTS)
def test_scanned_weights_match_whole_entities(spark, parts):
    rng = np.random.default_rng(3)
    entity = np.repeat([0, 1, 2, 3, 9], [1500, 5, 900, 1, 300])
    x = np.where(rng.random(len(entity)) < 0.3, np.nan, rng.normal(size=len(entity)))
    x[:400] = np.nan  # a long lead without values
    rows = [(int(e) if e < 9 else None, i, None if np.isnan(v) else float(v), "k") for i, (e, v) in enumerate(zip(entity, x, strict=True))]
    df = spark.createDataFrame(rows, "e int, k int, x double, note string").repartition(5)
    specs = {f"{how}{least}{adjust}": Ewm("x", 0.1, adjust, least, how) for how in ("mean", "var", "std") for least in (1, 4) for adjust in (True, False)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got, want = (f.toPandas().sort_values("k") for f in (scan_ewms(df, specs, "k", "e", parts=parts), add_along(df, specs, "k", "e")))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for c in specs:
        assert got[c].to_numpy() == pytest.approx(want[c].to_numpy(), rel=1e-12, abs=1e-12, nan_ok=True), c
    assert got["note"].tolist() == want["note"].tolist()
    assert scan_ewms(df.limit(0), specs, "k", "e").collect() == []


def test_one_entity_lies_in_many_tasks(spark):
    df = spark.range(20_000).select(F.lit(1).alias("e"), F.col("id").alias("k"), F.rand(1).alias("x"))
    sizes = [r["count"] for r in in_ranges(df, "e", "k", parts=8).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 20_000 / 8
