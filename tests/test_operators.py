"""Cleaning, alignment, linking, sources, schedules, stages and the model on small cases worked out apart."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators.alignment import AlignmentError, Join, merge_panels, microseconds
from panelwright.operators.cleaning import CleaningError, clean
from panelwright.operators.factor_model import ModelError, Network, Training, column_sets, cross_sections, fit_folds, managed_portfolios
from panelwright.operators.linking import LinkError, LinkTable, Normalization, normalized, relink
from panelwright.operators.residuals import gather, window_ends
from panelwright.operators.tuning import t_quantile
from panelwright.panel import Grain, Panel, PanelError, PanelSet
from panelwright.plans.config import check
from panelwright.plans.schedule import Bounds, Split, SplitError, WalkForward
from panelwright.plans.stages import Stage, StageCache, resolve, stage_key
from panelwright.sources.filters import RowSelection, apply_filters
from panelwright.sources.tables import CsvOptions, MissingColumns, Schema, java_pattern, read_csv

DAY = lambda k: dt.datetime(2020, 1, 1) + dt.timedelta(days=k)


def panel(spark, rows, columns="x double"):
    return Panel(spark.createDataFrame([(DAY(r[0]), *r[1:]) for r in rows], f"date timestamp_ntz, entity long, {columns}"))


def rows_of(p, *cols):
    return sorted((tuple(r) for r in p.df.select(*cols).collect()), key=repr)


def test_panel_grains_and_names(spark):
    p = panel(spark, [(0, 1, 1.0)])
    assert p.grain is Grain.PANEL and p.values == ["x"]
    assert Panel(p.df, date=None).grain is Grain.CROSS_SECTION and Panel(p.df, None, None).grain is Grain.TABLE
    with pytest.raises(PanelError):
        Panel(p.df, "when")
    with pytest.raises(KeyError):
        PanelSet(a=p)["b"]
    with pytest.raises(PanelError):
        PanelSet(a=p)["b"]


def test_cleaning_steps(spark):
    p = panel(spark, [(0, 1, 1.0), (0, 1, 3.0), (0, 1, None), (1, 1, None), (2, 1, None), (3, 1, 4.0)])
    d = clean(p, [("deduplicate", {})])
    assert rows_of(d, "entity", "x") == sorted([(1, 2.0), (1, None), (1, None), (1, 4.0)], key=repr)
    filled = clean(d, [("forward_fill", {"limit": 1})])
    assert [r.x for r in filled.df.orderBy("date").collect()] == [2.0, 2.0, None, 4.0]
    assert clean(d, [("nan_entity_filter", {"threshold": 0.5})]).df.count() == 4
    assert clean(d, [("nan_entity_filter", {"threshold": 0.49})]).df.count() == 0
    f = panel(spark, [(0, 1, 2.0), (1, 1, 3.0), (2, 1, -1.0), (3, 1, 5.0)])
    assert [r.c for r in clean(f, [("cumulative_factor", {"factor_column": "x", "output_column": "c"})]).df.orderBy("date").collect()] == [15.0, 5.0, 5.0, 1.0]
    with pytest.raises(CleaningError):
        clean(Panel(p.df, None, None), [("deduplicate", {})])
    with pytest.raises(CleaningError):
        clean(p, [("nope", {})])
    with pytest.raises(CleaningError):
        clean(p, [("forward_fill", {"limits": 1})])


def test_rules_see_earlier_nulls(spark):
    p = panel(spark, [(0, 1, 5.0, 1.0), (1, 1, 0.0, 1.0)], "a double, b double")
    out = clean(p, [("consistency", {"rules": [{"column": "a", "op": "gt", "bound": 1.0}, {"column": "a", "op": "gt", "bound": 3.0, "target": "b"}]})])
    assert [(r.a, r.b) for r in out.df.orderBy("date").collect()] == [(5.0, 1.0), (None, 1.0)]


def test_top_n_and_row_selection(spark):
    p = panel(spark, [(0, 1, 5.0), (0, 2, -9.0), (0, 3, None), (0, 4, 5.0), (1, 1, 1.0)])
    assert rows_of(apply_filters(p, [("top_n_market_cap", {"n": 2, "market_cap_column": "x"})]), "entity", "x") == sorted([(2, -9.0), (1, 5.0), (1, 1.0)], key=repr)
    assert RowSelection("2020-01-02", None, ("1",)).apply(p).df.count() == 1
    for bad in ("x", 10.5):
        with pytest.raises(PanelError):
            RowSelection(entities=(bad,)).apply(p)


@pytest.mark.parametrize("allow_exact", [True, False])
@pytest.mark.parametrize("lag,tolerance", [(0, None), (2, 5)])
def test_as_of_matches_a_loop(spark, allow_exact, lag, tolerance):
    rng = random.Random(lag)
    spine = sorted({(rng.randint(0, 40), rng.randint(1, 4)) for _ in range(80)})
    source = sorted({(rng.randint(0, 40), rng.randint(1, 5)): None for _ in range(60)})
    source = [(d, e, float(i), None if rng.random() < 0.2 else DAY(d + rng.randint(0, 6))) for i, (d, e) in enumerate(source)]
    src = panel(spark, source, "v double, known timestamp_ntz")
    params = {"availability_column": "known", "allow_exact": allow_exact} | ({"lag": f"{lag}D"} if lag else {}) | ({"tolerance": f"{tolerance}D"} if tolerance else {})
    got = merge_panels(PanelSet(s=panel(spark, [(d, e, 0.0) for d, e in spine]), f=src), "s", [Join("f", "asof_entity", params, ["v"])], [])
    have = {(r.date, r.entity): r.v for r in got.df.collect()}
    assert len(have) == len(spine)
    for d, e in spine:
        best = None
        for sd, se, v, known in source:
            if se == e and known is not None:
                at = known + dt.timedelta(days=lag)
                if (at <= DAY(d) if allow_exact else at < DAY(d)) and (best is None or (at, DAY(sd)) >= best[:2]):
                    best = (at, DAY(sd), v)
        if best and tolerance and DAY(d) - best[0] > dt.timedelta(days=tolerance):
            best = None
        assert have[DAY(d), e] == (best and best[2]), (d, e)


def test_alignment_guards(spark):
    spine = panel(spark, [(0, 1, 1.0), (1, 2, 2.0), (1, None, 3.0)])
    twice = panel(spark, [(0, 1, 1.0), (0, 1, 2.0)])
    text = Panel(spark.createDataFrame([("1", "a")], "entity string, s string"), date=None)
    one = Panel(spark.createDataFrame([(1, "a"), (None, "b")], "entity long, s string"), date=None)
    with pytest.raises(PanelError, match="repeat"):
        merge_panels(PanelSet(s=spine, t=twice), "s", [Join("t", "exact", prefix="t_")])
    with pytest.raises(PanelError, match="can't be matched"):
        merge_panels(PanelSet(s=spine, t=text), "s", [Join("t", "broadcast_entity")])
    with pytest.raises(AlignmentError, match="collide"):
        merge_panels(PanelSet(s=spine, t=spine), "s", [Join("t", "exact")])
    with pytest.raises(AlignmentError, match="takes"):
        merge_panels(PanelSet(s=spine, t=one), "s", [Join("t", "exact")])
    with pytest.raises(AlignmentError, match="covers"):
        merge_panels(PanelSet(s=spine, t=one), "s", [Join("t", "broadcast_entity", min_coverage=0.5)])
    out = merge_panels(PanelSet(s=spine, t=one), "s", [Join("t", "broadcast_entity", min_coverage=0.3, prefix="p_", rename={"p_s": "sector"})])
    assert rows_of(out, "entity", "sector") == sorted([(1, "a"), (2, None), (None, None)], key=repr)
    assert microseconds("1D 12h") == 36 * 3600 * 10**6
    with pytest.raises(AlignmentError):
        microseconds("soon")


def test_key_normalisation(spark):
    df = spark.createDataFrame([(" ab ",), ("",), ("  ",), ("abcdefg",), (None,)], "k string")
    assert [r.k for r in normalized(df, {"k": Normalization(upper=True, zfill=5)}).collect()] == ["000AB", None, None, "ABCDEFG", None]


@pytest.mark.parametrize("policy", ["first", "last"])
def test_overlapping_windows_match_a_loop(spark, policy):
    rng = random.Random(11)
    windows = []
    for key in range(6):
        for _ in range(rng.randint(1, 4)):
            a = rng.randint(0, 40)
            windows.append((key, rng.randint(100, 102), DAY(a), None if rng.random() < 0.15 else DAY(a + rng.randint(0, 15)), len(windows)))
    table = LinkTable.over_time(spark.createDataFrame(windows, "key int, target int, a timestamp_ntz, b timestamp_ntz, o int"), ["key"], "target", "a", "b", policy, ["o"])
    queries = [(rng.randint(0, 7), DAY(rng.randint(-2, 60))) for _ in range(200)] + [(1, None)]
    df = spark.createDataFrame([(i, *q) for i, q in enumerate(queries)], "i int, key int, date timestamp_ntz")
    got = {r.i: r.to for r in table.resolve(df, ["key"], "date", "to").collect()}
    assert len(got) == len(queries)
    for i, (key, date) in enumerate(queries):
        hits = [w for w in windows if date and w[0] == key and w[2] <= date and (w[3] is None or date <= w[3])]
        want = (hits[0] if policy == "first" else hits[-1])[1] if hits else None
        assert got[i] == want
    spans = table.df.orderBy("key", "valid_from").collect()
    assert all(a.key != b.key or a.valid_to < b.valid_from for a, b in zip(spans, spans[1:], strict=False))


def test_many_windows_of_one_key(spark):
    """Nested, chained and equal windows of one key: linear, and as a loop has it where it is asked."""
    rng = random.Random(2)
    n = 20_000
    moment = lambda s: dt.datetime(2020, 1, 1) + dt.timedelta(seconds=s)
    windows = [(1, rng.randint(0, 3), moment(i * 10), moment(i * 10 + rng.choice([5, 9, 12, 40, 100_000])), i) for i in range(n)]
    table = LinkTable.over_time(spark.createDataFrame(windows, "key int, target int, a timestamp_ntz, b timestamp_ntz, o int"), ["key"], "target", "a", "b", "last", ["o"])
    asks = [(i, 1, moment(rng.randint(-50, n * 10 + 200_000))) for i in range(300)]
    got = {r.i: r.to for r in table.resolve(spark.createDataFrame(asks, "i int, key int, date timestamp_ntz"), ["key"], "date", "to").collect()}
    for i, _, at in asks:
        assert got[i] == next((w[1] for w in reversed(windows) if w[2] <= at <= w[3]), None)
    spans = table.df.orderBy("valid_from").collect()
    assert all(a.valid_to < b.valid_from and (a.target != b.target or a.valid_to + dt.timedelta(microseconds=1) < b.valid_from) for a, b in zip(spans, spans[1:], strict=False))


def test_link_errors_and_collisions(spark):
    with pytest.raises(LinkError, match="overlap"):
        LinkTable.over_time(spark.createDataFrame([(1, 5, DAY(0), DAY(9)), (1, 6, DAY(5), DAY(12))], "k int, t int, a timestamp_ntz, b timestamp_ntz"), ["k"], "t", "a", "b")
    with pytest.raises(LinkError, match="end before"):
        LinkTable.over_time(spark.createDataFrame([(1, 5, DAY(4), DAY(2))], "k int, t int, a timestamp_ntz, b timestamp_ntz"), ["k"], "t", "a", "b")
    with pytest.raises(LinkError, match="several"):
        LinkTable.fixed(spark.createDataFrame([(1, 5), (1, 6)], "k int, t int"), ["k"], "t")
    table = LinkTable.fixed(spark.createDataFrame([(1, 9), (2, 9), (None, 3)], "k long, t long"), ["k"], "t")
    src = Panel(panel(spark, [(0, 1, 5.0), (0, 2, None), (0, 7, 1.0), (0, 7, 1.0), (0, None, 2.0)]).df.withColumnRenamed("entity", "k"), entity="k")
    with pytest.raises(LinkError):
        relink(src, table, ["k"], "t")
    with pytest.raises(LinkError):
        relink(src, table, ["k"], "t", on_unmatched="error", on_collision="sum")
    assert rows_of(relink(src, table, ["k"], "t", on_collision="sum"), "t", "x") == [(9, 5.0)]
    assert rows_of(relink(src, table, ["k"], "t", on_collision="first"), "t", "x") == [(9, 5.0)]
    assert rows_of(relink(src, table, ["k"], "t", on_collision="last"), "t", "x") == [(9, None)]
    assert rows_of(relink(src, table, ["k"], "t", "keep", "mean"), "t", "x") == sorted([(9, 5.0), (None, 1.0), (None, 1.0), (None, 2.0)], key=repr)


def test_spine_windows_break_where_a_date_is_skipped(spark):
    p = panel(spark, [(0, 1, "a"), (1, 1, "a"), (2, 2, "b"), (3, 1, "a"), (3, 2, "c")], "code string")
    rows = LinkTable.from_spine(p, ["code"], close_last=True).df.collect()
    assert sorted((r.code, r.entity, r.valid_from, r.valid_to) for r in rows) == [("a", 1, DAY(0), DAY(1)), ("a", 1, DAY(3), DAY(3)), ("b", 2, DAY(2), DAY(2)), ("c", 2, DAY(3), DAY(3))]


def test_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text("id;when;ret;name\n1;02/01/2020;1,5;x\n2;;n/a;\n3;31/12/9999;-;y\n")
    schema = Schema(date="when", entity="id", dtypes={"id": "int32", "ret": "float64", "name": "string"}, date_format="%d/%m/%Y")
    rows = read_csv(spark, str(tmp_path / "p.csv"), schema, options=CsvOptions(";", decimal=",", na_values=("-",))).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, dt.datetime(2020, 1, 2), 1.5, "x"), (2, None, None, None), (3, dt.datetime(9999, 12, 31), None, "y")]
    assert read_csv(spark, str(tmp_path / "p.csv"), schema, ["ret"], CsvOptions(";", decimal=",", na_values=("-",))).columns == ["id", "when", "ret"]
    with pytest.raises(MissingColumns):
        read_csv(spark, str(tmp_path / "p.csv"), Schema(entity="nope"), options=CsvOptions(";"))
    with pytest.raises(PanelError, match="no declared type"):
        read_csv(spark, str(tmp_path / "p.csv"), Schema(date="when", entity="id", dtypes={"id": "int32"}), options=CsvOptions(";"))
    assert java_pattern("%d/%m/%Y %H:%M") == "dd/MM/yyyy HH:mm"


def test_schedules():
    dates = [DAY(k) for k in range(20)]
    folds = WalkForward(8, 2, 3, purge=1).folds(20)
    assert [f.test for f in folds] == [(12, 15), (15, 18)] and folds[1].train == (3, 11) and folds[1].val == (12, 14)
    assert WalkForward(8, 2, 3, mode="expanding", max_folds=1, step=1).folds(20) == [Bounds(0, (0, 8), (8, 10), (10, 13))]
    with pytest.raises(SplitError):
        WalkForward(30, 2, 3).folds(20)
    one = Split(train_end="2020-01-05", val_end="2020-01-08", burn_in=2).plan(dates)[0]
    assert (one.train, one.val, one.test) == ((2, 5), (5, 8), (8, 20))
    re = Split(train_end=None, burn_in=3).rebased(dates, dates[2:])
    assert re.burn_in == 1 and re.train_end == str(dates[3:][int(17 * 0.6)])
    with pytest.raises(SplitError):
        Split(train_end="2019-01-01").plan(dates)


def test_stage_cache_resumes_and_invalidates_downstream(spark, tmp_path):
    cache, ran = StageCache(spark, str(tmp_path)), []

    def stages(limit):
        a = stage_key({"rows": 5})
        b = stage_key({"limit": limit}, a)
        return [Stage("a", a, lambda _: (ran.append("a"), spark.range(5).toDF("x"))[1]), Stage("b", b, lambda df: (ran.append("b"), df.filter(F.col("x") < limit))[1])]

    assert resolve(stages(3), cache).count() == 3 and ran == ["a", "b"]
    assert resolve(stages(3), cache).count() == 3 and ran == ["a", "b"]
    assert resolve(stages(2), cache).count() == 2 and ran == ["a", "b", "b"]
    with pytest.raises(ValueError, match="no rows"):
        resolve(stages(0), cache)


def test_importance_is_the_r2_lost(spark):
    from panelwright.operators.factor_model import Fit, Network, characteristic_importance, score_rows

    rng = np.random.default_rng(2)
    net = Network(3, 2, 2, (4,))
    size = sum(a * b for a, b in net.shapes)
    fit = Fit({0: rng.normal(size=size), 1: rng.normal(size=size)})
    rows = spark.createDataFrame([(int(k % 2), "test" if k % 5 else "val", float(rng.normal()), rng.normal(size=3).tolist(), rng.normal(size=2).tolist()) for k in range(60)], "fold int, part string, r double, z array<double>, x array<double>")
    got = {(r.fold, r.column): r.importance for r in characteristic_importance(rows, net, fit, ("a", "b", "c")).collect()}

    def r2(fold, zero):
        some = [r for r in rows.collect() if r.part == "test" and r.fold == fold]
        z = np.array([[0.0 if i == zero else v for i, v in enumerate(r.z)] for r in some])
        beta, factor, _ = net.forward(fit.theta[fold], z, np.array([r.x for r in some]))
        r = np.array([r.r for r in some])
        return 1 - ((r - (beta * factor).sum(axis=1)) ** 2).sum() / (r * r).sum()

    assert set(got) == {(f, c) for f in (0, 1) for c in "abc"}
    for (f, c), v in got.items():
        assert v == pytest.approx(r2(f, None) - r2(f, "abc".index(c)))
    assert score_rows(rows, net, fit, ("fold",)).count() == 60


@pytest.mark.parametrize("singular", [False, True])
def test_portfolios_without_each_column(spark, singular):
    from panelwright.operators.factor_model import Fit, characteristic_importance, portfolio_importance

    rng = np.random.default_rng(4)
    made = []
    for day in range(4):
        p = rng.normal(size=(30, 4))
        if singular:
            p[:, 3] = p[:, 1] + (p[:, 2] if day % 2 else 0)
        made += [(DAY(day), i, float(rng.normal() + row[0]), row.tolist(), row.tolist()) for i, row in enumerate(p)]
    sections = spark.createDataFrame(made, "date timestamp_ntz, entity int, r double, z array<double>, p array<double>").repartition(5)
    solved = {r.date: r for r in managed_portfolios(sections, leave_out=True).collect()}
    lost, total = np.zeros(4), 0.0
    for day in range(4):
        p, r = (np.array([m[k] for m in made if m[0] == DAY(day)]) for k in (4, 2))
        got = solved[DAY(day)]
        fit = lambda p: np.linalg.lstsq(p, r, rcond=1e-8)[0]  # noqa: B023, E731
        assert got.x == pytest.approx(fit(p), abs=1e-7)
        total += r @ r
        for k in range(4):
            q = p.copy()
            q[:, k] = 0
            assert got.without[k] == pytest.approx(fit(q), abs=1e-7)
            lost[k] += ((r - q @ fit(q)) ** 2).sum() - ((r - p @ fit(p)) ** 2).sum()
    found = {r.column: r.importance for r in portfolio_importance(managed_portfolios(sections, leave_out=True), "abcd").collect()}
    assert [found[c] for c in "abcd"] == pytest.approx(lost / total, abs=1e-8)

    net = Network(4, 4, 2, (3,))
    theta = {0: rng.normal(size=net.size)}
    rows = sections.join(managed_portfolios(sections, leave_out=True).select("date", "x", "without"), "date").select(F.lit(0).alias("fold"), F.lit("test").alias("part"), "r", "z", "x", "without")
    for r in characteristic_importance(rows, net, Fit(theta), "abcd", "abcd").collect():
        k = "abcd".index(r.column)
        score = {}
        for zero in (None, k):
            sse = sst = 0.0
            for m in made:
                z = np.array([[0.0 if i == zero else v for i, v in enumerate(m[3])]])
                x = solved[m[0]].x if zero is None else solved[m[0]].without[k]
                beta, factor, _ = net.forward(theta[0], z, np.array([x]))
                sse, sst = sse + (m[2] - (beta * factor).sum()) ** 2, sst + m[2] ** 2
            score[zero] = 1 - sse / sst
        assert r.importance == pytest.approx(score[None] - score[k])


def test_windows_are_cut_from_blocks(spark):
    from panelwright.operators.residuals import gather, series_blocks, window_ends

    rng = random.Random(5)
    rows = [(DAY(t), e, rng.random()) for e in range(3) for t in range(700) if rng.random() < 0.98]
    u = spark.createDataFrame(rows, "date timestamp_ntz, entity int, u double")
    value = {(d, e): x for d, e, x in rows}
    for seq in (1, 7, 40, 300):
        got = gather(u, window_ends(u, seq).select("entity", "date", "pos"), seq).collect()
        assert len(got) == sum(all((DAY(t - k), e) in value for k in range(seq)) for e in range(3) for t in range(700))
        assert all(r.seq == [value[r.date - dt.timedelta(days=k), r.entity] for k in range(seq - 1, -1, -1)] for r in got)
    sizes = [r.n for r in series_blocks(u).groupBy("entity").agg(F.sum(F.size("values")).alias("n")).collect()]
    assert max(sizes) <= 700 + 256


def test_runs_resume_where_they_stopped(spark, tmp_path):
    from panelwright.operators.runs import RunError, RunTable, resume_sweep

    folds, ran = [Bounds(k, (0, 1), (1, 2), (2, 3)) for k in range(4)], []

    def body(f, seed):
        ran.append(f.fold)
        if f.fold == 2 and ran.count(2) == 1:
            raise ValueError("killed")
        return spark.createDataFrame([(DAY(f.fold), 1.0 + f.fold, 4.0, 0.0, 0.0)], "date timestamp_ntz, sse_total double, sst_total double, sse_pred double, sst_pred double")

    root = str(tmp_path / "run")
    with pytest.raises(RunError, match="no committed"):
        RunTable(spark, root, {"a": 1}).periods()
    with pytest.raises(ValueError, match="killed"):
        resume_sweep(RunTable(spark, root, {"a": 1}), folds, body)
    # half-written data without a record are never read
    spark.createDataFrame([(9,)], "fold int").write.parquet(f"{root}/data/2-half")
    table = RunTable(spark, root, {"a": 1})
    assert {r.fold: r.state for r in table.audit(folds).collect()} == {0: "whole", 1: "whole", 2: "open", 3: "open"}
    out = resume_sweep(table, folds, body)
    assert ran == [0, 1, 2, 2, 3]
    assert {r.fold: r.status for r in out.summary.collect()} == {0: "kept", 1: "kept", 2: "completed", 3: "completed"}
    assert out.pooled().first().total_r2 == pytest.approx(1 - 10 / 16)
    resume_sweep(RunTable(spark, root, {"a": 1}), folds, body)
    assert ran == [0, 1, 2, 2, 3]
    with pytest.raises(RunError, match="another configuration"):
        RunTable(spark, root, {"a": 2})
    spark.createDataFrame([(DAY(7), 1.0, 1.0, 0.0, 0.0, 0)], "date timestamp_ntz, sse_total double, sst_total double, sse_pred double, sst_pred double, fold int").write.mode("append").parquet(table.folds().filter("fold = 0").first().data)
    assert {r.fold: r.state for r in table.audit(folds[:3]).collect()} == {0: "short", 1: "whole", 2: "whole", 3: "unplanned"}


def test_parquet_sources_hold_to_their_schema(spark, tmp_path):
    from panelwright.panel import PanelError
    from panelwright.sources.tables import MissingColumns, Schema, read_parquet

    path = str(tmp_path / "p")
    spark.createDataFrame([("2020-01-02", 1, 2.5, "7", True), (None, 2, None, "x", False)], "d string, e long, v double, w string, b boolean").write.parquet(path)
    got = read_parquet(spark, path, Schema(date="d", entity="e", dtypes={"e": "int32", "v": "float32", "b": "bool"}))
    assert [f.dataType.simpleString() for f in got.schema] == ["timestamp_ntz", "int", "float", "string", "boolean"]
    assert [r.d and r.d.isoformat() for r in got.orderBy("e").collect()] == ["2020-01-02T00:00:00", None]
    for bad in ({"v": "int64"}, {"e": "bool"}, {"b": "float64"}, {"e": "string"}):
        with pytest.raises(PanelError, match="declared"):
            read_parquet(spark, path, Schema(date="d", entity="e", dtypes=bad))
    with pytest.raises(PanelError, match="declared"):
        read_parquet(spark, path, Schema(date="v"))
    with pytest.raises(MissingColumns):
        read_parquet(spark, path, Schema(entity="e", dtypes={"nope": "int64"}))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_parquet(spark, path, Schema(entity="e", dtypes={"w": "int64"})).collect()


def test_stage_cache_survives_failed_writes(spark, tmp_path):
    blocked = tmp_path / "file"
    blocked.write_text("no folder")
    assert resolve([Stage("a", stage_key({"rows": 5}), lambda _: spark.range(5))], StageCache(spark, str(blocked))).count() == 5
    cache, key = StageCache(spark, str(tmp_path / "kept")), stage_key({"rows": 6})
    cache.store(key, spark.range(6), "a")
    broken = spark.range(7).select(F.raise_error(F.lit("halfway")).alias("id"))
    cache.store(key, broken, "a")
    assert cache.load(key).count() == 6  # the failed write left the older artifact alone
    cache.store(key, spark.range(8), "a")
    assert cache.load(key).count() == 8


def test_config_check():
    good = {"ingestion": {"panels": {"p": {"path": "x", "schema": {"date": "d", "entity": "e"}}}}, "features": {"featurizers": [{"type": "log_price", "params": {"input_column": "a", "output_name": "b"}}]}}
    assert check(good) == []
    assert "nope" in check({**good, "features": {"featurizers": [{"type": "nope"}]}})[0]
    assert "unknown settings" in check({**good, "typo": 1})[0]
    assert "no panels" in check({**good, "alignment": {"spine": "q"}})[0]


def test_portfolios_are_least_squares(spark):
    rng = np.random.default_rng(0)
    rows = [(k, e, float(rng.normal()), *(float(v) for v in rng.normal(size=3))) for k in range(3) for e in range(12)]
    p = panel(spark, rows, "r double, a double, b double, c double")
    cs = cross_sections(p, "r", ["a", "b", "c"], [], standardize=False, min_cross_section=4)
    got = {r.date: r.x for r in managed_portfolios(cs.repartition(5)).collect()}
    for k in range(3):
        z, y = np.array([r[3:] for r in rows if r[0] == k]), np.array([r[2] for r in rows if r[0] == k])
        np.testing.assert_allclose(got[DAY(k)], np.linalg.lstsq(z, y, rcond=None)[0], rtol=1e-8)
    same = cross_sections(p.with_df(p.df.withColumn("b", F.col("a"))), "r", ["a", "b"], [], standardize=False, min_cross_section=4)
    x = {r.date: r.x for r in managed_portfolios(same).collect()}[DAY(0)]
    assert x[0] == pytest.approx(x[1])  # the smallest norm splits the weight
    with pytest.raises(ModelError):
        cross_sections(p, "r", ["a", "b", "c"], [], min_cross_section=3)


def test_autoencoder_gradient_and_fit(spark):
    rng = np.random.default_rng(1)
    net = Network(3, 2, 2, (4,))
    theta = net.start(0)
    z, x, r = rng.normal(size=(6, 3)), rng.normal(size=(6, 2)), rng.normal(size=6)
    g, base = net.gradient(theta, z, x, r)
    for i in rng.choice(net.size, 12, replace=False):
        step = theta.copy()
        step[i] += 1e-6
        assert (net.gradient(step, z, x, r)[1] - base) / 1e-6 == pytest.approx(g[i], abs=1e-3)
    slopes = net.sensitivity(theta, z, x)
    fitted = lambda v: (lambda b, f, _: (b * f).sum(axis=1))(*net.forward(theta, v, x))
    for k in range(3):
        moved = z.copy()
        moved[:, k] += 1e-6
        np.testing.assert_allclose((fitted(moved) - fitted(z)) / 1e-6, slopes[:, k], atol=1e-4)
    rows = []
    for k in range(40):
        f = float(rng.normal())
        for _ in range(10):
            b = float(rng.normal())
            rows.append((k % 2, "train" if k < 30 else "val", b * f, [b], [f]))
    df = spark.createDataFrame(rows, "fold int, part string, r double, z array<double>, x array<double>").persist()
    fit = fit_folds(df, Network(1, 1, 1), Training(epochs=60, rate=0.1, l1=0.0))
    assert max(h["score"] for h in fit.history if h["fold"] == 0) > 0.95 and set(fit.theta) == {0, 1}


    one = Network(1, 1, 1)
    start, on = one.start(42), one.weights()
    last = Training(epochs=2, rate=0.01, l1=1e6, l1_mode="subgradient", min_delta=-np.inf)
    np.testing.assert_allclose(np.abs(start[on]) - np.abs(fit_folds(df, one, last).theta[0][on]), 0.01, atol=1e-5)
    with pytest.raises(ModelError):
        fit_folds(df, one, Training(l1_mode="other"))


def test_batches_of_periods_learn_in_fewer_passes(spark):
    from panelwright.operators.factor_model import fit_batches

    rng = np.random.default_rng(7)
    rows = []
    for day in range(80):
        f = rng.normal()
        for e in range(12):
            z = rng.normal(size=3)
            rows.append((day % 2, "train" if day < 60 else "val", DAY(day), e, float((z[0] - 0.5 * z[1]) * f + 0.1 * rng.normal()), z.tolist(), [f, f * f]))
    df = spark.createDataFrame(rows, "fold int, part string, date timestamp_ntz, entity int, r double, z array<double>, x array<double>")
    net = Network(3, 2, 1)
    best = lambda fit: [max(h["score"] for h in fit.history if h["fold"] == f) for f in (0, 1)]
    whole = best(fit_folds(df.persist(), net, Training(epochs=60, rate=0.1, patience=60)))
    fit = fit_batches(df.repartition(3), net, Training(epochs=12, rate=0.1, patience=12), batch_periods=1, lanes=2)
    assert all(a > b - 0.02 for a, b in zip(best(fit), whole, strict=True)), (best(fit), whole)
    again = fit_batches(df.repartition(7), net, Training(epochs=12, rate=0.1, patience=12), batch_periods=1, lanes=2)
    assert all(np.array_equal(fit.theta[f], again.theta[f]) for f in (0, 1))
    with pytest.raises(ModelError):
        fit_batches(df, net, lanes=0)


def test_column_sets(spark):
    panel = Panel(spark.createDataFrame([], "date timestamp_ntz, entity long, b double, r double, a double, later double"), "date", "entity")
    assert column_sets(panel, "r", ["later"]) == (["b", "a"], ["b", "a"])
    assert column_sets(panel, "r", ["later"], ["a"]) == (["b", "a"], ["a"])
    for bad in (("x",), ("r", ["x"]), ("r", [], ["x"]), ("r", [], ["r"]), ("r", ["a", "b", "later"])):
        with pytest.raises(ModelError):
            column_sets(panel, *bad)


def test_residual_windows(spark):
    u = spark.createDataFrame([(DAY(k), e, float(k)) for e, ks in ((1, [0, 1, 2, 4, 5, 6, 7]), (2, [0, 1, 2, 3])) for k in ks], "date timestamp_ntz, entity long, u double")
    ends = window_ends(u, 3)
    assert sorted((r.entity, r.pos) for r in ends.collect()) == [(1, 2), (1, 6), (1, 7), (2, 2), (2, 3)]
    seqs = {(r.entity, r.pos): r.seq for r in gather(u, ends.select("entity", "pos"), 3).collect()}
    assert seqs[1, 6] == [4.0, 5.0, 6.0]


def test_t_quantile():
    assert t_quantile(3) == pytest.approx(3.182446, abs=1e-5) and t_quantile(30) == pytest.approx(2.042272, abs=1e-5)


def test_sweep_records_or_raises(spark):
    from panelwright.operators.sweep import SweepError, run_sweep

    folds = [Bounds(k, (0, 1), (1, 2), (2, 3)) for k in range(3)]

    def body(f, seed):
        if f.fold == 1:
            raise ValueError("boom")
        return spark.createDataFrame([(DAY(f.fold), 1.0 + f.fold, 4.0, 0.0, 0.0)], "date timestamp_ntz, sse_total double, sst_total double, sse_pred double, sst_pred double")

    with pytest.raises(ValueError, match="boom"):
        run_sweep(spark, folds, body, lambda df, k: df)
    out = run_sweep(spark, folds, body, lambda df, k: df, "skip")
    assert sorted((r.fold, r.status) for r in out.summary.collect()) == [(0, "completed"), (1, "failed"), (2, "completed")]
    assert out.pooled().first().total_r2 == pytest.approx(1 - 4 / 8)
    with pytest.raises(SweepError):
        run_sweep(spark, folds[1:2], body, lambda df, k: df, "skip")


def test_command_line_checks_configs(tmp_path, capsys):
    from panelwright.__main__ import main

    (tmp_path / "c.yaml").write_text("ingestion: {panels: {p: {path: x, schema: {date: d, entity: e}}}}\nfeatures: {featurizers: [{type: nope}]}\n")
    assert main(["check", str(tmp_path / "c.yaml")]) == 1 and "nope" in capsys.readouterr().out


def test_exchange_sessions():
    from panelwright.functions.sessions import easter, sessions

    known = {1999: 252, 2001: 248, 2004: 252, 2007: 251, 2011: 252, 2012: 250, 2018: 251, 2019: 252, 2020: 253, 2021: 252, 2022: 251, 2023: 250, 2024: 252}
    assert {y: len(sessions(dt.date(y, 1, 1), dt.date(y, 12, 31))) for y in known} == known
    assert easter(2024) == dt.date(2024, 3, 31) and easter(2000) == dt.date(2000, 4, 23)


def test_duplicates_skip_nan(spark):
    p = panel(spark, [(0, 1, 1.0), (0, 1, float("nan")), (1, 1, float("nan"))])
    assert rows_of(clean(p, [("deduplicate", {})]), "x") == sorted([(1.0,), (None,)], key=repr)


def test_an_epoch_is_one_job_and_importance_copies_no_row(spark):
    from panelwright.operators.factor_model import Fit, characteristic_importance

    rng = np.random.default_rng(8)
    made = [(k % 2, ("train", "val", "test")[k % 3], float(rng.normal()), rng.normal(size=2).tolist(), [float(rng.normal())]) for k in range(240)]
    df = spark.createDataFrame(made, "fold int, part string, r double, z array<double>, x array<double>").repartition(16).persist()
    df.count()
    net, how = Network(2, 1, 1), Training(epochs=4, patience=4, rate=0.05)
    spark.sparkContext.setJobGroup("fit", "fit")
    try:
        fit = fit_folds(df.filter("part <> 'test'"), net, how)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("fit")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) < 16  # not one a partition and epoch
    for f in (0, 1):  # the same steps on all rows at once
        part = lambda p: [np.array([m[i] for m in made if m[0] == f and m[1] == p]) for i in (3, 4, 2)]  # noqa: B023, E731
        theta, m, v, best = net.start(how.seed), np.zeros(net.size), np.zeros(net.size), (-np.inf, None)
        for epoch in range(1, 5):
            (z, x, r), (vz, vx, vr) = part("train"), part("val")
            score = 1 - net.gradient(theta, vz, vx, vr)[1] / (vr @ vr)
            best = (score, theta) if score > best[0] + how.min_delta else best
            theta, m, v = how.step(net, theta, m, v, net.gradient(theta, z, x, r)[0] / len(r), epoch, how.rate * how.gamma ** (epoch - 1))
        np.testing.assert_allclose(fit.theta[f], best[1], atol=1e-12)
    plan = characteristic_importance(df, net, Fit(fit.theta), "ab")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
