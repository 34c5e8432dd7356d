"""Registered queries of schedules, factor model, residual windows, tuning statistics and the configured adapter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .feature_queries import PRICES_SQL, E, div, ewm_sql, lag, roll
from .operators.factor_model import Network, Training, characteristic_importance, characteristic_sensitivity, cross_sections, dot, factor_diagnostics, factor_forecast, fit_batches, fit_folds, importance_summary, managed_portfolios, per_period_errors, pooled_r_squared, portfolio_importance, score_rows
from .operators.residuals import gather, per_date_loss, pooled_loss, residual_panel, window_ends, windows_of
from .operators.runs import RunTable, resume_sweep
from .operators.tuning import aggregate_convergence, aggregate_spread, compare, failed_gates, noise_floor
from .panel import Panel
from .plans.config import Adapter
from .plans.feature_plan import Feature, FeaturePipeline, add_features
from .plans.schedule import Bounds, Split, WalkForward, fold_members, panel_dates, positions
from .plans.shared import settled, shared_path
from .sources.derived import prices, table
from .sources.tables import Schema, read_csv

QUERIES, ORACLE = {}, {}
PX = f"WITH RECURSIVE {PRICES_SQL.strip()}"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def D(c, digits: int = 4):
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * 10.0**digits + 0.4987) / 10.0**digits


def d(c: str, digits: int = 4) -> str:
    return f"floor(({c}) * 1e{digits} + 0.4987) / 1e{digits}"


WALK = WalkForward(train_size=36, val_size=6, test_size=12, step=12, purge=1, mode="rolling")


@query(
    "schedule_walk_forward",
    PX
    + """, p AS (SELECT date, dense_rank() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM px)), k AS (SELECT unnest(generate_series(0, (SELECT (max(pos) + 1 - 56) // 12 FROM p))) AS fold),
r AS (SELECT fold, 'train' AS part, fold * 12 AS a, fold * 12 + 36 AS b FROM k UNION ALL SELECT fold, 'val', fold * 12 + 37, fold * 12 + 43 FROM k UNION ALL SELECT fold, 'test', fold * 12 + 44, fold * 12 + 56 FROM k)
SELECT CAST(fold AS INTEGER) AS fold, part, date FROM r JOIN p ON pos >= a AND pos < b""",
)
def _walk(spark, sf) -> DataFrame:
    px = prices(spark, sf)
    return fold_members(px, Split("walk_forward", walk_forward=WALK).plan(panel_dates(px)))


@query(
    "schedule_single",
    PX + ", p AS (SELECT date, dense_rank() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM px)) SELECT 0 AS fold, CASE WHEN pos <= CAST(floor(n * 0.6) AS BIGINT) THEN 'train' WHEN pos <= CAST(floor(n * 0.8) AS BIGINT) THEN 'val' ELSE 'test' END AS part, date FROM p",
)
def _single(spark, sf) -> DataFrame:
    px = prices(spark, sf)
    return fold_members(px, Split().plan(panel_dates(px)))


INPUTS = [
    ("simple_returns", {"input_column": "gappy", "horizons": [1], "output_names": ["ret"]}),
    ("log_price", {"input_column": "close", "output_name": "lp"}),
    ("high_low_range", {"high_column": "high", "low_column": "low", "close_column": "gappy", "output_name": "hl"}),
    ("candle_position", {"high_column": "high", "low_column": "low", "close_column": "close", "output_name": "cp"}),
]


def _sections(spark, sf, portfolios=("lp", "hl")) -> DataFrame:
    return cross_sections(add_features(prices(spark, sf), *INPUTS), "ret", ["lp", "hl", "cp"], portfolios, min_cross_section=5)


def _signed(x: str) -> str:
    part = f"PARTITION BY date, {x} IS NULL ORDER BY {x}"
    return f"CASE WHEN {x} IS NULL THEN 0.0 WHEN count({x}) OVER (PARTITION BY date) > 1 THEN 2.0 * (rank() OVER ({part}) + (count({x}) OVER (PARTITION BY date, {x}) - 1) / 2.0 - 1) / (count({x}) OVER (PARTITION BY date) - 1) - 1 ELSE 0.0 END"


CS = (
    PX + f", f AS (SELECT date, entity, {div('gappy', lag('gappy'))} - 1 AS ret, ln(close) AS lp, (high - low) / gappy AS hl, {div('close - low', 'high - low')} AS cp FROM px), g AS (SELECT * FROM f WHERE ret IS NOT NULL QUALIFY count(*) OVER (PARTITION BY date) >= 5), "
    f"cs AS MATERIALIZED (SELECT date, entity, CASE WHEN stddev_samp(ret) OVER (PARTITION BY date) > 0 THEN (ret - avg(ret) OVER (PARTITION BY date)) / stddev_samp(ret) OVER (PARTITION BY date) ELSE 0.0 END AS r, {', '.join(f'CAST({_signed(x)} AS DOUBLE) AS {x}' for x in ('lp', 'hl', 'cp'))} FROM g), "
    "m AS (SELECT date, sum(lp * lp) AS aa, sum(lp * hl) AS ab, sum(hl * hl) AS bb, sum(lp * r) AS ar, sum(hl * r) AS br FROM cs GROUP BY date), "
    "x AS MATERIALIZED (SELECT date, (bb * ar - ab * br) / (aa * bb - ab * ab) AS x0, (aa * br - ab * ar) / (aa * bb - ab * ab) AS x1 FROM m) "
)


@query("factor_cross_sections", CS + f"SELECT date, entity, {d('r')} AS r, {d('lp')} AS lp, {d('hl')} AS hl, {d('cp')} AS cp FROM cs")
def _cs(spark, sf) -> DataFrame:
    s = _sections(spark, sf)
    return s.select("date", "entity", D("r").alias("r"), *(D(F.col("z")[i]).alias(n) for i, n in enumerate(("lp", "hl", "cp"))))


@query("factor_managed_portfolios", CS + f"SELECT date, {d('x0')} AS x0, {d('x1')} AS x1 FROM x")
def _portfolios(spark, sf) -> DataFrame:
    return managed_portfolios(_sections(spark, sf)).select("date", D(F.col("x")[0]).alias("x0"), D(F.col("x")[1]).alias("x1"))


@query("factor_leave_one_out", CS + f"SELECT date, {d('br / nullif(bb, 0)')} AS hl_alone, {d('ar / nullif(aa, 0)')} AS lp_alone FROM m")
def _leave_one_out(spark, sf) -> DataFrame:
    """The portfolios solved again without either characteristic."""
    solved = managed_portfolios(_sections(spark, sf), leave_out=True)
    return solved.select("date", D(F.col("without")[0][1]).alias("hl_alone"), D(F.col("without")[1][0]).alias("lp_alone"))


@query(
    "factor_portfolio_importance",
    CS + ", e AS (SELECT sum((r - lp * x0 - hl * x1) ** 2) AS whole, sum((r - hl * (br / bb)) ** 2) AS no_lp, sum((r - lp * (ar / aa)) ** 2) AS no_hl, sum(r * r) AS total FROM cs JOIN x USING (date) JOIN m USING (date)) "
    f"SELECT 'lp' AS \"column\", {d('(no_lp - whole) / total', 6)} AS importance FROM e UNION ALL SELECT 'hl', {d('(no_hl - whole) / total', 6)} FROM e",
)
def _portfolio_importance(spark, sf) -> DataFrame:
    out = portfolio_importance(managed_portfolios(_sections(spark, sf), leave_out=True), ("lp", "hl"))
    return out.select("column", D("importance", 6).alias("importance"))


@query("factor_forecast_expanding", CS + f"SELECT date, {d('avg(x0) OVER w')} AS f0, {d('avg(x1) OVER w')} AS f1 FROM x WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def _forecast(spark, sf) -> DataFrame:
    level = factor_forecast(managed_portfolios(_sections(spark, sf)).withColumnRenamed("x", "factor"))
    return level.select("date", D(F.col("level")[0]).alias("f0"), D(F.col("level")[1]).alias("f1"))


@query(
    "factor_forecast_ewma",
    CS + ", y AS (SELECT 0 AS entity, date, x0, x1 FROM x), " + ", ".join([*ewm_sql("a", "y", E("x0", 0.1)), *ewm_sql("b", "y", E("x1", 0.1))])
    + f", e AS (SELECT a.date, lag(a.y) OVER (ORDER BY a.date) AS f0, lag(b.y) OVER (ORDER BY a.date) AS f1 FROM r_a a JOIN r_b b ON a.date = b.date) SELECT date, {d('f0')} AS f0, {d('f1')} AS f1 FROM e",
)
def _forecast_ewma(spark, sf) -> DataFrame:
    level = factor_forecast(managed_portfolios(_sections(spark, sf)).withColumnRenamed("x", "factor"), "ewma", 0.1)
    return level.select("date", D(F.col("level")[0]).alias("f0"), D(F.col("level")[1]).alias("f1"))


def _scored(spark, sf) -> DataFrame:
    """Regression portfolios as factors with the characteristics themselves as betas."""
    s, x = _sections(spark, sf), managed_portfolios(_sections(spark, sf))
    level = factor_forecast(x.withColumnRenamed("x", "factor"))
    both = s.join(x, "date").join(level, "date").select("date", "entity", "r", F.col("p").alias("beta"), F.col("x").alias("factor"), "level")
    return both.withColumns({"fitted": dot(F.col("beta"), F.col("factor")), "predicted": F.when(F.col("level").isNotNull(), dot(F.col("beta"), F.col("level")))})


SCORED = CS + ", l AS (SELECT date, avg(x0) OVER w AS l0, avg(x1) OVER w AS l1 FROM x WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), sc AS (SELECT cs.date, r, lp, hl, x0, x1, lp * x0 + hl * x1 AS fitted, lp * l0 + hl * l1 AS predicted FROM cs JOIN x USING (date) JOIN l USING (date)), e AS (SELECT date, sum((r - fitted) ** 2) AS sse_total, sum(r * r) AS sst_total, coalesce(sum((r - predicted) ** 2), 0) AS sse_pred, coalesce(sum(r * r) FILTER (predicted IS NOT NULL), 0) AS sst_pred FROM sc GROUP BY date) "


@query("factor_per_period_errors", SCORED + f"SELECT date, {', '.join(f'{d(c)} AS {c}' for c in ('sse_total', 'sst_total', 'sse_pred', 'sst_pred'))} FROM e")
def _errors(spark, sf) -> DataFrame:
    e = per_period_errors(_scored(spark, sf))
    return e.select("date", *(D(c).alias(c) for c in e.columns[1:]))


@query("factor_pooled_r2", SCORED + f"SELECT {d('1 - sum(sse_total) / sum(sst_total)', 6)} AS total_r2, {d('1 - sum(sse_pred) / sum(sst_pred)', 6)} AS pred_r2, count(*) AS periods FROM e")
def _pooled(spark, sf) -> DataFrame:
    return pooled_r_squared(per_period_errors(_scored(spark, sf))).select(D("total_r2", 6).alias("total_r2"), D("pred_r2", 6).alias("pred_r2"), "periods")


@query("factor_diagnostics", SCORED + f", s AS (SELECT sum((lp * x0) ** 2) AS a, sum((hl * x1) ** 2) AS b FROM sc), q AS (SELECT abs(corr(x0, x1)) AS c FROM x) SELECT {d('(a + b) * (a + b) / (a * a + b * b)', 6)} AS effective, {d('c', 6)} AS max_abs_correlation FROM s, q")
def _diagnostics(spark, sf) -> DataFrame:
    return factor_diagnostics(_scored(spark, sf), 2).select(D("effective", 6).alias("effective"), D("max_abs_correlation", 6).alias("max_abs_correlation"))


def fold_periods(spark, sf, walk: WalkForward = WALK) -> tuple[DataFrame, DataFrame]:
    """The sections and (fold, part, date, x) of all folds' periods, both written once."""
    s = settled(_sections(spark, sf), "sections")
    panel = Panel(s)
    members = fold_members(panel, Split("walk_forward", walk_forward=walk).plan(panel_dates(panel)))
    return s, settled(managed_portfolios(s).join(members, "date").select("fold", "part", "date", "x"), "periods")


def _joined(s: DataFrame, periods: DataFrame) -> DataFrame:
    return s.join(periods, "date").select("fold", "part", "date", "entity", "r", "z", "x")


def fold_rows(spark, sf, walk: WalkForward = WALK) -> DataFrame:
    """(fold, part, date, entity, r, z, x) of all folds."""
    return _joined(*fold_periods(spark, sf, walk))


def _trained(rows: DataFrame):
    """All walk-forward folds of a conditional autoencoder, trained at once: rows, network, fit."""
    net = Network(3, 2, 2, (4,))
    return rows, net, fit_folds(rows.filter("part <> 'test'"), net, Training(epochs=12))


@query("factor_autoencoder_sweep")
def _sweep(spark, sf) -> DataFrame:
    """Total and predictive R2 of every fold's test dates; a date's forecast is the mean of the fold's factors before it."""
    s, periods = fold_periods(spark, sf)
    rows, net, fit = _trained(_joined(s, periods))
    # a factor is the date's alone, so one row a date gives it
    factors = score_rows(periods.withColumn("z", F.array_repeat(F.lit(0.0), net.inputs)), net, fit, ("fold", "date"))
    level = factor_forecast(factors.select("fold", "date", "factor"), by=["fold"])
    scored = score_rows(rows.filter("part = 'test'"), net, fit, ("fold", "part", "date", "entity", "r")).join(level, ["fold", "date"])
    scored = scored.withColumns({"fitted": dot(F.col("beta"), F.col("factor")), "predicted": F.when(F.col("level").isNotNull(), dot(F.col("beta"), F.col("level")))})
    return pooled_r_squared(per_period_errors(scored, ["fold"]), ["fold"]).select("fold", "total_r2", "pred_r2", "periods")


@query("factor_batch_training")
def _batches(spark, sf) -> DataFrame:
    """The best validation R2 of every fold, trained in batches of periods, and the pass that gave it."""
    rows = fold_rows(spark, sf).filter("part <> 'test'")
    fit = fit_batches(rows, Network(3, 2, 2, (4,)), Training(epochs=4))
    history = spark.createDataFrame([(h["fold"], h["epoch"], float(h["score"])) for h in fit.history], "fold int, pass int, score double")
    return history.groupBy("fold").agg(D(F.max("score"), 3).alias("score"), F.count("*").alias("passes"))


@query("factor_characteristic_importance")
def _importance(spark, sf) -> DataFrame:
    return characteristic_importance(*_trained(fold_rows(spark, sf)), ("lp", "hl", "cp"))


@query("factor_characteristic_sensitivity")
def _sensitivity(spark, sf) -> DataFrame:
    return characteristic_sensitivity(*_trained(fold_rows(spark, sf)), ("lp", "hl", "cp"))


@query("residual_panel", CS + f"SELECT cs.date, cs.entity, {d('r - (lp * x0 + hl * x1)')} AS u FROM cs JOIN x USING (date)")
def _residual_panel(spark, sf) -> DataFrame:
    """What the regression portfolios leave of each return."""
    return residual_panel(_scored(spark, sf)).select("date", "entity", D("u").alias("u"))


# residual windows

RESIDUALS = PX + f", v AS (SELECT date, entity, {div('gappy', lag('gappy'))} - 1 AS u FROM px), p AS (SELECT date, dense_rank() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM v)), q AS (SELECT date, dense_rank() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM v WHERE u IS NOT NULL)), n AS (SELECT v.*, q.pos, q.pos - row_number() OVER (PARTITION BY entity ORDER BY v.date) AS run FROM v JOIN q USING (date) WHERE u IS NOT NULL), e AS (SELECT *, row_number() OVER (PARTITION BY entity, run ORDER BY pos) AS len FROM n) "


def _residuals(spark, sf) -> DataFrame:
    return add_features(prices(spark, sf), INPUTS[0]).df.select("date", "entity", F.col("ret").alias("u"))


@query(
    "residual_windows",
    RESIDUALS + ", k AS (SELECT 0 AS fold, 'train' AS part, 0 AS a, 49 AS b UNION ALL SELECT 0, 'val', 49, 66 UNION ALL SELECT 0, 'test', 66, 1000) "
    "SELECT k.fold, k.part, e.entity, e.date, t.u AS target FROM e JOIN k ON e.pos >= k.a AND e.pos < k.b JOIN n t ON t.entity = e.entity AND t.pos = e.pos + 1 WHERE e.len >= 4 AND e.pos % 2 = 0 AND e.pos + 1 < k.b",
)
def _windows(spark, sf) -> DataFrame:
    u = _residuals(spark, sf).filter("u is not null")
    return windows_of(u, [Bounds(0, (0, 49), (49, 66), (66, 1000))], 4, 2, 1).drop("pos")


@query("residual_sequences", RESIDUALS + f"SELECT entity, date, {d('a[1]')} AS s0, {d('a[4]')} AS s3, len(a) AS size FROM (SELECT entity, date, len, list(u) OVER (PARTITION BY entity ORDER BY pos ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS a FROM e) WHERE len >= 4")
def _sequences(spark, sf) -> DataFrame:
    u = _residuals(spark, sf).filter("u is not null")
    return gather(u, window_ends(u, 4).select("entity", "date", "pos"), 4).select("entity", "date", D(F.col("seq")[0]).alias("s0"), D(F.col("seq")[3]).alias("s3"), F.size("seq").cast("long").alias("size"))


@query("residual_pooled_loss", RESIDUALS + f", s AS (SELECT n.date, n.u AS score, t.u AS target FROM n JOIN n t ON t.entity = n.entity AND t.pos = n.pos + 1), g AS (SELECT date, sum((score - target) ** 2) AS loss, count(*) AS n FROM s GROUP BY date) SELECT {d('sum(loss) / sum(n)', 2)} AS loss, count(*) AS dates FROM g")
def _loss(spark, sf) -> DataFrame:
    """Of the forecast that the next residual equals this one."""
    u = _residuals(spark, sf).filter("u is not null")
    pairs = windows_of(u, [Bounds(0, (0, 10_000), (0, 0), (0, 0))], 1, 1, 1).join(u, ["date", "entity"]).withColumnRenamed("u", "score")
    return pooled_loss(per_date_loss(pairs)).select(D("loss", 2).alias("loss"), "dates")


# sweep and tuning statistics over fold scores drawn from the price panel

SCORES = PX + f", v AS (SELECT date, entity, {div('gappy', lag('gappy'))} - 1 AS ret FROM px), s AS (SELECT CAST(entity % 4 AS INTEGER) AS run, year(date) AS fold, avg(ret) AS score FROM v GROUP BY ALL HAVING avg(ret) IS NOT NULL) "


def _scores(spark, sf) -> DataFrame:
    ret = add_features(prices(spark, sf), INPUTS[0]).df
    return ret.groupBy((F.col("entity") % 4).cast("int").alias("run"), F.year("date").alias("fold")).agg(F.avg("ret").alias("score")).filter("score is not null")


@query("sweep_spread", SCORES + f"SELECT 'score' AS \"column\", count(*) AS n, {d('avg(score)')} AS mean, {d('median(score)')} AS median, {d('min(score)')} AS min, {d('max(score)')} AS max, {d('stddev_samp(score)')} AS std, {d('stddev_samp(score) / sqrt(count(*))')} AS sem, {d('quantile_cont(score, 0.75) - quantile_cont(score, 0.25)')} AS iqr FROM s WHERE fold % 3 <> 0")
def _spread(spark, sf) -> DataFrame:
    folds = _scores(spark, sf).withColumn("status", F.when(F.col("fold") % 3 != 0, "completed").otherwise("failed"))
    out = aggregate_spread(folds, ["score"])
    return out.select("column", "n", *(D(c).alias(c) for c in out.columns[2:]))


@query("tuning_noise_floor", SCORES + f", p AS (SELECT run, avg(score) AS score FROM s GROUP BY run) SELECT count(*) AS replicates, {d('avg(score)')} AS pooled_mean, {d('stddev_samp(score)')} AS sigma_seed, {d('max(score) - min(score)')} AS range_band, {d('3.182446305284263 * stddev_samp(score) * sqrt(1 / 4 + 1)', 3)} AS screen_band_1_seed FROM p")
def _noise(spark, sf) -> DataFrame:
    out = noise_floor(_scores(spark, sf).groupBy("run").agg(F.avg("score").alias("score")))
    return out.select("replicates", D("pooled_mean").alias("pooled_mean"), D("sigma_seed").alias("sigma_seed"), D("range_band").alias("range_band"), D("screen_band_1_seed", 3).alias("screen_band_1_seed"))


@query(
    "tuning_compare",
    SCORES + ", a AS (SELECT fold, avg(score) AS a FROM s WHERE run < 2 GROUP BY fold), b AS (SELECT fold, avg(score) AS b FROM s WHERE run >= 2 GROUP BY fold), c AS (SELECT b - a AS x FROM a JOIN b USING (fold)) "
    f"SELECT count(*) AS folds_compared, {d('avg(x)')} AS delta, {d('stddev_samp(x)')} AS delta_sd, count(*) FILTER (x > 0) AS fold_wins, {d('stddev_samp(x) * sqrt(1.0 / count(*) + 0.25)')} AS se_corrected, {d('avg(x) / (stddev_samp(x) * sqrt(1.0 / count(*) + 0.25))')} AS t_corrected FROM c",
)
def _compare(spark, sf) -> DataFrame:
    s = _scores(spark, sf)
    out = compare(s.filter("run < 2"), s.filter("run >= 2"), 0.25)
    return out.select("folds_compared", D("delta").alias("delta"), D("delta_sd").alias("delta_sd"), "fold_wins", D("se_corrected").alias("se_corrected"), D("t_corrected").alias("t_corrected"))


@query(
    "sweep_convergence",
    SCORES + ", f AS (SELECT *, fold % 3 <> 0 AS done, run % 2 = 0 AS early, abs(hash_free) AS secs FROM (SELECT *, CAST(fold % 7 AS DOUBLE) AS hash_free FROM s)) SELECT count(*) FILTER (done) AS completed, count(*) FILTER (NOT done) AS failed, count(*) FILTER (done AND early) AS stopped_early, count(*) FILTER (done AND NOT early) AS hit_cap, sum(secs) FILTER (done) AS seconds, quantile_cont(fold % 11, 0.5) FILTER (done) AS median_epochs FROM f",
)
def _convergence(spark, sf) -> DataFrame:
    done, early = F.col("fold") % 3 != 0, F.col("run") % 2 == 0
    folds = _scores(spark, sf).select(F.when(done, "completed").otherwise("failed").alias("status"), early.alias("stopped_early"), (~early).alias("hit_cap"), (F.col("fold") % 7).cast("double").alias("seconds"), (F.col("fold") % 11).cast("double").alias("epochs"))
    return aggregate_convergence(folds)


@query("tuning_gates", SCORES + ", r AS (SELECT run, count(*) FILTER (fold = 1997) AS broken, count(DISTINCT fold) AS folds, count(*) FILTER (score IS NULL) AS holes FROM s GROUP BY run), g AS (SELECT 'failed folds' AS gate, CAST(sum(broken) AS BIGINT) AS failed FROM r UNION ALL SELECT 'runs with other fold counts', count(*) FILTER (folds <> 4) FROM r UNION ALL SELECT 'missing scores', CAST(sum(holes) AS BIGINT) FROM r) SELECT * FROM g WHERE failed > 0")
def _gates(spark, sf) -> DataFrame:
    return failed_gates(_scores(spark, sf).withColumn("status", F.when(F.col("fold") == 1997, "failed").otherwise("completed")), 4, "score")


@query("importance_summary", SCORES + f"SELECT CAST(run AS VARCHAR) AS \"column\", {d('median(score)')} AS median, {d('avg(score)')} AS mean, {d('stddev_samp(score)')} AS std, {d('min(score)')} AS min, {d('max(score)')} AS max, count(score) AS folds, count(*) FILTER (score > 0) AS folds_positive FROM s GROUP BY run")
def _importances(spark, sf) -> DataFrame:
    out = importance_summary(_scores(spark, sf).select(F.col("run").cast("string").alias("column"), F.col("score").alias("importance")))
    return out.select("column", *(D(c).alias(c) for c in ("median", "mean", "std", "min", "max")), "folds", "folds_positive")


# sources, pipeline options, configuration


@query("source_csv", "SELECT s_suppkey, s_name, CAST(s_nationkey AS INTEGER) AS s_nationkey, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal END AS s_acctbal, CAST(TIMESTAMP '1995-01-01' + to_days(CAST(s_suppkey % 1000 AS INTEGER)) AS TIMESTAMP) AS opened FROM supplier")
def _csv(spark, sf) -> DataFrame:
    """Suppliers written as CSV with decimal commas, blanks and day-first dates, and read with a declared schema."""
    from .sources.tables import CsvOptions

    path = shared_path(spark, "suppliers")
    s = table(spark, sf, "supplier")
    opened = F.date_format(F.expr("date'1995-01-01' + cast(s_suppkey % 1000 as int)"), "dd/MM/yyyy")
    text = s.select("s_suppkey", "s_name", "s_nationkey", F.when(F.col("s_suppkey") % 7 == 0, F.lit("n/a")).otherwise(F.replace(F.col("s_acctbal").cast("string"), F.lit("."), F.lit(","))).alias("s_acctbal"), opened.alias("opened"))
    text.write.csv(path, header=True, sep=";")
    schema = Schema(entity="s_suppkey", dtypes={"s_suppkey": "int64", "s_name": "string", "s_nationkey": "Int32", "s_acctbal": "float64"}, date_columns=("opened",), date_format="%d/%m/%Y")
    return read_csv(spark, path, schema, options=CsvOptions(delimiter=";", decimal=","))


@query(
    "pipeline_warmup",
    PX + f", v AS (SELECT date, entity, close, {div('close', lag('close'))} - 1 AS ret FROM px), z AS (SELECT *, {roll('avg', 'ret', 6, 6)} AS f FROM v), s AS (SELECT greatest(min(date) FILTER (ret IS NOT NULL), min(date) FILTER (f IS NOT NULL)) AS first_day FROM z) SELECT date, entity, close, {d('f')} AS f FROM z, s WHERE date >= first_day",
)
def _warmup(spark, sf) -> DataFrame:
    from .plans.feature_plan import Selection

    made = (Feature("simple_returns", {"input_column": "close", "horizons": [1], "output_names": ["ret"]}), Feature("rolling_aggregation", {"input_column": "ret", "windows": [6], "output_names": ["f"], "how": "mean", "min_periods": 6}))
    out = FeaturePipeline(made, keep_inputs=Selection(("close",)), intermediate=frozenset({"ret"}), drop_warmup=True).apply(prices(spark, sf))
    return out.df.select("date", "entity", "close", D("f").alias("f"))


def adapter_config(sf: str) -> dict:
    return {
        "ingestion": {
            "panels": {
                "ev": {"path": f"{sf}/events.parquet", "format": "parquet", "schema": {"date": "ts", "entity": "user_id"}, "columns": ["value", "event_type"]},
                "who": {"path": f"{sf}/customer.parquet", "format": "parquet", "schema": {"entity": "c_custkey"}, "columns": ["c_acctbal", "c_nationkey"]},
            }
        },
        "preprocessing": {"ev": [{"type": "deduplicate"}, {"type": "consistency", "params": {"rules": [{"column": "value", "op": "ge", "bound": 0.0}]}}]},
        "alignment": {"spine": "ev", "joins": [{"panel": "who", "aligner": {"type": "broadcast_entity"}, "prefix": "c_", "rename": {"c_c_acctbal": "balance"}}]},
        "features": {"featurizers": [{"type": "rolling_aggregation", "params": {"input_column": "value", "windows": [3], "output_names": ["mean3"], "how": "mean", "min_periods": 2}}], "keep_inputs": {"include": ["balance"]}, "drop_warmup": False},
    }


@query("adapter_pipeline", f"WITH e AS (SELECT ts AS date, user_id AS entity, avg(value) AS v FROM events GROUP BY ALL), f AS (SELECT date, entity, CASE WHEN v >= 0 THEN v END AS value FROM e), g AS (SELECT *, {roll('avg', 'value', 3, 2)} AS mean3 FROM f) SELECT date AS ts, g.entity AS user_id, c.c_acctbal AS balance, {d('mean3')} AS mean3 FROM g LEFT JOIN customer c ON c.c_custkey = g.entity")
def _adapter(spark, sf) -> DataFrame:
    return Adapter.of(adapter_config(sf)).build(spark).df.select("ts", "user_id", "balance", D("mean3").alias("mean3"))



# runs that resume

RESUMED = WalkForward(24, 6, 12)
#: Squared moves of a month against its level, of the dates of each fold's test range.
MOVES_SQL = (
    PX + ", n AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM px)), k AS (SELECT count(*) AS n FROM n), "
    "o AS (SELECT CAST(unnest(range(CAST((n - 42) // 12 + 1 AS BIGINT))) AS INT) AS fold FROM k), "
    "e AS (SELECT fold, date, sum((close - open) ** 2) AS sse, sum(close ** 2) AS sst FROM px JOIN n USING (date) JOIN o ON pos >= fold * 12 + 30 AND pos < fold * 12 + 42 GROUP BY fold, date) "
)


def _resumed(spark, sf) -> tuple[RunTable, list[Bounds]]:
    """A run stopped after two folds, and resumed."""
    px = prices(spark, sf)
    folds, at = Split("walk_forward", walk_forward=RESUMED).plan(panel_dates(px)), positions(px)

    def body(f: Bounds, seed: int) -> DataFrame:
        own = at.filter((F.col("pos") >= f.test[0]) & (F.col("pos") < f.test[1])).select("date")
        square = lambda x: F.sum(x * x)
        rows = px.df.join(own, "date").groupBy("date")
        return rows.agg(square(F.col("close") - F.col("open")).alias("sse_total"), square(F.col("close")).alias("sst_total"), F.lit(0.0).alias("sse_pred"), F.lit(0.0).alias("sst_pred"))

    root = shared_path(spark, "run")
    resume_sweep(RunTable(spark, root, RESUMED), folds[:2], body)
    table = RunTable(spark, root, RESUMED)
    resume_sweep(table, folds, body)
    return table, folds


@query("sweep_resumed", MOVES_SQL + f"SELECT fold, {d('1 - sum(sse) / sum(sst)', 6)} AS total_r2, count(*) AS periods FROM e GROUP BY fold")
def _sweep_resumed(spark, sf) -> DataFrame:
    table, _ = _resumed(spark, sf)
    return pooled_r_squared(table.periods(), ["fold"]).select("fold", D("total_r2", 6).alias("total_r2"), "periods")


@query("sweep_audit", MOVES_SQL + "SELECT fold, 'whole' AS state, 1 AS commits, count(*) AS rows_told, count(*) AS rows_found FROM e GROUP BY fold UNION ALL SELECT max(fold) + 1, 'open', 0, 0, 0 FROM e")
def _sweep_audit(spark, sf) -> DataFrame:
    """Of the resumed run, against a plan with one fold more."""
    table, folds = _resumed(spark, sf)
    return table.audit([*folds, Bounds(len(folds), (0, 0), (0, 0), (0, 0))])
