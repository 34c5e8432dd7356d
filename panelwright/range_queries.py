"""Registered queries of what works across partitions and on streams: ranks and quantiles of very large dates, positions of
very many stamps, exponential weights of very long entities, features of a panel that arrives in parts; with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .feature_queries import CASES, HALF, PRICES_SQL, E, ewm_sql, lag, quantized, roll
from .feature_queries import ORACLE as FEATURE_SQL
from .functions.ewm import Ewm
from .functions.ranges import clip_quantiles, numbered, section_bucket, section_quantiles, section_rank, section_winsorize
from .operators.features import Feature
from .plans.feature_plan import FeaturePipeline
from .plans.shared import settled, shared_path
from .sources.derived import prices, table
from .streaming.append import stream_rows
from .streaming.features import Lag, Roll, settle_features

QUERIES, ORACLE = {}, {}


def floored(c: str, digits: int) -> Column:
    return (F.floor(F.col(c) * 10.0**digits + HALF) / 10.0**digits).alias(c)


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return add


def _lines(spark, sf) -> DataFrame:
    """Line items of three return flags, as three dates with very many names; a seventh of the values is missing."""
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("name")
    hole = (F.col("l_orderkey") + F.col("l_linenumber")) % 7 == 0
    return table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("day"), key, F.when(~hole, F.col("l_quantity").cast("double")).alias("x"), F.when(~hole, F.col("l_extendedprice").cast("double")).alias("y"))


LINES = """WITH v AS (SELECT l_returnflag AS day, l_orderkey * 10 + l_linenumber AS name,
  CASE WHEN (l_orderkey + l_linenumber) % 7 <> 0 THEN CAST(l_quantity AS DOUBLE) END AS x, CASE WHEN (l_orderkey + l_linenumber) % 7 <> 0 THEN CAST(l_extendedprice AS DOUBLE) END AS y FROM lineitem)"""


@query(
    "section_ranks_by_ranges",
    LINES
    + """, k AS (SELECT *, count(x) OVER (PARTITION BY day) AS n, count(*) OVER (PARTITION BY day, x) AS ties, rank() OVER (PARTITION BY day, x IS NULL ORDER BY x) AS r,
  dense_rank() OVER (PARTITION BY day, x IS NULL ORDER BY x DESC) AS d, row_number() OVER (PARTITION BY day, x IS NULL ORDER BY x, name) AS f, count(DISTINCT x) OVER (PARTITION BY day) AS levels FROM v)
SELECT name, CASE WHEN x IS NOT NULL THEN r + (ties - 1) / 2.0 END AS mean_rank, CASE WHEN x IS NOT NULL THEN CAST(r AS DOUBLE) END AS min_rank, CASE WHEN x IS NOT NULL THEN CAST(r + ties - 1 AS DOUBLE) END AS max_rank,
  CASE WHEN x IS NOT NULL THEN d / levels END AS dense_down, CASE WHEN x IS NOT NULL THEN CAST(f AS DOUBLE) END AS first_rank, CASE WHEN x IS NOT NULL THEN 2 * (r + (ties - 1) / 2.0 - 1) / (n - 1) - 1 END AS signed_rank,
  CASE WHEN x IS NOT NULL THEN greatest(least(ceil((r + (ties - 1) / 2.0) / n * 5), 5.0), 1.0) END AS fifth FROM k""",
)
def _ranks(spark, sf) -> DataFrame:
    df = _lines(spark, sf).select("day", "name", "x")
    for out, how in {"mean_rank": {}, "min_rank": {"method": "min"}, "max_rank": {"method": "max"}, "dense_down": {"method": "dense", "ascending": False, "by": "pct"}, "first_rank": {"method": "first"}, "signed_rank": {"by": "signed"}}.items():
        df = section_rank(df, "day", "name", "x", out, **how)
    return section_bucket(df, "day", "name", "x", "fifth", 5).drop("day", "x")


@query("section_quantiles_by_ranges", LINES + f" SELECT day, {', '.join(f'{quantized(f"quantile_cont(y, {q})", 3)} AS {n}' for n, q in (('low', 0.01), ('mid', 0.5), ('high', 0.99)))} FROM v GROUP BY day")
def _quantiles(spark, sf) -> DataFrame:
    out = section_quantiles(_lines(spark, sf), ["day"], "y", {"low": 0.01, "mid": 0.5, "high": 0.99})
    return out.select("day", *(floored(c, 3) for c in ("low", "mid", "high")))


@query(
    "clip_by_ranges",
    LINES
    + """, q AS (SELECT day, quantile_cont(y, 0.05) AS a, quantile_cont(y, 0.9) AS b FROM v GROUP BY day), w AS (SELECT quantile_cont(y, 0.02) AS c, quantile_cont(y, 0.98) AS d FROM v)
SELECT name, CASE WHEN y IS NOT NULL THEN floor(least(greatest(y, a), b) * 1e3 + 0.4987) / 1e3 END AS in_day, CASE WHEN y IS NOT NULL THEN floor(least(greatest(y, c), d) * 1e3 + 0.4987) / 1e3 END AS overall FROM v JOIN q USING (day), w""",
)
def _clip(spark, sf) -> DataFrame:
    held = section_winsorize(_lines(spark, sf), "day", "y", "in_day", 0.05, 0.9)
    return clip_quantiles(held, "y", "overall", 0.02, 0.98).select("name", floored("in_day", 3), floored("overall", 3))


@query("stamp_positions", "SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos FROM (SELECT DISTINCT ts FROM events WHERE ts IS NOT NULL)")
def _positions(spark, sf) -> DataFrame:
    return numbered(table(spark, sf, "events").select("ts").dropna().distinct(), "ts", "pos")


def _long(name: str):
    specs, _, digits = CASES[name]

    def run(spark, sf) -> DataFrame:
        out = FeaturePipeline(tuple(Feature(t, p) for t, p in specs), long_entities=True).apply(prices(spark, sf))
        return out.df.select("date", "entity", *(floored(c, digits) for c in out.values))

    return run


for _name in ("macd", "average_true_range"):
    QUERIES[f"feature_{_name}_by_ranges"], ORACLE[f"feature_{_name}_by_ranges"] = _long(_name), FEATURE_SQL[f"feature_{_name}"]

STREAMED = {"mean6": Roll("close", 6, "mean", 2), "median5": Roll("close", 5, "median", 1), "change2": Lag("gappy", 2, "difference"), "ema3": Ewm.span("gappy", 3, False, 3)}


@query(
    "stream_panel_features",
    f"WITH RECURSIVE {', '.join([PRICES_SQL.strip(), *ewm_sql('a', 'px', E('gappy', 0.5))])}, "
    f"w AS (SELECT date, entity, {roll('avg', 'close', 6, 2)} AS mean6, {roll('median', 'close', 5, 1)} AS median5, gappy - {lag('gappy', 2)} AS change2 FROM px) "
    f"SELECT w.date, w.entity, {', '.join(f'{quantized(c, 4)} AS {c}' for c in ('mean6', 'median5', 'change2'))}, CASE WHEN r.seen >= 3 THEN {quantized('r.y', 4)} END AS ema3 "
    "FROM w JOIN r_a r ON w.entity = r.entity AND w.date = r.date",
)
def _streamed(spark, sf) -> DataFrame:
    """The price panel written year by year into a folder, read as a stream of about two years a micro-batch, features settled
    as their rows come."""
    folder = shared_path(spark, "streamed")
    panel = prices(spark, sf).df.select(F.col("date").cast("timestamp").alias("date"), "entity", "close", "gappy")
    panel = settled(panel, "panel")
    years = [r["y"] for r in panel.select(F.year("date").alias("y")).distinct().orderBy("y").collect()]  # a few
    files = spark.sparkContext.defaultParallelism  # of a year, dealt by entity
    for y in years:
        panel.filter(F.year("date") == y).repartition(files, "entity").write.parquet(f"{folder}/in/{y}")
    rows = stream_rows(spark, f"{folder}/in/*", panel.schema, maxFilesPerTrigger=2 * files)
    settle_features(rows, STREAMED, f"{folder}/out", f"{folder}/state").awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    return out.select(F.col("date").cast("timestamp_ntz").alias("date"), "entity", *(floored(c, 4) for c in STREAMED))
