"""Panels derived from the order tables: monthly unit prices by supplier and others of different grain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..panel import Panel


def month(x: Column) -> Column:
    return F.date_trunc("month", x).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prices(spark: SparkSession, sf_dir: str) -> Panel:
    """open/close are the first and last unit price of a month, ties settled by order, line and price; ``gappy`` is close
    with holes."""
    line = table(spark, sf_dir, "lineitem").filter("l_quantity > 0")
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice")
    df = line.groupBy(month(F.col("l_shipdate")).alias("date"), F.col("l_suppkey").alias("entity")).agg(
        F.min_by(unit, order).alias("open"), F.max(unit).alias("high"), F.min(unit).alias("low"), F.max_by(unit, order).alias("close"), F.sum("l_quantity").alias("volume"), F.floor(F.sum("l_extendedprice") * 100 + 0.5).alias("cents")
    )
    hole = (F.year("date") * 12 + F.month("date") + F.col("entity")) % 9 == 0
    return Panel(df.select("date", "entity", "open", "high", "low", "close", "volume", (F.col("cents") / 100).alias("dollar_volume"), (1000.0 * (1 + F.col("entity") % 7)).alias("shares"), F.when(~hole, F.col("close")).alias("gappy"), F.when(~hole, F.col("entity") % 4).cast("int").alias("sector")))


PRICES_SQL = """
px AS (
  SELECT *, CASE WHEN NOT hole THEN close END AS gappy, CASE WHEN NOT hole THEN CAST(entity % 4 AS INTEGER) END AS sector FROM (
    SELECT *, (year(date) * 12 + month(date) + entity) % 9 = 0 AS hole FROM (
      SELECT CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS date, l_suppkey AS entity,
             arg_min(l_extendedprice / l_quantity, row(l_shipdate, l_orderkey, l_linenumber, l_extendedprice)) AS open,
             max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
             arg_max(l_extendedprice / l_quantity, row(l_shipdate, l_orderkey, l_linenumber, l_extendedprice)) AS close,
             CAST(sum(l_quantity) AS DOUBLE) AS volume, floor(sum(l_extendedprice) * 100 + 0.5) / 100 AS dollar_volume,
             1000.0 * (1 + l_suppkey % 7) AS shares
      FROM lineitem WHERE l_quantity > 0 GROUP BY ALL)))"""


def market(spark: SparkSession, sf_dir: str) -> Panel:
    orders = table(spark, sf_dir, "orders")
    return Panel(orders.groupBy(month(F.col("o_orderdate")).alias("date")).agg((F.floor(F.avg("o_totalprice") * 100 + 0.5) / 100).alias("avg_price"), F.count("*").alias("n")), entity=None)


MARKET_SQL = "mkt AS (SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS date, floor(avg(o_totalprice) * 100 + 0.5) / 100 AS avg_price, count(*) AS n FROM orders GROUP BY ALL)"


def sectors(spark: SparkSession, sf_dir: str) -> Panel:
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    df = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(F.col("s_suppkey").alias("entity"), F.col("n_regionkey").alias("region"), F.col("n_name").alias("nation"))
    return Panel(df, date=None)


SECTORS_SQL = "sector AS (SELECT s_suppkey AS entity, n_regionkey AS region, n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def activity(spark: SparkSession, sf_dir: str) -> Panel:
    """Daily event values by user."""
    events = table(spark, sf_dir, "events")
    df = events.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("date"), F.col("user_id").alias("entity")).agg((F.floor(F.sum("value") * 1e4 + 0.5) / 1e4).alias("total"), F.count("*").alias("n"))
    return Panel(df)


ACTIVITY_SQL = "ev AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS date, user_id AS entity, floor(sum(value) * 1e4 + 0.5) / 1e4 AS total, count(*) AS n FROM events GROUP BY ALL)"
