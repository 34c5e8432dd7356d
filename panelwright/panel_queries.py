"""Registered queries of cleaning, ingestion filters, alignment and linking over derived panels, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.alignment import Join, merge_panels
from .operators.cleaning import clean
from .operators.linking import LinkTable, Normalization, link_report, normalized, relink
from .panel import Panel, PanelSet
from .sources.derived import ACTIVITY_SQL, MARKET_SQL, PRICES_SQL, SECTORS_SQL, activity, market, prices, sectors, table
from .sources.filters import RowSelection, apply_filters

QUERIES, ORACLE = {}, {}
PX = f"WITH {PRICES_SQL.strip()} "
D4 = lambda c: (F.floor(F.col(c) * 1e4 + 0.4987) / 1e4).alias(c)
d4 = lambda c: f"floor({c} * 1e4 + 0.4987) / 1e4 AS {c}"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


# cleaning


@query("clean_trading_calendar", f"WITH {ACTIVITY_SQL} SELECT date, entity, total, n FROM ev WHERE isodow(date) < 6")
def _calendar(spark, d) -> DataFrame:
    return clean(activity(spark, d), [("trading_calendar", {"calendar": "weekdays"})]).df


@query("clean_trading_calendar_xnys", f"WITH {ACTIVITY_SQL} SELECT date, entity, total, n FROM ev WHERE isodow(date) < 6 AND strftime(date, '%Y-%m-%d') NOT IN ('2024-01-01', '2024-01-15')")
def _xnys(spark, d) -> DataFrame:
    return clean(activity(spark, d), [("trading_calendar", {"calendar": "XNYS"})]).df


@query(
    "clean_deduplicate",
    "WITH l AS (SELECT CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS date, l_suppkey AS entity, l_quantity AS quantity, l_returnflag AS flag FROM lineitem) "
    f"SELECT date, entity, {d4('quantity')}, flag FROM (SELECT date, entity, avg(quantity) AS quantity, arg_min(flag, row(quantity, flag)) AS flag FROM l GROUP BY ALL)",
)
def _deduplicate(spark, d) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("date"), F.col("l_suppkey").alias("entity"), F.col("l_quantity").cast("double").alias("quantity"), F.col("l_returnflag").alias("flag"))
    return clean(Panel(lines), [("deduplicate", {})]).df.select("date", "entity", D4("quantity"), "flag")


@query("clean_nan_entity_filter", PX + "SELECT date, entity, gappy, volume FROM (SELECT *, avg(CAST(gappy IS NULL AS DOUBLE)) OVER (PARTITION BY entity, sector) AS m FROM px) WHERE m <= 0.12")
def _nan_filter(spark, d) -> DataFrame:
    return clean(prices(spark, d), [("nan_entity_filter", {"threshold": 0.12, "columns": ["gappy"], "subgroup_keys": ["sector"]})]).df.select("date", "entity", "gappy", "volume")


def _factored(spark, d) -> Panel:
    px = prices(spark, d)
    return px.with_df(px.df.select("date", "entity", "close", "volume", F.when((F.month("date") + F.col("entity")) % 10 == 0, F.lit(2.0)).when((F.month("date") + F.col("entity")) % 7 == 0, F.lit(-1.0)).alias("factor")))


FACTORED = PX + ", x AS (SELECT date, entity, close, volume, CASE WHEN (month(date) + entity) % 10 = 0 THEN 2.0::DOUBLE WHEN (month(date) + entity) % 7 = 0 THEN -1.0::DOUBLE END AS factor FROM px), "
CUMULATED = FACTORED + "c AS (SELECT *, coalesce(product(CASE WHEN factor > 0 THEN factor ELSE 1 END) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1.0) AS cum FROM x) "


@query("clean_cumulative_factor", CUMULATED + "SELECT date, entity, factor, cum FROM c")
def _cumulative(spark, d) -> DataFrame:
    return clean(_factored(spark, d), [("cumulative_factor", {"factor_column": "factor", "output_column": "cum"})]).df.select("date", "entity", "factor", "cum")


@query("clean_corporate_adjustment", CUMULATED + f"SELECT date, entity, {d4('close')}, volume FROM (SELECT date, entity, close / cum AS close, volume * cum AS volume FROM c)")
def _adjust(spark, d) -> DataFrame:
    steps = [("cumulative_factor", {"factor_column": "factor", "output_column": "cum"}), ("corporate_adjustment", {"adjustments": [{"columns": ["close"], "factor_column": "cum", "operation": "divide"}, {"columns": ["volume"], "factor_column": "cum", "operation": "multiply"}]})]
    return clean(_factored(spark, d), steps).df.select("date", "entity", D4("close"), "volume")


@query("clean_consistency", PX + ", a AS (SELECT date, entity, close, volume, CASE WHEN open <= 9000 THEN open END AS open FROM px) SELECT date, entity, open, CASE WHEN open > close THEN NULL ELSE close END AS close, CASE WHEN volume >= 50 THEN volume END AS volume FROM a")
def _consistency(spark, d) -> DataFrame:
    rules = [{"column": "open", "op": "le", "bound": 9000.0}, {"column": "open", "op": "le", "other_column": "close", "target": "close"}, {"column": "volume", "op": "ge", "bound": 50.0}]
    return clean(prices(spark, d), [("consistency", {"rules": rules})]).df.select("date", "entity", "open", "close", "volume")


@query("clean_forward_fill", PX + "SELECT date, entity, coalesce(gappy, last_value(gappy IGNORE NULLS) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)) AS gappy, coalesce(sector, last_value(sector IGNORE NULLS) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)) AS sector FROM px")
def _forward(spark, d) -> DataFrame:
    return clean(prices(spark, d), [("forward_fill", {"columns": ["gappy", "sector"], "limit": 1})]).df.select("date", "entity", "gappy", "sector")


@query("clean_constant_fill", PX + "SELECT date, entity, coalesce(gappy, -1.0) AS gappy, coalesce(sector, -1) AS sector FROM px")
def _constant(spark, d) -> DataFrame:
    return clean(prices(spark, d), [("constant_fill", {"columns": ["gappy", "sector"], "value": -1})]).df.select("date", "entity", "gappy", "sector")


# ingestion


@query("ingest_row_selection", PX + "SELECT date, entity, close FROM px WHERE date BETWEEN TIMESTAMP '1996-02-01' AND TIMESTAMP '1997-06-01' AND entity IN (1, 3, 5)")
def _rows(spark, d) -> DataFrame:
    return RowSelection("1996-02-01", "1997-06-01", (1, "3", 5.0)).apply(prices(spark, d)).df.select("date", "entity", "close")


@query("ingest_top_n_market_cap", PX + "SELECT date, entity, close FROM px WHERE gappy IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date ORDER BY gappy * shares DESC, entity) <= 5")
def _top(spark, d) -> DataFrame:
    return apply_filters(prices(spark, d), [("top_n_market_cap", {"n": 5, "price_column": "gappy", "shares_column": "shares"})]).df.select("date", "entity", "close")


# alignment


def _reports(spark, d) -> Panel:
    """Quarterly sums of volume that become known some weeks after the quarter; some never."""
    px = prices(spark, d)
    q = F.date_trunc("quarter", "date").cast("timestamp_ntz")
    df = px.df.groupBy(q.alias("date"), "entity").agg(F.sum("volume").alias("total"))
    known = F.col("date") + F.expr("make_dt_interval(cast(95 + entity % 60 as int))")
    return Panel(df.withColumn("known", F.when((F.col("entity") + F.month("date")) % 11 != 0, known)))


REPORTS = PX + ", q AS (SELECT CAST(date_trunc('quarter', date) AS TIMESTAMP) AS date, entity, sum(volume) AS total FROM px GROUP BY ALL), rep AS (SELECT *, CASE WHEN (entity + month(date)) % 11 <> 0 THEN date + to_days(CAST(95 + entity % 60 AS INTEGER)) END AS known FROM q) "


@query("align_exact", PX + f", {ACTIVITY_SQL}, a AS (SELECT CAST(date_trunc('month', date) AS TIMESTAMP) AS date, entity, sum(n) AS n FROM ev GROUP BY ALL) SELECT px.date, px.entity, px.close, CAST(a.n AS BIGINT) AS ev_n FROM px LEFT JOIN a ON a.date = px.date AND a.entity = px.entity")
def _exact(spark, d) -> DataFrame:
    ev = activity(spark, d).df.groupBy(F.date_trunc("month", "date").cast("timestamp_ntz").alias("date"), "entity").agg(F.sum("n").alias("n"))
    return merge_panels(PanelSet(px=prices(spark, d), ev=Panel(ev)), "px", [Join("ev", "exact", prefix="ev_")], ["close"]).df


_ASOF = "FROM px ASOF LEFT JOIN (SELECT * FROM rep WHERE known IS NOT NULL) r ON px.entity = r.entity AND "


@query("align_asof_entity", REPORTS + f"SELECT px.date, px.entity, px.close, r.total {_ASOF} px.date >= r.known")
def _asof(spark, d) -> DataFrame:
    return merge_panels(PanelSet(px=prices(spark, d), rep=_reports(spark, d)), "px", [Join("rep", "asof_entity", {"availability_column": "known"}, ["total"])], ["close"]).df


@query("align_asof_entity_strict", REPORTS + f"SELECT px.date, px.entity, CASE WHEN px.date - (r.known + INTERVAL 10 DAY) <= INTERVAL 40 DAY THEN r.total END AS total {_ASOF} px.date > r.known + INTERVAL 10 DAY")
def _asof_strict(spark, d) -> DataFrame:
    params = {"availability_column": "known", "lag": "10D", "tolerance": "40D", "allow_exact": False}
    return merge_panels(PanelSet(px=prices(spark, d), rep=_reports(spark, d)), "px", [Join("rep", "asof_entity", params, ["total"])], []).df


@query("align_broadcast_time", PX + f", {MARKET_SQL} SELECT px.date, px.entity, mkt.avg_price AS mkt_avg_price, mkt.n AS orders FROM px LEFT JOIN mkt USING (date)")
def _time(spark, d) -> DataFrame:
    return merge_panels(PanelSet(px=prices(spark, d), mkt=market(spark, d)), "px", [Join("mkt", "broadcast_time", prefix="mkt_", rename={"mkt_n": "orders"}, min_coverage=0.5)], []).df


@query("align_broadcast_time_as_of", PX + f", {MARKET_SQL}, m AS (SELECT * FROM mkt WHERE month(date) % 4 = 0) SELECT px.date, px.entity, CASE WHEN px.date - m.date <= INTERVAL 70 DAY THEN m.avg_price END AS avg_price FROM px ASOF LEFT JOIN m ON px.date >= m.date")
def _time_as_of(spark, d) -> DataFrame:
    mkt = market(spark, d)
    return merge_panels(PanelSet(px=prices(spark, d), mkt=mkt.with_df(mkt.df.filter("month(date) % 4 = 0"))), "px", [Join("mkt", "broadcast_time", {"as_of": True, "tolerance": "70D"}, ["avg_price"])], []).df


@query("align_broadcast_entity", PX + f", {SECTORS_SQL} SELECT px.date, px.entity, region, nation FROM px LEFT JOIN sector s ON s.entity = px.entity")
def _entity(spark, d) -> DataFrame:
    return merge_panels(PanelSet(px=prices(spark, d), sector=sectors(spark, d)), "px", [Join("sector", "broadcast_entity", required=True)], []).df


# linking

_CUST = "c AS (SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS date, o_custkey AS cust, CAST(count(*) AS DOUBLE) AS n, floor(sum(o_totalprice) + 0.5) AS total FROM orders GROUP BY ALL)"


def _customers(spark, d) -> Panel:
    orders = table(spark, d, "orders")
    df = orders.groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("date"), F.col("o_custkey").alias("cust")).agg(F.count("*").cast("double").alias("n"), F.floor(F.sum("o_totalprice") + 0.5).cast("double").alias("total"))
    return Panel(df, entity="cust")


@query("link_key_normalization", "SELECT c_custkey, CASE WHEN length(k) < 6 THEN lpad(k, 6, '0') ELSE k END AS k FROM (SELECT c_custkey, upper(nullif(trim(CASE WHEN c_custkey % 5 = 0 THEN '  ' ELSE ' ' || substr(c_mktsegment, 1, 3 + CAST(c_custkey % 5 AS INTEGER)) || ' ' END), '')) AS k FROM customer)")
def _normalize(spark, d) -> DataFrame:
    raw = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.expr("substr(c_mktsegment, 1, cast(3 + c_custkey % 5 as int))"), F.lit(" "))).alias("k"))
    return normalized(raw, {"k": Normalization(upper=True, zfill=6)})


@query("link_fixed", f"WITH {_CUST} SELECT c.date, k.c_nationkey AS nation, sum(n) AS n, sum(total) AS total FROM c JOIN customer k ON k.c_custkey = c.cust WHERE k.c_custkey % 3 <> 0 GROUP BY ALL")
def _link_fixed(spark, d) -> DataFrame:
    link = LinkTable.fixed(table(spark, d, "customer").filter("c_custkey % 3 <> 0"), ["c_custkey"], "c_nationkey")
    return relink(_customers(spark, d), link, ["cust"], "nation", on_collision="sum").df.select("date", "nation", "n", "total")


_LINKED = f"WITH {_CUST}, j AS (SELECT c.date, c.cust, n, total, k.c_nationkey AS nation FROM c LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) k ON k.c_custkey = c.cust) "


def _relinked(spark, d, unmatched: str, collision: str) -> DataFrame:
    link = LinkTable.fixed(table(spark, d, "customer").filter("c_custkey % 3 <> 0"), ["c_custkey"], "c_nationkey")
    return relink(_customers(spark, d), link, ["cust"], "nation", unmatched, collision).df.select("date", "nation", "n", D4("total"))


@query("link_collision_first", _LINKED + f"SELECT date, nation, n, {d4('total')} FROM j WHERE nation IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date, nation ORDER BY cust) = 1")
def _first(spark, d) -> DataFrame:
    return _relinked(spark, d, "drop", "first")


@query("link_collision_last", _LINKED + f"SELECT date, nation, n, {d4('total')} FROM j WHERE nation IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date, nation ORDER BY cust DESC) = 1")
def _last(spark, d) -> DataFrame:
    return _relinked(spark, d, "drop", "last")


@query("link_keep_unmatched_mean", _LINKED + f"SELECT date, nation, n, {d4('total')} FROM (SELECT date, nation, avg(n) AS n, avg(total) AS total FROM j WHERE nation IS NOT NULL GROUP BY ALL UNION ALL SELECT date, nation, n, total FROM j WHERE nation IS NULL)")
def _kept(spark, d) -> DataFrame:
    return _relinked(spark, d, "keep", "mean")


def _moves(spark, d) -> DataFrame:
    """Customers' nations over time: from each January of 1993 to 1997 on, shifting by the year."""
    years = F.explode(F.sequence(F.lit(1993), F.lit(1997))).alias("y")
    return table(spark, d, "customer").select("c_custkey", "c_nationkey", years).select("c_custkey", ((F.col("c_nationkey") + F.col("y")) % 25).cast("int").alias("nation"), F.make_date("y", F.lit(1), F.lit(1)).cast("timestamp_ntz").alias("from"), (F.make_date("y", F.lit(1), F.lit(1)).cast("timestamp_ntz") + F.expr("interval 500 days")).alias("to"))


_MOVES = "m AS (SELECT c_custkey, CAST((c_nationkey + y) % 25 AS INTEGER) AS nation, make_timestamp(y, 1, 1, 0, 0, 0) AS f, make_timestamp(y, 1, 1, 0, 0, 0) + INTERVAL 500 DAY AS t FROM customer, generate_series(1993, 1997) g(y))"


@query("link_over_time", f"WITH {_CUST}, {_MOVES} SELECT c.date, c.cust, m.nation FROM c ASOF JOIN m ON c.cust = m.c_custkey AND c.date >= m.f")
def _link_steps(spark, d) -> DataFrame:
    link = LinkTable.over_time(_moves(spark, d), ["c_custkey"], "nation", "from")
    return link.resolve(_customers(spark, d).df, ["cust"], "date", "nation").filter("nation is not null").select("date", "cust", "nation")


@query("link_overlaps_first", f"WITH {_CUST}, {_MOVES} SELECT c.date, c.cust, arg_min(m.nation, m.f) AS nation FROM c LEFT JOIN m ON c.cust = m.c_custkey AND c.date BETWEEN m.f AND m.t GROUP BY c.date, c.cust")
def _link_first(spark, d) -> DataFrame:
    link = LinkTable.over_time(_moves(spark, d), ["c_custkey"], "nation", "from", "to", on_ambiguous="first")
    return link.resolve(_customers(spark, d).df, ["cust"], "date", "nation").select("date", "cust", "nation")


@query("link_overlaps_last", f"WITH {_CUST}, {_MOVES} SELECT c.date, c.cust, arg_max(m.nation, m.f) AS nation FROM c LEFT JOIN m ON c.cust = m.c_custkey AND c.date BETWEEN m.f AND m.t GROUP BY c.date, c.cust")
def _link_last(spark, d) -> DataFrame:
    link = LinkTable.over_time(_moves(spark, d), ["c_custkey"], "nation", "from", "to", on_ambiguous="last")
    return link.resolve(_customers(spark, d).df, ["cust"], "date", "nation").select("date", "cust", "nation")


_SPINE_SQL = PX + """, s AS (SELECT DISTINCT date, entity, CAST(entity % 10 + 100 * (CAST(floor((year(date) * 12 + month(date)) / (5 + entity % 3)) AS BIGINT) % 4) AS BIGINT) AS code FROM px WHERE gappy IS NOT NULL),
p AS (SELECT date, dense_rank() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM s)),
g AS (SELECT code, entity, date, i - row_number() OVER (PARTITION BY code, entity ORDER BY i) AS run FROM s JOIN p USING (date)),
r AS (SELECT code, entity, run, min(date) AS valid_from, max(date) AS valid_to FROM g GROUP BY ALL) SELECT code, entity, valid_from, valid_to FROM r"""


@query("link_from_spine", _SPINE_SQL)
def _from_spine(spark, d) -> DataFrame:
    """Codes that wander over suppliers; distinct pairs of code and supplier overlap, so the runs are returned as such."""
    px = prices(spark, d)
    code = (F.col("entity") % 10 + 100 * (F.floor((F.year("date") * 12 + F.month("date")) / (5 + F.col("entity") % 3)) % 4)).cast("long")
    spine = px.with_df(px.df.filter("gappy is not null").withColumns({"code": code, "own": F.struct("entity", code.alias("code"))}))
    out = LinkTable.from_spine(Panel(spine.df.select("date", "own", F.col("code"), F.col("entity").alias("supplier"))  , entity="own"), ["code", "supplier"], close_last=True)
    return out.df.select("code", F.col("own.entity").alias("entity"), "valid_from", "valid_to")


@query("link_report", f"WITH {_CUST}, k AS (SELECT cust, count(*) AS r, count(l.c_custkey) AS m FROM c LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0) l ON l.c_custkey = c.cust GROUP BY cust) SELECT CAST(sum(r) AS BIGINT) AS n_rows, CAST(sum(r - m) AS BIGINT) AS n_unmatched, count(*) AS n_keys, count(*) FILTER (m = 0) AS n_keys_unmatched FROM k")
def _report(spark, d) -> DataFrame:
    link = LinkTable.fixed(table(spark, d, "customer").filter("c_custkey % 3 <> 0"), ["c_custkey"], "c_nationkey")
    return link_report(_customers(spark, d), link, ["cust"])
