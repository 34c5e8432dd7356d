"""Feature types on random panels with holes, against pandas and plain loops, and properties that all must have."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

from panelwright.feature_queries import CASES
from panelwright.functions.ewm import Ewm, add_along
from panelwright.operators.features import REGISTRY, Feature, FeatureError
from panelwright.panel import Panel
from panelwright.plans.feature_plan import FeaturePipeline, Selection, add_features

COLUMNS = ["open", "high", "low", "close", "volume", "dollar_volume", "shares", "gappy"]


def random_panel(seed=0, entities=4, days=30) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    rows = []
    for e in range(entities):
        price = 100.0
        for k in range(days if e else 1):  # entity 0 has one row
            if rng.random() < 0.1:
                continue  # a date gap
            price *= math.exp(rng.normal(0, 0.05))
            high, low = price * 1.02, price * 0.97
            if k % 7 == 3:
                high = low = price  # a flat bar
            rows.append((dt.datetime(2020, 1, 1) + dt.timedelta(days=k), e, price * rng.uniform(0.98, 1.01), high, low, price, float(rng.integers(0, 50)), float(rng.integers(0, 5000)), 1000.0 + e, price if rng.random() > 0.2 else None))
    df = pd.DataFrame(rows, columns=["date", "entity", *COLUMNS])
    df.loc[df.index[5], "gappy"] = 0.0
    return df


def to_panel(spark, df: pd.DataFrame) -> Panel:
    rows = [tuple(None if isinstance(v, float) and math.isnan(v) else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in r) for r in df.itertuples(index=False)]
    kinds = ", ".join(f"{c} double" for c in df.columns[2:])
    return Panel(spark.createDataFrame(rows, f"date timestamp_ntz, entity long, {kinds}"))


def values(panel: Panel) -> pd.DataFrame:
    return panel.df.toPandas().sort_values(["entity", "date"]).reset_index(drop=True)


def by_entity(df, f):
    return df.groupby("entity", group_keys=False)[df.columns.tolist()].apply(f).sort_index()


@pytest.fixture(scope="module")
def frame():
    return random_panel().sort_values(["entity", "date"]).reset_index(drop=True)


ROLLS = [("mean", {}), ("std", {"ddof": 0}), ("var", {"ddof": 1}), ("sum", {}), ("min", {}), ("max", {}), ("median", {}), ("quantile", {"quantile": 0.3})]


def test_rolling_reducers_match_pandas(spark, frame):
    specs = [("rolling_aggregation", {"input_column": "gappy", "windows": [5], "output_names": [f"r_{how}"], "how": how, "min_periods": 9, **kw}) for how, kw in ROLLS]
    got = values(add_features(to_panel(spark, frame), *specs))
    for how, kw in ROLLS:
        want = frame.groupby("entity")["gappy"].transform(lambda x, how=how, kw=kw: getattr(x.rolling(5, min_periods=5), how)(*([kw["quantile"]] if "quantile" in kw else []), **({"ddof": kw["ddof"]} if "ddof" in kw else {})))
        np.testing.assert_allclose(got[f"r_{how}"], want, rtol=1e-7, atol=1e-9, err_msg=how)


def test_skew_and_kurt_match_pandas(spark, frame):
    got = values(add_features(to_panel(spark, frame), *[("rolling_aggregation", {"input_column": "close", "windows": [8], "output_names": [h], "how": h, "min_periods": 4}) for h in ("skew", "kurt")]))
    for how in ("skew", "kurt"):
        want = frame.groupby("entity")["close"].transform(lambda x, how=how: getattr(x.rolling(8, min_periods=4), how)())
        np.testing.assert_allclose(got[how], want, rtol=1e-5, atol=1e-6)


@pytest.mark.parametrize("adjust", [True, False])
def test_ewm_matches_pandas(spark, adjust):
    rng = np.random.default_rng(3)
    # batches of 50 rows: entities go on over several of them, or share one
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        rows = [(e, k, None if rng.random() < 0.3 else float(rng.normal())) for e, n in enumerate((1, 5, 60, 300, 2, 3, 120)) for k in range(n)] + [(None, 0, 1.0), (None, 1, 3.0)]
        specs = {f"{how}{least}": Ewm("x", 0.3, adjust, least, how) for how in ("mean", "var", "std") for least in (1, 4)}
        got = add_along(spark.createDataFrame(rows, "e int, k int, x double").repartition(3), specs, "k", "e").toPandas().sort_values(["e", "k"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    for _, part in got.groupby("e", dropna=False):
        for name, spec in specs.items():
            ewm = part["x"].reset_index(drop=True).ewm(alpha=0.3, adjust=adjust, ignore_na=False, min_periods=spec.least)
            np.testing.assert_allclose(part[name], getattr(ewm, spec.how)(), rtol=1e-9)


def test_cross_sections_match_pandas(spark, frame):
    frame = frame.assign(volume=(frame["volume"] % 4))  # ties
    specs = [("cross_sectional_rank", {"input_columns": ["volume"], "output_names": [f"r_{m}"], "method": m, "ascending": True, "scaling": "raw"}) for m in ("average", "min", "max", "dense")]
    specs += [("cross_sectional_zscore", {"input_columns": ["gappy"], "output_names": ["z"], "ddof": 1}), ("cross_sectional_winsorize", {"input_columns": ["gappy"], "output_names": ["w"], "lower": 0.1, "upper": 0.8}), ("cross_sectional_bucket", {"input_columns": ["gappy"], "output_names": ["b"], "n_buckets": 3})]
    got = values(add_features(to_panel(spark, frame), *specs))
    g = frame.groupby("date")
    for m in ("average", "min", "max", "dense"):
        np.testing.assert_allclose(got[f"r_{m}"], g["volume"].rank(method=m))
    spread = g["gappy"].transform(lambda x: x.std(ddof=1))
    np.testing.assert_allclose(got["z"], ((frame["gappy"] - g["gappy"].transform("mean")) / spread).where(spread > 0), rtol=1e-9)
    lo, hi = g["gappy"].transform(lambda x: x.quantile(0.1)), g["gappy"].transform(lambda x: x.quantile(0.8))
    np.testing.assert_allclose(got["w"], frame["gappy"].clip(lo, hi))
    np.testing.assert_allclose(got["b"], np.ceil(g["gappy"].rank(pct=True) * 3).clip(1, 3))


def test_drawdown_aroon_rank_by_loops(spark, frame):
    specs = [("max_drawdown", {"close_column": "gappy", "windows": [4], "output_names": ["dd"]}), ("ulcer_index", {"close_column": "close", "windows": [4], "output_names": ["ui"]}), ("aroon", {"high_column": "close", "low_column": "low", "window": 5, "output_names": ["up", "down", "osc"]}), ("rolling_rank", {"input_column": "gappy", "windows": [6], "output_names": ["rk"], "min_periods": 2, "method": "average"})]
    got = values(add_features(to_panel(spark, frame), *specs))
    for _, rows in frame.groupby("entity"):
        for at in range(len(rows)):
            i = rows.index[at]
            win = rows["gappy"].iloc[max(0, at - 3) : at + 1].to_numpy()
            full = len(win) == 4 and not np.isnan(win).any() and np.maximum.accumulate(win).min() > 0
            want = (1 - win / np.maximum.accumulate(win)).max() if full else np.nan
            np.testing.assert_allclose(got["dd"][i], want, rtol=1e-9)
            win = rows["close"].iloc[max(0, at - 3) : at + 1].to_numpy()
            np.testing.assert_allclose(got["ui"][i], np.sqrt(np.mean((100 * (1 - win / np.maximum.accumulate(win))) ** 2)) if len(win) == 4 else np.nan, rtol=1e-9)
            win = rows["close"].iloc[max(0, at - 4) : at + 1].to_numpy()
            np.testing.assert_allclose(got["up"][i], 100 * (5 - np.argmax(win[::-1])) / 5 if len(win) == 5 else np.nan)
            win = rows["gappy"].iloc[max(0, at - 5) : at + 1].dropna()
            want = win.rank(pct=True).iloc[-1] if not math.isnan(rows["gappy"].iloc[at]) and len(win) >= 2 else np.nan
            np.testing.assert_allclose(got["rk"][i], want)


def everything() -> list[tuple[str, dict]]:
    """All types at once, with outputs renamed apart."""
    out, done = [], set()
    for name, (specs, _, _) in CASES.items():
        for k, (kind, params) in enumerate(specs):
            params = dict(params)
            for key in ("output_name", "k_name", "d_name"):
                if key in params:
                    params[key] = f"{name}_{k}_{params[key]}"
            for key in ("output_names", "pct_b_names", "bandwidth_names"):
                if key in params:
                    params[key] = [o if o == "ret" else f"{name}_{k}_{o}" for o in params[key]]
            if params.get("output_names") == ["ret"]:
                if "ret" in done:
                    continue
                done.add("ret")
            if "group_column" in params:
                params["group_column"] = "shares"
            out.append((kind, params))
    return out


def test_all_types_in_one_plan_and_future_rows_change_nothing(spark):
    assert set(CASES) == set(REGISTRY) and len(REGISTRY) == 65
    df = random_panel(4, entities=3, days=24)
    cut = df["date"].max() - pd.Timedelta(days=4)
    full = values(add_features(to_panel(spark, df.sample(frac=1, random_state=1)), *everything()))
    past = values(add_features(to_panel(spark, df[df["date"] <= cut]), *everything()))
    full = full[full["date"] <= cut].reset_index(drop=True)
    assert not np.isinf(full.select_dtypes("number").to_numpy(dtype=float)).any()
    looks_ahead = ("forward_returns", "temporal_shift", "roll_spread", "kyle_lambda")
    for c in past.columns:
        if not c.startswith(looks_ahead) and c not in ("date", "entity"):
            np.testing.assert_allclose(full[c], past[c], rtol=1e-7, atol=1e-8, err_msg=c)


def test_entities_do_not_touch(spark):
    df = random_panel(5, entities=3, days=20)
    across = ("cross_sectional", "group_neutralize")
    specs = [s for s in everything() if not s[0].startswith(across)]
    both, one = values(add_features(to_panel(spark, df), *specs)), values(add_features(to_panel(spark, df[df["entity"] == 2]), *specs))
    pd.testing.assert_frame_equal(both[both["entity"] == 2].reset_index(drop=True), one, rtol=1e-9)


def test_pipeline_refuses_what_can_not_work(spark, frame):
    lp = {"input_column": "close", "output_name": "a"}
    with pytest.raises(FeatureError, match="unknown feature"):
        Feature("nope", {})
    with pytest.raises(FeatureError):
        Feature("log_price", {"input_column": "close"})
    with pytest.raises(FeatureError, match="distinct"):
        Feature("simple_returns", {"input_column": "close", "horizons": [1, 2], "output_names": ["a", "a"]})
    with pytest.raises(FeatureError, match="number"):
        Feature("simple_returns", {"input_column": "close", "horizons": [1, 2], "output_names": ["a"]})
    with pytest.raises(FeatureError, match="produced by both"):
        FeaturePipeline((Feature("log_price", lp), Feature("log_price", lp)))
    with pytest.raises(FeatureError, match="before"):
        FeaturePipeline((Feature("log_price", {"input_column": "a", "output_name": "b"}), Feature("log_price", lp)))
    with pytest.raises(FeatureError, match="intermediate"):
        FeaturePipeline((Feature("log_price", lp),), intermediate=frozenset({"a"}))
    with pytest.raises(FeatureError, match="already"):
        add_features(to_panel(spark, frame), ("log_price", {"input_column": "close", "output_name": "open"}))
    with pytest.raises(FeatureError, match="missing"):
        add_features(to_panel(spark, frame), ("log_price", {"input_column": "absent", "output_name": "x"}))
    with pytest.raises(KeyError):
        Selection(("x",)).of(["y"])


def test_nan_and_infinity_are_missing(spark):
    rows = [(dt.datetime(2020, 1, 1 + i), 1, v) for i, v in enumerate([1.0, float("nan"), 2.0, float("inf"), 4.0])]
    panel = Panel(spark.createDataFrame(rows, "date timestamp_ntz, entity long, x double"))
    got = values(add_features(panel, ("rolling_aggregation", {"input_column": "x", "windows": [5], "output_names": ["m"], "how": "mean", "min_periods": 1}), ("simple_returns", {"input_column": "x", "horizons": [1], "output_names": ["r"]})))
    np.testing.assert_allclose(got["m"], [1, 1, 1.5, 1.5, 7 / 3])
    assert got["r"].isna().all()
    assert add_features(panel.with_df(panel.df.limit(0)), ("rsi", {"close_column": "x", "periods": [3], "output_names": ["q"], "min_periods": 1})).df.count() == 0


def test_layers_share_one_exchange(spark, frame):
    specs = [("log_returns", {"input_column": "close", "horizons": [1], "output_names": ["r"]}), ("realized_volatility", {"return_column": "r", "windows": [5, 9], "output_names": ["v", "w"], "min_periods": 2}), ("linear_trend_slope", {"input_column": "close", "windows": [4], "output_names": ["s"], "use_log": False})]
    plan = add_features(to_panel(spark, frame), *specs).df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(entity") == 1
