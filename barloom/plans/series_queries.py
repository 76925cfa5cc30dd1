"""Registered queries over bar series: bars, indicators, regimes and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.indicators import ALL_FEATURES, Frame, features, swing_marks
from barloom.functions.rounding import rnd
from barloom.operators import regime as rg
from barloom.operators.chunk_scan import chunk_scan
from barloom.series import KEYS, chunk_length, cumulate, number_bars
from barloom.sources.adapters import event_bars, order_bars
from barloom.strategies import base as sb
from barloom.strategies.signals import signals

C = F.col
DIGITS = 5


def shown(df: DataFrame, names: dict[str, str] | list[str], extra: tuple = ()) -> DataFrame:
    pairs = names if isinstance(names, dict) else {n: n for n in names}
    return df.select("symbol", "ts", *extra, *[rnd(C(f"`{n}`"), DIGITS).alias(a) for n, a in pairs.items()])


def _feat(names, source=event_bars):
    keys = list(names)
    return lambda s, d: shown(features(source(s, d), keys), names)


def _swings(s, d):
    f = Frame.of(event_bars(s, d))
    hi, lo = swing_marks(f, "close", 5)
    f.put(swing_high=hi, swing_low=lo)
    return f.own().select("symbol", "ts", "swing_high", "swing_low")


def _swing_state(s, d):
    f = Frame.of(event_bars(s, d))
    f.need("PIVOTH_5"), f.need("PIVOTL_5")
    f.ffill("last_high", "PIVOTH_5"), f.ffill("last_low", "PIVOTL_5")
    return shown(f.own(), ["last_high", "last_low"])


def _obv(s, d):
    """Cumulative signed volume with a carry per chunk, and its five-bar mean."""
    f = Frame.of(event_bars(s, d))
    f.need("SVOL")
    x = f.own().withColumn("_blk", F.expr(f"bar_no div {f.chunk_rows}"))
    x = cumulate(x, KEYS, "_blk", ["bar_no"], {"obv": ("sum", C("SVOL"))}).drop("_blk")
    g = Frame.of(x)
    g.put(obv_mean=F.avg("obv").over(g.rows(5)))
    return shown(g.own(), ["obv", "obv_mean"])


def _machine(name: str, cols: dict[str, str]):
    """State lines of a stateful indicator."""
    def run(s, d):
        st = sb.get(name)
        p = st.params()
        n = number_bars(event_bars(s, d))
        f = Frame.of(n)
        for c in st.inputs(p):
            f.need(c)
        fields = [T.StructField("signal", T.LongType())] + [
            T.StructField(c, T.LongType() if c == "side" else T.DoubleType()) for c in cols if c != "signal"]
        out = chunk_scan(f.df, st.kernel(p), fields, ["symbol", "timeframe", "ts", "bar_no"], KEYS)
        return shown(out, cols)
    return run


def _warmup_zeroed(s, d):
    x = features(event_bars(s, d), ["CHANGE"])
    sig = F.when(C("CHANGE") > 0, 1).when(C("CHANGE") < 0, -1).otherwise(0)
    return x.select("symbol", "ts", F.when(C("bar_no") < 19, 0).otherwise(sig).alias("signal"))


def _components(s, d):
    f = rg.components(Frame.of(event_bars(s, d), lookback=900))
    return shown(f.own(), list(rg.COMPONENTS))


def _scores(s, d):
    f = rg.scores(Frame.of(event_bars(s, d), lookback=900))
    f.put(ann=C("adx_norm"), amid=C("adx_mid"))
    return shown(f.own(), {**{c: c for c in rg.SCORES}, "adx_norm": "adx_norm", "adx_mid": "adx_mid",
                           "regime_strength": "regime_strength", "regime_gap": "regime_gap"}, ("regime_raw", "regime_warmup"))


def _regimes(s, d):
    return rg.regimes(event_bars(s, d)).select("symbol", "ts", "bar_no", "regime_raw", "regime", "regime_live")


def _regime_params(s, d):
    series = event_bars(s, d, "H1").select("symbol", "timeframe").distinct()
    over = s.createDataFrame([("view", "H1", 4, 0.2, 6)], "symbol string, timeframe string, k_confirm int, gap_min double, k_hold int")
    return rg.resolve_params(series, over)


QUERIES = {
    "bars_h1": lambda s, d: event_bars(s, d).select("symbol", "ts", "open", "high", "low", "close", "volume"),
    "bars_daily_orders": lambda s, d: order_bars(s, d).select("symbol", "ts", "open", "high", "low", "close", "volume"),
    "true_range": _feat(["TR"]),
    "atr": _feat([f"ATR_{n}" for n in (7, 10, 14, 20)]),
    "sma": _feat([f"SMA_{n}" for n in (5, 8, 10, 13, 20, 21, 30, 50, 100, 200)]),
    "ema": _feat([f"EMA_{n}" for n in (5, 8, 10, 13, 20, 21, 30, 50, 100, 200)]),
    "rsi": _feat(["RSI_7", "RSI_14", "RSI_21"]),
    "bollinger": _feat(["BB_MID_20", "BB_UPPER_20", "BB_LOWER_20"]),
    "macd": _feat(["MACD", "MACD_SIGNAL", "MACD_HIST"]),
    "stochastic": _feat(["STOCH_K", "STOCH_D"]),
    "adx_core": _feat(["ADX"]),
    "directional_core": _feat(["PLUS_DI", "MINUS_DI"]),
    "adx_smoothed": _feat(["WADX_14", "WPDI_14", "WMDI_14"]),
    "adx_seeded": _feat(["SADX_14"]),
    "cci": _feat(["CCI"]),
    "williams_r": _feat(["WILLR"]),
    "donchian": _feat(["DONCHIAN_HIGH_20", "DONCHIAN_LOW_20", "DONCHIAN_HIGH_50", "DONCHIAN_LOW_50"]),
    "keltner": _feat(["KC_MID", "KC_UPPER", "KC_LOWER"]),
    "hull_ma": _feat(["HULL_MA"]),
    "price_change": _feat(["CHANGE", "CHANGE_PCT", "VOLATILITY"]),
    "swing_points": _swings,
    "swing_state": _swing_state,
    "percentile_rank": _feat({"PCTRANK_ROC_10_100": "ROC_RANK", "PCTRANK_ATR_14_100": "ATR_RANK"}),
    "vortex": _feat(["VIP_14", "VIM_14"]),
    "trix": _feat(["TRIX_12_9", "TRIXSIG_12_9"]),
    "elder_power": _feat(["BULL_13_1", "BEAR_13_1", "BULL_13_3", "BEAR_13_3"]),
    "aroon": _feat(["AROONU_25", "AROOND_25"]),
    "fisher": _feat(["FISHER_10"]),
    "vwap_zscore": _feat(["VWAP_50", "VWAPZ_50_50"]),
    "stoch_rsi": _feat({"STOCHRSIK_14_14_3_3": "K", "STOCHRSID_14_14_3_3": "D"}),
    "obv": _obv,
    "parabolic_sar": _machine("ParabolicSARTrendStrategy", {"psar": "psar", "signal": "signal"}),
    "kaufman_ama": _feat(["KAMA_10_2_30"]),
    "ichimoku": _feat({f"{k}_9_26_52": k for k in ("TENKAN", "KIJUN", "SENKOUA", "SENKOUB")}),
    "supertrend": _machine("SupertrendStrategy", {"upper": "upper", "lower": "lower", "side": "side", "signal": "signal"}),
    "feature_subset": _feat(["ATR_14", "EMA_50", "KC_UPPER", "DONCHIAN_HIGH_20"], order_bars),
    "feature_table": _feat(ALL_FEATURES),
    "warmup_zeroed": _warmup_zeroed,
    "helper_columns": _feat({n: n.replace(".", "p") for n in (
        "EMA_7", "SMA_7", "ATR_9", "RSI_9", "HULL_9", "BBU_10_1.5", "BBL_10_1.5", "STOCHK_5", "STOCHD_5_5", "MACD_8_21_7",
        "MACDHIST_8_21_7")}),
    "regime_components": _components,
    "regime_scores": _scores,
    "regime_hysteresis": _regimes,
    "regime_params": _regime_params,
}


def _signal_query(name: str):
    def run(s, d):
        x = signals(event_bars(s, d), [name])
        return x.select("symbol", "ts", "bar_no", "strategy_name", "param_hash", "signal")
    return run


def signal_key(name: str) -> str:
    return f"signals_{name.removesuffix('Strategy')}"


SIGNALS = {signal_key(n): _signal_query(n) for n in sb.names()}
QUERIES |= SIGNALS
