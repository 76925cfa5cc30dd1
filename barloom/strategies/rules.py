"""Rules expressed as window conditions on a chunked frame."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from barloom.functions.indicators import swing_marks
from barloom.strategies.base import (
    BREAKOUT, REVERSION, TREND, Strategy, crosses_down, crosses_up, falls_under, register, rises_over, yes,
)

C = F.col


# Names, defaults and grids of all rules below are part of the interface.

def _add(name, category, defaults, grid, rule, recursive=lambda p: (), warmup=lambda p: 0, sl=2.0, tp=3.0):
    register(Strategy(name, category, {**defaults, "sl_atr_mult": sl, "tp_atr_mult": tp}, grid, rule=rule,
                      recursive=recursive, warmup=warmup))


def _di(period: int) -> tuple[str, str, str]:
    """ADX and DI columns: the simple-mean set at 14, the exponentially weighted set otherwise."""
    return ("ADX_14", "PLUSDI_14", "MINUSDI_14") if period == 14 else tuple(f"W{k}_{period}" for k in ("ADX", "PDI", "MDI"))


def _di_rec(period: int) -> tuple[str, ...]:
    return () if period == 14 else _di(period)


# ---- trend -----------------------------------------------------------------------------------------------------------

def ema_crossover(f, p):
    a, b = f"EMA_{p['fast_period']}", f"EMA_{p['slow_period']}"
    return crosses_up(f, a, b), crosses_down(f, a, b)


_add("EMACrossoverStrategy", TREND, {"fast_period": 10, "slow_period": 20},
     {"fast_period": [5, 8, 10, 13, 15], "slow_period": [20, 26, 30, 40, 50]}, ema_crossover,
     lambda p: (f"EMA_{p['fast_period']}", f"EMA_{p['slow_period']}"))


def _macd_key(p) -> str:
    return f"{p['fast_period']}_{p['slow_period']}_{p['signal_period']}"


def macd_trend(f, p):
    a, b = f"MACD_{_macd_key(p)}", f"MACDSIG_{_macd_key(p)}"
    return crosses_up(f, a, b), crosses_down(f, a, b)


_add("MACDTrendStrategy", TREND, {"fast_period": 12, "slow_period": 26, "signal_period": 9},
     {"fast_period": [8, 10, 12, 16], "slow_period": [21, 26, 30, 34], "signal_period": [7, 9, 12]}, macd_trend,
     lambda p: (f"MACD_{_macd_key(p)}", f"MACDSIG_{_macd_key(p)}"))


def adx_trend(f, p):
    n, th = p["adx_period"], p["adx_threshold"]
    f.need("UP")
    down = -C("DLOW")
    f.put(_ATPDM=F.when((C("UP") > down) & (C("UP") > 0), C("UP")).otherwise(0.0))
    f.put(_ATMDM=F.when((down > C("_ATPDM")) & (down > 0), down).otherwise(0.0))
    atr = F.nullif(f.need(f"ATR_{n}"), F.lit(0.0))
    plus, minus, adx = f"_ATP_{n}", f"_ATM_{n}", f"_ATX_{n}"
    f.put(**{plus: 100 * (f.full(F.avg, C("_ATPDM"), n) / atr), minus: 100 * (f.full(F.avg, C("_ATMDM"), n) / atr)})
    f.put(**{f"_ATDX_{n}": 100 * F.abs(C(plus) - C(minus)) / (C(plus) + C(minus) + 1e-10)})
    f.put(**{adx: f.full(F.avg, C(f"_ATDX_{n}"), n)})
    strong = C(adx) > th
    return crosses_up(f, plus, minus) & strong, crosses_up(f, minus, plus) & strong


_add("ADXTrendStrategy", TREND, {"adx_period": 14, "adx_threshold": 25},
     {"adx_period": [7, 10, 14, 20, 25], "adx_threshold": [15, 20, 25, 30, 35]}, adx_trend)


def ichimoku(f, p):
    key = f"{p['tenkan_period']}_{p['kijun_period']}_{p['senkou_b_period']}"
    t, k = f"TENKAN_{key}", f"KIJUN_{key}"
    a, b = f.need(f"SENKOUA_{key}"), f.need(f"SENKOUB_{key}")
    return (crosses_up(f, t, k) & (C("close") > F.greatest(a, b)),
            crosses_down(f, t, k) & (C("close") < F.least(a, b)))


_add("IchimokuStrategy", TREND, {"tenkan_period": 9, "kijun_period": 26, "senkou_b_period": 52},
     {"tenkan_period": [7, 9, 12, 15, 18], "kijun_period": [18, 22, 26, 30, 34]}, ichimoku)


def _turns(f, name: str):
    f.need(name)
    slope = f"SLOPE_{name}"
    f.put(**{slope: C(name) - f.lag(name)})
    return rises_over(f, slope, 0), falls_under(f, slope, 0)


def hull_trend(f, p):
    return _turns(f, f"HULL_{p['period']}")


_add("HullMATrendStrategy", TREND, {"period": 20}, {"period": [9, 14, 20, 30, 50]}, hull_trend)


def aroon_trend(f, p):
    u, d, s = f"AROONU_{p['period']}", f"AROOND_{p['period']}", p["strength_level"]
    return crosses_up(f, u, d) & (f.need(u) > s), crosses_up(f, d, u) & (f.need(d) > s)


_add("AroonTrendStrategy", TREND, {"period": 25, "strength_level": 70},
     {"period": [14, 20, 25, 30, 50], "strength_level": [50, 60, 70, 80, 90]}, aroon_trend)


def adx_di_strength(f, p):
    adx, up, dn = _di(p["adx_period"])
    strong = f.need(adx) > p["adx_threshold"]
    if p["require_adx_rising"]:
        strong = strong & (f.need(adx) > f.lag(adx))
    gap = f.need(up) - f.need(dn)
    return (crosses_up(f, up, dn) & strong & (gap > p["di_spread_min"]),
            crosses_up(f, dn, up) & strong & (-gap > p["di_spread_min"]))


_add("ADXDIStrengthStrategy", TREND,
     {"adx_period": 14, "adx_threshold": 20, "di_spread_min": 5.0, "require_adx_rising": True},
     {"adx_period": [7, 10, 14, 20], "adx_threshold": [15, 20, 25, 30], "di_spread_min": [0.0, 5.0, 10.0, 15.0],
      "require_adx_rising": [True, False]}, adx_di_strength, lambda p: _di_rec(p["adx_period"]))


def keltner_pullback(f, p):
    mid, k = f"EMA_{p['kc_period']}", p["ema_slope_bars"]
    m, c = f.need(mid), C("close")
    return ((m > f.lag(mid, k)) & (c > m) & (f.lag("low") <= f.lag(mid)) & (c > f.lag("close")),
            (m < f.lag(mid, k)) & (c < m) & (f.lag("high") >= f.lag(mid)) & (c < f.lag("close")))


_add("KeltnerPullbackStrategy", TREND, {"kc_period": 20, "kc_mult": 2.0, "ema_slope_bars": 5},
     {"kc_period": [10, 15, 20, 25, 30], "kc_mult": [1.0, 1.5, 2.0, 2.5], "ema_slope_bars": [3, 5, 8, 10]},
     keltner_pullback, lambda p: (f"EMA_{p['kc_period']}",))


def ema_ribbon(f, p):
    a, b, c = (f.need(f"EMA_{p[k]}") for k in ("ema_fast", "ema_mid", "ema_slow"))
    adx, up, dn = _di(p["adx_period"])
    strong = f.need(adx) > p["adx_threshold"]
    long, short = (a > b) & (b > c) & strong, (a < b) & (b < c) & strong
    if p["use_di_confirmation"]:
        long, short = long & (f.need(up) > f.need(dn)), short & (f.need(dn) > f.need(up))
    on_l, on_s = f.own_name("RIBL"), f.own_name("RIBS")
    f.put(**{on_l: yes(long), on_s: yes(short)})
    return C(on_l) & ~yes(f.lag(on_l)), C(on_s) & ~yes(f.lag(on_s))


_add("EMARibbonADXStrategy", TREND,
     {"ema_fast": 8, "ema_mid": 21, "ema_slow": 50, "adx_period": 14, "adx_threshold": 20, "use_di_confirmation": True},
     {"ema_fast": [5, 8, 10, 13, 15], "ema_mid": [20, 25, 30, 35], "ema_slow": [50, 100, 150, 200],
      "adx_threshold": [15, 20, 25, 30], "adx_period": [10, 14, 20], "use_di_confirmation": [True, False]}, ema_ribbon,
     lambda p: tuple(f"EMA_{p[k]}" for k in ("ema_fast", "ema_mid", "ema_slow")) + _di_rec(p["adx_period"]))


def ema_pullback(f, p):
    a, b, atr = f.need(f"EMA_{p['fast_period']}"), f.need(f"EMA_{p['slow_period']}"), f.need("ATR_14")
    reach = p["touch_atr"] * atr
    return ((a > b) & (C("low") <= a + reach) & (C("close") > a), (a < b) & (C("high") >= a - reach) & (C("close") < a))


_add("EMAPullbackContinuationStrategy", TREND, {"fast_period": 10, "slow_period": 30, "touch_atr": 0.5},
     {"fast_period": [8, 10, 13], "slow_period": [20, 30, 50], "touch_atr": [0.3, 0.5, 0.7]}, ema_pullback,
     lambda p: (f"EMA_{p['fast_period']}", f"EMA_{p['slow_period']}"))


def kaufman_trend(f, p):
    name = f"KAMA_{p['er_period']}_{p['fast_period']}_{p['slow_period']}"
    if p["signal_mode"] == "crossover":
        f.put(**{f"OVER_{name}": yes(C("close") > f.need(name))})
        was = yes(f.lag(f"OVER_{name}"))
        return C(f"OVER_{name}") & ~was, ~C(f"OVER_{name}") & was
    return _turns(f, name)


_add("KaufmanAMATrendStrategy", TREND, {"er_period": 10, "fast_period": 2, "slow_period": 30, "signal_mode": "direction"},
     {"er_period": [5, 10, 20], "fast_period": [2, 3], "slow_period": [20, 30, 50],
      "signal_mode": ["direction", "crossover"]}, kaufman_trend,
     lambda p: (f"KAMA_{p['er_period']}_{p['fast_period']}_{p['slow_period']}",))


def vortex_trend(f, p):
    n, gap = p["vortex_period"], p["min_vi_spread"]
    name = f"VISPREAD_{n}"
    f.put(**{name: f.need(f"VIP_{n}") - f.need(f"VIM_{n}")})
    long, short = rises_over(f, name, gap), falls_under(f, name, -gap)
    if p["use_ema_filter"]:
        ema = f.need(f"EMA_{p['ema_filter_period']}")
        long, short = long & (C("close") > ema), short & (C("close") < ema)
    if p["use_adx_filter"]:
        strong = f.need("ADX_14") > p["adx_threshold"]
        long, short = long & strong, short & strong
    return long, short


_add("VortexTrendStrategy", TREND,
     {"vortex_period": 14, "min_vi_spread": 0.03, "use_ema_filter": False, "ema_filter_period": 100,
      "use_adx_filter": False, "adx_threshold": 22},
     {"vortex_period": [10, 14, 21, 28, 34], "min_vi_spread": [0.0, 0.03, 0.06, 0.09], "use_ema_filter": [False, True],
      "ema_filter_period": [50, 100, 200], "use_adx_filter": [False, True], "adx_threshold": [18, 22, 28]}, vortex_trend,
     lambda p: (f"EMA_{p['ema_filter_period']}",) if p["use_ema_filter"] else (), lambda p: p["vortex_period"] + 5)


def elder_ray(f, p):
    bull, bear = (f"{k}_{p['ema_period']}_{p['power_smooth']}" for k in ("BULL", "BEAR"))
    if p["entry_mode"] == "threshold_cross":
        k = p["threshold_atr_norm"]
        th, was = k * f.need("ATR_14"), k * f.lag("ATR_14")
        long = (f.need(bear) > -th) & (f.lag(bear) <= -was)
        short = (f.need(bull) < th) & (f.lag(bull) >= was)
    else:
        long, short = rises_over(f, bear, 0), falls_under(f, bull, 0)
    if p["require_ema_trend"]:
        t = f"EMA_{p['trend_ema_period']}"
        long, short = long & (f.need(t) > f.lag(t)), short & (f.need(t) < f.lag(t))
    return long, short


_add("ElderRayBullBearStrategy", TREND,
     {"ema_period": 13, "entry_mode": "zero_cross", "threshold_atr_norm": 0.2, "require_ema_trend": True,
      "trend_ema_period": 100, "power_smooth": 1},
     {"ema_period": [10, 13, 20, 26, 34], "entry_mode": ["zero_cross", "threshold_cross"],
      "threshold_atr_norm": [0.0, 0.2, 0.4, 0.6], "require_ema_trend": [False, True],
      "trend_ema_period": [50, 100, 200], "power_smooth": [1, 3]}, elder_ray,
     lambda p: (f"BULL_{p['ema_period']}_{p['power_smooth']}", f"BEAR_{p['ema_period']}_{p['power_smooth']}")
     + ((f"EMA_{p['trend_ema_period']}",) if p["require_ema_trend"] else ()),
     lambda p: max(p["ema_period"], p["trend_ema_period"] if p["require_ema_trend"] else 0) + 5)


def _divergence(f, osc: str, order: int):
    """Price extreme beyond the previous one within 5*order bars while the oscillator disagrees.

    Both are compared on the bars that confirm the pivots.
    """
    hi, lo = swing_marks(f, "close", order)
    ready = C("bar_no") >= 2 * order + 1
    x = f.need(osc)
    w = f.rows(5 * order, -1)
    was = lambda mark: F.last(F.when(mark, F.struct(C("close").alias("c"), x.alias("x"))), ignorenulls=True).over(w)
    f.put(**{f"_DIVL_{osc}_{order}": was(lo), f"_DIVH_{osc}_{order}": was(hi)})
    pl, ph = C(f"_DIVL_{osc}_{order}"), C(f"_DIVH_{osc}_{order}")
    return (ready & lo & (C("close") < pl["c"]) & (x > pl["x"]), ready & hi & (C("close") > ph["c"]) & (x < ph["x"]))


def rsi_divergence(f, p):
    return _divergence(f, f"RSI_{p['rsi_period']}", p["swing_order"])


_add("RSIDivergenceStrategy", REVERSION, {"rsi_period": 14, "swing_order": 5},
     {"rsi_period": [7, 14, 21], "swing_order": [3, 5, 7]}, rsi_divergence, lambda p: (f"RSI_{p['rsi_period']}",), tp=2.5)


def macd_divergence(f, p):
    return _divergence(f, f"MACDHIST_{p['macd_fast']}_{p['macd_slow']}_9", p["swing_order"])


_add("MACDDivergenceStrategy", REVERSION, {"swing_order": 5, "macd_fast": 12, "macd_slow": 26},
     {"swing_order": [3, 5, 7], "macd_fast": [8, 12], "macd_slow": [21, 26]}, macd_divergence,
     lambda p: (f"MACDHIST_{p['macd_fast']}_{p['macd_slow']}_9",), tp=2.5)


def obv_divergence(f, p):
    """Only differences of OBV decide, so a chunk-local running sum gives the same answer as the series total.

    The one exception, the shorter smoothing window of the first bars, lies in the first chunk.
    """
    k = p["obv_smooth"]
    f.need("SVOL")
    f.put(OBV_LOCAL=F.sum("SVOL").over(f.part.rowsBetween(Window.unboundedPreceding, 0)))
    name = "OBV_LOCAL"
    if k > 0:
        name = f"OBV_LOCAL_{k}"
        f.put(**{name: F.avg("OBV_LOCAL").over(f.rows(k))})
    return _divergence(f, name, p["swing_order"])


_add("OBVDivergenceStrategy", TREND, {"swing_order": 5, "obv_smooth": 5},
     {"swing_order": [3, 5, 7], "obv_smooth": [0, 5, 10]}, obv_divergence, tp=2.5)


# ---- mean reversion --------------------------------------------------------------------------------------------------

def rsi_extremes(f, p):
    r = f"RSI_{p['rsi_period']}"
    return rises_over(f, r, p["oversold"]), falls_under(f, r, p["overbought"])


_add("RSIExtremesStrategy", REVERSION, {"rsi_period": 14, "oversold": 30, "overbought": 70},
     {"rsi_period": [5, 7, 10, 14, 21], "oversold": [15, 20, 25, 30], "overbought": [70, 75, 80, 85]}, rsi_extremes,
     lambda p: (f"RSI_{p['rsi_period']}",), tp=2.0)


def bollinger_bounce(f, p):
    n, k = p["period"], float(p["std_dev"])
    lower, upper = f.need(f"BBL_{n}_{k}"), f.need(f"BBU_{n}_{k}")
    return ((C("low") <= lower) & (C("close") > f.lag("close")), (C("high") >= upper) & (C("close") < f.lag("close")))


_add("BollingerBounceStrategy", REVERSION, {"period": 20, "std_dev": 2.0},
     {"period": [10, 15, 20, 25, 30], "std_dev": [1.5, 1.75, 2.0, 2.25, 2.5]}, bollinger_bounce, tp=2.0)


def zscore_reversion(f, p):
    z = f"ZSCORE_{p['period']}"
    return rises_over(f, z, -p["entry_z"]), falls_under(f, z, p["entry_z"])


_add("ZScoreMRStrategy", REVERSION, {"period": 20, "entry_z": 2.0},
     {"period": [10, 15, 20, 30, 40], "entry_z": [1.5, 1.75, 2.0, 2.25, 2.5]}, zscore_reversion, tp=2.0)


def stochastic_reversal(f, p):
    n, d = p["k_period"], p["d_period"]
    span = f.need(f"HH_{n}") - f.need(f"LL_{n}")
    k, dn = f"_SKK_{n}", f"_SKD_{n}_{d}"
    f.put(**{k: F.when(span > 1e-8, 100 * (C("close") - C(f"LL_{n}")) / span).otherwise(50.0)})
    f.put(**{dn: f.full(F.avg, C(k), d)})
    return (crosses_up(f, k, dn) & (C(k) < p["oversold"] + 10), crosses_down(f, k, dn) & (C(k) > p["overbought"] - 10))


_add("StochasticReversalStrategy", REVERSION, {"k_period": 14, "d_period": 3, "oversold": 20, "overbought": 80},
     {"k_period": [5, 9, 14, 21], "d_period": [3, 5, 7], "oversold": [10, 15, 20, 25], "overbought": [75, 80, 85, 90]},
     stochastic_reversal, tp=2.0)


def cci_reversal(f, p):
    n = p["cci_period"]
    name = f"CCIE_{n}"
    mad = f.need(f"MAD_{n}")
    f.put(**{name: (C("TP") - C(f"_TPM_{n}")) / (0.015 * mad + 1e-10)})
    return rises_over(f, name, p["oversold"]), falls_under(f, name, p["overbought"])


_add("CCIReversalStrategy", REVERSION, {"cci_period": 20, "oversold": -100, "overbought": 100},
     {"cci_period": [10, 14, 20, 30], "oversold": [-150, -125, -100, -80], "overbought": [80, 100, 125, 150]},
     cci_reversal, tp=2.0)


def williams_reversal(f, p):
    n = p["period"]
    span = f.need(f"HH_{n}") - f.need(f"LL_{n}")
    name = f"_WRF_{n}"
    f.put(**{name: F.when(span > 1e-8, -100 * (C(f"HH_{n}") - C("close")) / span).otherwise(-50.0)})
    return rises_over(f, name, p["oversold"]), falls_under(f, name, p["overbought"])


_add("WilliamsRStrategy", REVERSION, {"period": 14, "oversold": -80, "overbought": -20},
     {"period": [7, 10, 14, 21, 28], "oversold": [-95, -90, -85, -80], "overbought": [-20, -15, -10, -5]},
     williams_reversal, tp=2.0)


def fisher_reversion(f, p):
    x = f"FISHER_{p['period']}"
    return rises_over(f, x, -p["threshold"]), falls_under(f, x, p["threshold"])


_add("FisherTransformMRStrategy", REVERSION, {"period": 10, "threshold": 1.5, "signal_period": 1},
     {"period": [5, 8, 10, 14, 20], "threshold": [1.0, 1.25, 1.5, 1.75, 2.0, 2.5], "signal_period": [1, 2, 3]},
     fisher_reversion, lambda p: (f"FISHER_{p['period']}",), tp=2.0)


def vwap_reversion(f, p):
    z = f"VWAPZ_{p['vwap_window']}_{p['z_window']}"
    long, short = rises_over(f, z, -p["entry_z"]), falls_under(f, z, p["entry_z"])
    if p["use_adx_filter"]:
        calm = f.need("ADX_14") < p["adx_threshold"]
        long, short = long & calm, short & calm
    return long, short


_add("ZScoreVWAPReversionStrategy", REVERSION,
     {"vwap_window": 50, "z_window": 50, "entry_z": 2.0, "use_adx_filter": True, "adx_threshold": 25},
     {"vwap_window": [20, 50, 100, 150, 200], "z_window": [20, 30, 50, 100], "entry_z": [1.5, 1.75, 2.0, 2.25, 2.5],
      "use_adx_filter": [True, False], "adx_threshold": [15, 20, 25, 30]}, vwap_reversion, tp=2.0)


def rsi_trend_filtered(f, p):
    r, ema = f"RSI_{p['rsi_period']}", f.need(f"EMA_{p['ema_trend_period']}")
    return (rises_over(f, r, p["oversold"]) & (C("close") > ema), falls_under(f, r, p["overbought"]) & (C("close") < ema))


_add("RSITrendFilteredMRStrategy", REVERSION,
     {"rsi_period": 14, "oversold": 30, "overbought": 70, "ema_trend_period": 200},
     {"rsi_period": [5, 7, 10, 14, 21], "oversold": [20, 25, 30, 35], "overbought": [65, 70, 75, 80],
      "ema_trend_period": [50, 100, 150, 200]}, rsi_trend_filtered,
     lambda p: (f"RSI_{p['rsi_period']}", f"EMA_{p['ema_trend_period']}"), tp=2.0)


def stochrsi_gate(f, p):
    key = f"{p['rsi_period']}_{p['stoch_period']}_{p['smooth_k']}_{p['smooth_d']}"
    k, d = f"STOCHRSIK_{key}", f"STOCHRSID_{key}"
    lo, hi, ema = p["lower_band"], p["upper_band"], f.need(f"EMA_{p['ema_trend_period']}")
    return (crosses_up(f, k, d) & (C(k) < lo) & (C(d) < lo) & (C("close") > ema),
            crosses_down(f, k, d) & (C(k) > hi) & (C(d) > hi) & (C("close") < ema))


_add("StochRSITrendGateStrategy", REVERSION,
     {"rsi_period": 14, "stoch_period": 14, "smooth_k": 3, "smooth_d": 3, "lower_band": 20, "upper_band": 80,
      "ema_trend_period": 200},
     {"rsi_period": [5, 7, 10, 14, 21], "stoch_period": [10, 14, 20], "smooth_k": [3, 5], "smooth_d": [3, 5],
      "lower_band": [10, 15, 20, 30], "upper_band": [70, 80, 85, 90], "ema_trend_period": [50, 100, 150, 200]},
     stochrsi_gate, lambda p: (f"RSI_{p['rsi_period']}", f"EMA_{p['ema_trend_period']}"), tp=2.0)


def turtle_soup(f, p):
    n = p["channel_period"]
    hi, lo = f"HH_{n}", f"LL_{n}"
    f.need(hi), f.need(lo)
    over = under = F.lit(False)
    for k in range(1, p["reclaim_window"] + 1):
        over = over | yes(f.lag("high", k) > f.lag(hi, k + 1))
        under = under | yes(f.lag("low", k) < f.lag(lo, k + 1))
    return under & (C("close") > f.lag(lo)), over & (C("close") < f.lag(hi))


_add("TurtleSoupReversalStrategy", REVERSION, {"channel_period": 20, "reclaim_window": 2},
     {"channel_period": [10, 15, 20, 25], "reclaim_window": [1, 2, 3]}, turtle_soup, tp=2.0)


def pin_bar(f, p):
    o, c, k = C("open"), C("close"), p["wick_ratio"]
    body = F.greatest(F.abs(c - o), F.lit(1e-10))
    reach = p["proximity_atr"] * f.need("ATR_14")
    pin_l, pin_s = f.own_name("PINL"), f.own_name("PINS")
    f.put(**{pin_l: yes(((F.least(o, c) - C("low")) / body > k) & (C("low") <= f.need("BBL_20_2.0") + reach)),
             pin_s: yes(((C("high") - F.greatest(o, c)) / body > k) & (C("high") >= f.need("BBU_20_2.0") - reach))})
    return f.lag(pin_l), f.lag(pin_s)


_add("PinBarReversalStrategy", REVERSION, {"wick_ratio": 2.5, "proximity_atr": 1.0},
     {"wick_ratio": [2.0, 2.5, 3.0], "proximity_atr": [0.5, 1.0, 1.5]}, pin_bar, tp=2.0)


def engulfing(f, p):
    o, c, o1, c1 = C("open"), C("close"), f.lag("open"), f.lag("close")
    atr = f.need("ATR_14")
    long = (c1 < o1) & (c > o) & (o <= c1) & (c >= o1) & (C("low") <= f.need("BBL_20_2.0") + atr)
    short = (c1 > o1) & (c < o) & (o >= c1) & (c <= o1) & (C("high") >= f.need("BBU_20_2.0") - atr)
    if p["use_adx_filter"]:
        calm = f.need("ADX_14") < 30
        long, short = long & calm, short & calm
    return long, short


_add("EngulfingPatternStrategy", REVERSION, {"lookback_level": 20, "use_adx_filter": True},
     {"lookback_level": [10, 20, 30], "use_adx_filter": [True, False]}, engulfing, tp=2.5)


def keltner_fade(f, p):
    k = float(p["kc_mult"])
    up, dn = f"KCU_{p['kc_ema']}_14_{k}", f"KCL_{p['kc_ema']}_14_{k}"
    calm = f.need("ADX_14") < p["adx_threshold"]
    f.need(up), f.need(dn)
    return ((f.lag("low") <= f.lag(dn)) & (C("close") > f.need(dn)) & calm,
            (f.lag("high") >= f.lag(up)) & (C("close") < f.need(up)) & calm)


_add("KeltnerFadeStrategy", REVERSION, {"kc_ema": 20, "kc_mult": 2.0, "adx_threshold": 25},
     {"kc_ema": [15, 20, 25], "kc_mult": [1.5, 2.0, 2.5], "adx_threshold": [20, 25, 30]}, keltner_fade,
     lambda p: (f"EMA_{p['kc_ema']}",), tp=2.0)


def roc_exhaustion(f, p):
    r, e = f"PCTRANK_ROC_{p['roc_period']}_{p['pct_lookback']}", p["extreme_pct"]
    return (f.need(r) > e) & (f.lag(r) <= e), (f.need(r) < 100 - e) & (f.lag(r) >= 100 - e)


_add("ROCExhaustionReversalStrategy", REVERSION, {"roc_period": 10, "pct_lookback": 100, "extreme_pct": 10},
     {"roc_period": [5, 10, 14, 20], "pct_lookback": [50, 100, 200], "extreme_pct": [5, 10, 15]}, roc_exhaustion, tp=2.0)


# ---- breakout --------------------------------------------------------------------------------------------------------

def donchian_breakout(f, p):
    n = p["period"]
    f.need(f"HH_{n}"), f.need(f"LL_{n}")
    return C("close") > f.lag(f"HH_{n}"), C("close") < f.lag(f"LL_{n}")


_add("DonchianBreakoutStrategy", BREAKOUT, {"period": 20}, {"period": [10, 15, 20, 30, 50]}, donchian_breakout)


def volatility_breakout(f, p):
    step, band = f.need("DCLOSE"), f.need(f"ATR_{p['atr_period']}") * p["breakout_mult"]
    return step > band, step < -band


_add("VolatilityBreakoutStrategy", BREAKOUT, {"atr_period": 20, "breakout_mult": 1.0},
     {"atr_period": [10, 14, 20, 30], "breakout_mult": [0.5, 0.75, 1.0, 1.25, 1.5]}, volatility_breakout, sl=1.5)


def momentum_burst(f, p):
    x = f.need(f"ROC_{p['momentum_period']}")
    return x > p["threshold_pct"], x < -p["threshold_pct"]


_add("MomentumBurstStrategy", BREAKOUT, {"momentum_period": 10, "threshold_pct": 1.0},
     {"momentum_period": [3, 5, 10, 15, 20], "threshold_pct": [0.3, 0.5, 1.0, 1.5, 2.0]}, momentum_burst)


def squeeze_breakout(f, p):
    n, k, kn, kk = p["bb_period"], float(p["bb_std"]), p["kc_period"], float(p["kc_mult"])
    on = f"_SQON_{n}_{k}_{kn}_{kk}"
    f.put(**{on: yes((f.need(f"BBL_{n}_{k}") > f.need(f"KCL_{kn}_{kn}_{kk}"))
                     & (f.need(f"BBU_{n}_{k}") < f.need(f"KCU_{kn}_{kn}_{kk}")))})
    out = ~C(f"`{on}`") & yes(f.lag(on))
    push = C("close") - f.need(f"SMA_{n}")
    return out & (push > 0), out & (push < 0)


_add("SqueezeBreakoutStrategy", BREAKOUT, {"bb_period": 20, "bb_std": 2.0, "kc_period": 20, "kc_mult": 1.5},
     {"bb_period": [10, 15, 20, 25], "bb_std": [1.5, 2.0, 2.5, 3.0], "kc_mult": [1.0, 1.25, 1.5, 2.0]}, squeeze_breakout,
     lambda p: (f"EMA_{p['kc_period']}",))


def keltner_breakout(f, p):
    n, k = p["period"], float(p["atr_mult"])
    return C("close") > f.need(f"KCU_{n}_{n}_{k}"), C("close") < f.need(f"KCL_{n}_{n}_{k}")


_add("KeltnerBreakoutStrategy", BREAKOUT, {"period": 20, "atr_mult": 2.0},
     {"period": [10, 15, 20, 25, 30], "atr_mult": [1.25, 1.5, 1.75, 2.0, 2.5]}, keltner_breakout,
     lambda p: (f"EMA_{p['period']}",))


def pending_hit(f, tag: str, event: Column, level: Column, window: int, good) -> Column:
    """A level broken at an event bar is retested once.

    The newest event holds the level for ``window`` bars; ``good(level)`` is the retest condition; the first bar
    that meets it after the event is the hit and uses the event up.
    """
    at, lvl, ok = (f.own_name(f"{tag}_{part}") for part in ("AT", "LVL", "OK"))
    past = f.rows(window, -1)
    last = lambda c: F.last(F.when(event, c), ignorenulls=True).over(past)
    f.put(**{at: F.when(~event, last(C("bar_no"))), lvl: F.when(~event, last(level))})
    f.put(**{ok: F.when(yes(good(C(lvl))), C(at))})
    return C(ok).isNotNull() & yes(F.coalesce(F.max(C(ok)).over(past), F.lit(-1)) < C(at))


def pivot_breakout(f, p):
    n, win, tol = p["lookback"], p["confirm_window"], p["retest_tolerance"]
    f.need(f"HH_{n}"), f.need(f"LL_{n}")
    top, bottom = f.lag(f"HH_{n}"), f.lag(f"LL_{n}")
    atr = F.coalesce(f.need("ATR_14"), F.lit(0.0))
    ready = C("bar_no") >= n + 1
    up, down = f.own_name("PVL"), f.own_name("PVS")
    f.put(**{up: yes(ready & (C("close") > top)), down: yes(ready & (C("close") < bottom))})
    long = pending_hit(f, "PVLH", C(up), top, win,
                       lambda lv: (C("low") <= lv + tol * atr) & (C("close") > lv))
    short = pending_hit(f, "PVSH", C(down), bottom, win,
                        lambda lv: (C("high") >= lv - tol * atr) & (C("close") < lv))
    return long, short


_add("PivotBreakoutStrategy", BREAKOUT, {"lookback": 10, "confirm_window": 5, "retest_tolerance": 0.5},
     {"lookback": [5, 7, 10, 15, 20], "confirm_window": [3, 5, 7, 10], "retest_tolerance": [0.25, 0.5, 0.75, 1.0]},
     pivot_breakout)


def macd_histogram(f, p):
    h = f"MACDHIST_{p['macd_fast']}_{p['macd_slow']}_{p['macd_signal']}"
    long, short = rises_over(f, h, 0), falls_under(f, h, 0)
    if p["use_ema_filter"]:
        ema = f.need(f"EMA_{p['ema_filter_period']}")
        long, short = long & (C("close") > ema), short & (C("close") < ema)
    if p["use_adx_filter"]:
        strong = f.need("ADX_14") > p["adx_threshold"]
        long, short = long & strong, short & strong
    return long, short


_add("MACDHistogramMomentumStrategy", BREAKOUT,
     {"macd_fast": 12, "macd_slow": 26, "macd_signal": 9, "use_ema_filter": True, "ema_filter_period": 50,
      "use_adx_filter": False, "adx_threshold": 20},
     {"macd_fast": [8, 10, 12, 16], "macd_slow": [21, 26, 30, 34], "macd_signal": [7, 9, 12],
      "use_ema_filter": [True, False], "ema_filter_period": [20, 50, 100], "use_adx_filter": [False, True],
      "adx_threshold": [15, 20, 25, 30]}, macd_histogram,
     lambda p: (f"MACDHIST_{p['macd_fast']}_{p['macd_slow']}_{p['macd_signal']}",)
     + ((f"EMA_{p['ema_filter_period']}",) if p["use_ema_filter"] else ()))


def inside_bar(f, p):
    """Kept as defined: the mother bar encloses the close, so valid bars never fire.

    ``next_bar`` tests the bar after the inside run instead.
    """
    n = p["min_inside_bars"]
    f.put(_INSIDE=yes((C("high") < f.lag("high")) & (C("low") > f.lag("low"))).cast("int"))
    shift = 1 if p.get("next_bar") else 0
    run = f.lag("_INSIDE", shift)
    for k in range(1, n):
        run = run + F.coalesce(f.lag("_INSIDE", k + shift), F.lit(0))
    ok = run >= n
    return ok & (C("close") > f.lag("high", n + shift)), ok & (C("close") < f.lag("low", n + shift))


_add("InsideBarBreakoutStrategy", BREAKOUT, {"min_inside_bars": 1}, {"min_inside_bars": [1, 2, 3]}, inside_bar)


def narrow_range(f, p):
    n = p["nr_lookback"]
    f.put(RANGE_HL=C("high") - C("low"))
    f.put(**{f"_NR_{n}": yes((C("RANGE_HL") == f.full(F.min, C("RANGE_HL"), n)) & (C("RANGE_HL") > 0))})
    was = yes(f.lag(f"_NR_{n}"))
    return was & (C("close") > f.lag("high")), was & (C("close") < f.lag("low"))


_add("NarrowRangeBreakoutStrategy", BREAKOUT, {"nr_lookback": 7}, {"nr_lookback": [4, 7, 10]}, narrow_range)


def _close_position() -> Column:
    return (C("close") - C("low")) / (C("high") - C("low") + 1e-10)


def volume_spike(f, p):
    f.put(VOL0=F.coalesce(C("volume"), F.lit(0.0)))
    spike = C("VOL0") > p["vol_mult"] * f.full(F.avg, C("VOL0"), p["vol_lookback"])
    return spike & (_close_position() > 0.7), spike & (_close_position() < 0.3)


_add("VolumeSpikeMomentumStrategy", BREAKOUT, {"vol_mult": 2.0, "vol_lookback": 20},
     {"vol_mult": [1.5, 2.0, 2.5, 3.0], "vol_lookback": [10, 20, 30]}, volume_spike)


def atr_percentile_breakout(f, p):
    r = f"PCTRANK_ATR_14_{p['pct_lookback']}"
    burst = (f.need(r) >= p["expand_pct"]) & (f.lag(r) <= p["compress_pct"])
    return burst & (_close_position() > 0.6), burst & (_close_position() < 0.4)


_add("ATRPercentileBreakoutStrategy", BREAKOUT, {"pct_lookback": 100, "compress_pct": 20, "expand_pct": 70},
     {"pct_lookback": [50, 100, 200], "compress_pct": [10, 20, 30], "expand_pct": [60, 70, 80]}, atr_percentile_breakout)


def trix_momentum(f, p):
    a, b = f"TRIX_{p['trix_period']}_{p['signal_period']}", f"TRIXSIG_{p['trix_period']}_{p['signal_period']}"
    if p["entry_mode"] == "zero_cross":
        long, short = rises_over(f, a, 0), falls_under(f, a, 0)
    else:
        long, short = crosses_up(f, a, b), crosses_down(f, a, b)
        if p["entry_mode"] == "both_confirm":
            long, short = long & (f.need(a) > 0), short & (f.need(a) < 0)
    if p["min_abs_trix"] > 0:
        big = F.abs(f.need(a)) > p["min_abs_trix"]
        long, short = long & big, short & big
    if p["use_trend_filter"]:
        ema = f.need(f"EMA_{p['trend_ema_period']}")
        long, short = long & (C("close") > ema), short & (C("close") < ema)
    return long, short


_add("TRIXMomentumStrategy", BREAKOUT,
     {"trix_period": 12, "signal_period": 9, "entry_mode": "signal_cross", "use_trend_filter": False,
      "trend_ema_period": 100, "min_abs_trix": 0.0},
     {"trix_period": [8, 12, 15, 20, 30], "signal_period": [5, 9, 12],
      "entry_mode": ["signal_cross", "zero_cross", "both_confirm"], "use_trend_filter": [False, True],
      "trend_ema_period": [50, 100], "min_abs_trix": [0.0, 0.03]}, trix_momentum,
     lambda p: (f"TRIX_{p['trix_period']}_{p['signal_period']}", f"TRIXSIG_{p['trix_period']}_{p['signal_period']}")
     + ((f"EMA_{p['trend_ema_period']}",) if p["use_trend_filter"] else ()),
     lambda p: p["trix_period"] * 3 + p["signal_period"] + 5)


# ---- structure rules with a pending level ----------------------------------------------------------------------------

def liquidity_sweep(f, p):
    """Pool of recent pivots swept by a wick, then reclaimed on the same bar or shortly after."""
    order, lb, pts, buf = p["swing_order"], p["pool_lookback_bars"], p["min_pool_points"], p["sweep_buffer_atr"]
    start = lb + 2 * order + 10
    atr = F.coalesce(f.need("ATR_14"), F.lit(0.0))
    body_ok = F.abs(C("close") - C("open")) >= p["min_reversal_body_atr"] * atr
    width = F.when(atr > 0, atr * buf * 8).otherwise(0.001)
    ready = C("bar_no") >= start
    sides = []
    for side, sign in (("L", 1), ("H", -1)):
        pivot = f.need(f"PIVOT{side}_{order}") * sign
        pool, lvl = f.own_name(f"POOL{side}"), f.own_name(f"PLVL{side}")
        f.put(**{pool: F.sort_array(F.collect_list(F.when(ready, pivot)).over(f.rows(lb + 1)))})
        # runs of `pts` neighbours in price order; the first tight enough gives the level
        runs = F.when(F.size(C(pool)) >= pts,
                      F.transform(F.sequence(F.lit(1), F.greatest(F.size(C(pool)) - pts + 1, F.lit(1))),
                                  lambda k: F.slice(C(pool), k, pts)))
        tight = F.filter(runs, lambda r: r[pts - 1] - r[0] <= width)
        mean = lambda r: F.aggregate(r, F.lit(0.0), lambda a, v: a + v) / pts
        f.put(**{lvl: F.when(ready & (F.size(tight) > 0), mean(tight[0]))})
        edge = C("low") if side == "L" else -C("high")
        close = C("close") * sign
        swept = yes(edge < C(f"`{lvl}`") - buf * atr)
        same = swept & yes((close > C(f"`{lvl}`")) & body_ok)
        event = f.own_name(f"SWEEP{side}")
        f.put(**{event: swept & ~same})
        later = pending_hit(f, f"SW{side}", C(event), C(f"`{lvl}`"), p["reclaim_window"],
                            lambda lv, close=close: ready & (close > lv) & body_ok)
        sides.append(same | later)
    return sides[0], sides[1]


_add("LiquiditySweepReversalStrategy", REVERSION,
     {"swing_order": 5, "pool_lookback_bars": 40, "min_pool_points": 2, "sweep_buffer_atr": 0.1, "reclaim_window": 2,
      "min_reversal_body_atr": 0.0},
     {"swing_order": [3, 5, 7], "pool_lookback_bars": [20, 40, 80, 120], "min_pool_points": [2, 3],
      "sweep_buffer_atr": [0.05, 0.1, 0.15, 0.2], "reclaim_window": [1, 2, 3], "min_reversal_body_atr": [0.0, 0.4]},
     liquidity_sweep, tp=2.0)


def structure_break(f, p):
    """Close beyond the last confirmed pivot opens a pending level; the first pullback that holds it fires.

    The newest break decides the direction; when both sides break on one bar the short side is the newer.
    """
    order, win = p["swing_order"], p["pullback_window"]
    start = order * 4 + win + 10
    atr = F.coalesce(f.need("ATR_14"), F.lit(0.0))
    ready = C("bar_no") >= start
    own = {n: f.own_name(n) for n in ("BPH", "BPL", "BLASTH", "BLASTL", "BDIR", "BLVL", "BPD")}
    for side in "HL":
        f.put(**{own[f"BP{side}"]: F.when(ready, f.need(f"PIVOT{side}_{order}"))})
    top, bottom = f.ffill(own["BLASTH"], own["BPH"]), f.ffill(own["BLASTL"], own["BPL"])
    push = C("close") - C("open")
    up = ready & (C("close") > top + p["bos_buffer_atr"] * atr)
    down = ready & (C("close") < bottom - p["bos_buffer_atr"] * atr)
    if p["require_displacement"]:
        up, down = up & (push > p["displacement_atr"] * atr), down & (-push > p["displacement_atr"] * atr)
    f.put(**{own["BDIR"]: F.when(yes(down), -1).when(yes(up), 1)})
    f.put(**{own["BLVL"]: F.when(C(own["BDIR"]) == -1, bottom).when(C(own["BDIR"]) == 1, top)})
    past = f.rows(win, -1)
    f.put(**{own["BPD"]: F.last(F.when(C(own["BDIR"]).isNotNull(), C(own["BDIR"])), ignorenulls=True).over(past)})
    tol = p["pullback_tolerance_atr"] * atr
    good = lambda lv: F.when(C(own["BPD"]) == 1, (C("low") <= lv + tol) & (C("close") > lv)).otherwise(
        (C("high") >= lv - tol) & (C("close") < lv))
    hit = pending_hit(f, "BOS", C(own["BDIR"]).isNotNull(), C(own["BLVL"]), win, good)
    return hit & (C(own["BPD"]) == 1), hit & (C(own["BPD"]) == -1)


_add("MarketStructureBOSPullbackStrategy", TREND,
     {"swing_order": 5, "bos_buffer_atr": 0.1, "require_displacement": True, "displacement_atr": 1.2,
      "pullback_tolerance_atr": 0.4, "pullback_window": 4},
     {"swing_order": [3, 5, 7], "bos_buffer_atr": [0.05, 0.1, 0.2], "require_displacement": [False, True],
      "displacement_atr": [0.8, 1.2], "pullback_tolerance_atr": [0.2, 0.4, 0.6], "pullback_window": [2, 4, 6]},
     structure_break)
