"""Four-state market regime: component measures, scores, raw label and hysteresis."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.indicators import BASE, Frame
from barloom.functions.rounding import rnd  # noqa: F401
from barloom.operators.buckets import REGIMES
from barloom.operators.chunk_scan import chunk_scan
from barloom.series import KEYS, number_bars

C = F.col


@dataclass(frozen=True)
class RegimeParams:
    """Default lookbacks, switching rules and score weights."""

    k_confirm: int = 3
    gap_min: float = 0.10
    k_hold: int = 5
    atr_period: int = 14
    bb_period: int = 20
    bb_std: float = 2.0
    efficiency_period: int = 10
    bb_squeeze_lookback: int = 200
    bb_squeeze_percentile: float = 20.0
    atr_lookback: int = 100
    structure_period: int = 20
    structure_atr_mult: float = 0.1
    trend_adx_weight: float = 0.40
    trend_efficiency_weight: float = 0.35
    trend_slope_weight: float = 0.25
    range_adx_weight: float = 0.35
    range_efficiency_weight: float = 0.30
    range_containment_weight: float = 0.35
    breakout_squeeze_weight: float = 0.35
    breakout_atr_weight: float = 0.30
    breakout_structure_weight: float = 0.35
    chop_adx_weight: float = 0.30
    chop_efficiency_weight: float = 0.30
    chop_whipsaw_weight: float = 0.40

    @property
    def warmup(self) -> int:
        return max(self.bb_squeeze_lookback, self.atr_lookback, 50)


# Switching rules per timeframe (bars to confirm, least gap, bars to hold).
SWITCHING = {"M5": (3, 0.10, 5), "M15": (3, 0.10, 4), "M30": (2, 0.10, 4), "H1": (2, 0.10, 3), "H4": (2, 0.08, 2),
             "D1": (1, 0.08, 2)}
SWITCH_COLS = ("k_confirm", "gap_min", "k_hold")


def switching_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, *v) for t, v in SWITCHING.items()],
                                 "timeframe string, k_confirm int, gap_min double, k_hold int")


def resolve_params(series: DataFrame, overrides: DataFrame | None = None, base: RegimeParams = RegimeParams()) -> DataFrame:
    """Switching rules per row: symbol and timeframe override, then timeframe default, then global default.

    Both tables hold configuration, one row per timeframe or per tuned series, and are broadcast only below the
    session's size limit.
    """
    x = series.join(switching_table(series.sparkSession).withColumnsRenamed({c: f"_d_{c}" for c in SWITCH_COLS}), "timeframe", "left")
    if overrides is not None:
        o = overrides.select("symbol", "timeframe", *[C(c).alias(f"_o_{c}") for c in SWITCH_COLS])
        x = x.join(o, ["symbol", "timeframe"], "left")
    pick = lambda c: F.coalesce(*([C(f"_o_{c}")] if overrides is not None else []), C(f"_d_{c}"), F.lit(getattr(base, c)))
    return x.withColumns({c: pick(c) for c in SWITCH_COLS}).drop(*[f"_{k}_{c}" for k in "do" for c in SWITCH_COLS])


def params_version(series: DataFrame, overrides: DataFrame | None = None, base: RegimeParams = RegimeParams()) -> DataFrame:
    """Stamp per symbol over the rules of all its timeframes; a changed stamp asks for a new run."""
    x = resolve_params(series.select("symbol", "timeframe").distinct(), overrides, base)
    rest = {k: v for k, v in asdict(base).items() if k not in SWITCH_COLS}
    text = F.to_json(F.struct("timeframe", *SWITCH_COLS, F.lit(str(sorted(rest.items()))).alias("rest")))
    return x.withColumn("_t", text).groupBy("symbol").agg(
        F.sha2(F.array_join(F.sort_array(F.collect_list("_t")), "|"), 256).alias("regime_version"))


def components(f: Frame, p: RegimeParams = RegimeParams()) -> Frame:
    """The measures the scores are made of; zero before their lookback is complete."""
    n, bar, close = p.bb_period, C("bar_no"), C("close")
    f.put(ADXF=F.coalesce(f.need("ADX_14"), F.lit(25.0)), ATRF=F.coalesce(f.need(f"ATR_{p.atr_period}"), F.lit(0.0)))
    f.need("DCLOSE")
    mid = f.need(f"SMA_{n}")
    f.put(_SIG=f.full(F.stddev_pop, close, n))
    f.put(_RU=mid + p.bb_std * C("_SIG"), _RL=mid - p.bb_std * C("_SIG"))
    f.put(bb_width=F.when(mid > 1e-10, (C("_RU") - C("_RL")) / mid).otherwise(0.0))
    e = p.efficiency_period
    moved = F.sum(F.abs(C("DCLOSE"))).over(f.rows(e))
    f.put(efficiency=F.when((bar >= e) & (moved > 1e-10), F.abs(close - f.lag("close", e)) / moved).otherwise(0.0))
    hits = lambda cond, k: F.sum(F.coalesce(cond.cast("int"), F.lit(0))).over(f.rows(k))
    f.put(slope_consistency=F.when(bar >= 20, F.greatest(hits(C("DCLOSE") > 0, 20), hits(C("DCLOSE") < 0, 20)) / 20).otherwise(0.0))
    f.put(_HL=F.collect_list(F.struct(C("high").alias("h"), C("low").alias("l"))).over(f.rows(10)))
    inside = F.size(F.filter("_HL", lambda b: (b["h"] <= C("_RU")) & (b["l"] >= C("_RL"))))
    f.put(containment=F.when((bar >= max(n, 10)) & (C("_SIG") > 1e-10), inside / 10).otherwise(0.0))
    w, lb = C("bb_width"), p.bb_squeeze_lookback
    f.put(_WPOS=F.when(w > 0, w))
    f.put(_WN=F.count("_WPOS").over(f.rows(lb)), _WTHR=F.percentile("_WPOS", F.lit(p.bb_squeeze_percentile / 100)).over(f.rows(lb)))
    f.put(squeeze=F.when((bar >= lb) & (C("_WN") > 10) & (w > 0),
                         F.when(w <= C("_WTHR"), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), C("_WTHR") / w)))).otherwise(0.0))
    recent = F.max("squeeze").over(f.rows(5, -1))
    f.put(squeeze_release=F.when((bar >= 5) & (recent > 0.5) & (C("squeeze") < 0.5),
                                 F.least(F.lit(1.0), recent * (1 - C("squeeze")) * 2)).otherwise(0.0))
    f.put(_APOS=F.when(C("ATRF") > 0, C("ATRF")))
    f.put(_AL=F.collect_list("_APOS").over(f.rows(p.atr_lookback)))
    f.put(atr_percentile=F.when((bar >= p.atr_lookback) & (F.size("_AL") > 10) & (C("ATRF") > 0),
                                F.size(F.filter("_AL", lambda a: a <= C("ATRF"))) / F.size("_AL")).otherwise(0.0))
    s = p.structure_period
    top, bottom = F.max("high").over(f.rows(s, -1)), F.min("low").over(f.rows(s, -1))
    f.put(_ST=top, _SB=bottom, _SM=F.when(C("ATRF") > 0, C("ATRF") * p.structure_atr_mult).otherwise(0.0))
    m = C("_SM")
    near = F.greatest((close - C("_ST")) / (m + 1e-10), (C("_SB") - close) / (m + 1e-10))
    f.put(structure_break=F.when(bar < s, 0.0).when((close > C("_ST") + m) | (close < C("_SB") - m), 1.0)
          .when(m > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), near))).otherwise(0.0))
    rng = C("high") - C("low")
    wick = (C("high") - F.greatest("open", "close")) + (F.least("open", "close") - C("low"))
    f.put(_WK=F.when(rng > 1e-10, wick).otherwise(0.0), _RG=F.when(rng > 1e-10, rng).otherwise(0.0))
    tot = F.sum("_RG").over(f.rows(10))
    f.put(whipsaw=F.when((bar >= 10) & (tot > 1e-10), F.sum("_WK").over(f.rows(10)) / tot).otherwise(0.0))
    f.put(_FLIP=F.when(F.signum("DCLOSE") * F.signum(f.lag("DCLOSE")) < 0, 1).otherwise(0))
    f.put(direction_flips=F.when(bar >= 11, F.sum("_FLIP").over(f.rows(9)) / 9).otherwise(0.0))
    return f


COMPONENTS = ("bb_width", "efficiency", "slope_consistency", "containment", "squeeze", "squeeze_release", "atr_percentile",
              "structure_break", "whipsaw", "direction_flips")


def adx_trend_norm(x: Column) -> Column:
    return F.when(x < 20, x / 40).when(x < 40, 0.5 + (x - 20) / 40).otherwise(F.least(F.lit(1.0), 0.75 + (x - 40) / 80))


def adx_mid_norm(x: Column) -> Column:
    return (F.when(x < 15, x / 30).when(x < 30, 0.5 + (30 - F.abs(x - 22.5)) / 30)
            .otherwise(F.greatest(F.lit(0.0), 1.0 - (x - 30) / 40)))


SCORES = ("trend_score", "range_score", "breakout_score", "chop_score")


def scores(f: Frame, p: RegimeParams = RegimeParams()) -> Frame:
    """Four scores summing to one, the raw label, its strength and its lead; neutral in the warm-up."""
    components(f, p)
    f.put(adx_norm=adx_trend_norm(C("ADXF")), adx_mid=adx_mid_norm(C("ADXF")))
    e = C("efficiency")
    raw = (
        p.trend_adx_weight * C("adx_norm") + p.trend_efficiency_weight * e + p.trend_slope_weight * C("slope_consistency"),
        p.range_adx_weight * (1 - C("adx_norm")) + p.range_efficiency_weight * (1 - e) + p.range_containment_weight * C("containment"),
        p.breakout_squeeze_weight * C("squeeze_release") + p.breakout_atr_weight * C("atr_percentile")
        + p.breakout_structure_weight * C("structure_break"),
        p.chop_adx_weight * C("adx_mid") + p.chop_efficiency_weight * (1 - e)
        + p.chop_whipsaw_weight * (C("whipsaw") * 0.5 + C("direction_flips") * 0.5),
    )
    f.put(**{f"_s{i}": x for i, x in enumerate(raw)})
    live = (C("bar_no") >= p.warmup) & (C("series_rows") >= p.warmup + 10)
    total = C("_s0") + C("_s1") + C("_s2") + C("_s3")
    f.put(regime_warmup=~live, **{n: F.when(live & (total > 1e-10), C(f"_s{i}") / total).otherwise(0.25) for i, n in enumerate(SCORES)})
    # equal scores keep the order of the list
    f.put(_ord=F.array_sort(F.array(*[F.struct((-C(n)).alias("neg"), F.lit(i).alias("i")) for i, n in enumerate(SCORES)])))
    names = F.array(*[F.lit(r) for r in REGIMES])
    f.put(regime_raw=F.when(live, F.get(names, C("_ord")[0]["i"])).otherwise("CHOP"),
          regime_strength=F.when(live, -C("_ord")[0]["neg"]).otherwise(0.25),
          regime_gap=F.when(live, C("_ord")[1]["neg"] - C("_ord")[0]["neg"]).otherwise(0.0))
    f.put(regime_strength_live=F.when(C("series_rows") < p.warmup + 10, 0.25).otherwise(f.lag("regime_strength")))
    return f


def _switch(pdf: pd.DataFrame, first: int, last: int, state):
    """A new label needs ``k_confirm`` bars in a row with enough lead, after the old one was held ``k_hold`` bars."""
    raw = pdf["regime_raw"].to_numpy()
    gap = pdf["regime_gap"].to_numpy(dtype=float)
    need, lead, hold = int(pdf["k_confirm"].iloc[0]), float(pdf["gap_min"].iloc[0]), int(pdf["k_hold"].iloc[0])
    out, live = np.empty(last - first, dtype=object), np.empty(last - first, dtype=object)
    cur, held, cand, seen = state or (None, 0, None, 0)
    for i in range(first, last):
        live[i - first] = cur
        if cur is None:
            cur, held = raw[i], 1
        else:
            held = min(held + 1, hold)  # more than the required hold makes no difference
            if raw[i] != cur and gap[i] >= lead:
                seen = seen + 1 if raw[i] == cand else 1
                cand = raw[i]
                if seen >= need and held >= hold:
                    cur, held, cand, seen = cand, 1, None, 0
                seen = min(seen, need)
            else:
                cand, seen = None, 0
        out[i - first] = cur
    return pd.DataFrame({"regime": out, "regime_live": live}), [cur, int(held), cand, int(seen)]


REGIME_COLS = (*SCORES, "regime_raw", "regime_strength", "regime_gap", "regime_warmup", "regime_strength_live", "regime",
               "regime_live")


def regimes(bars: DataFrame, p: RegimeParams = RegimeParams(), overrides: DataFrame | None = None,
            chunk_rows: int | None = None) -> DataFrame:
    """Bars with all regime columns; ``regime_live`` is the label known when a bar opens."""
    numbered = bars if "bar_no" in bars.columns else number_bars(bars, KEYS, chunk_rows)
    f = scores(Frame.of(numbered, lookback=700 + p.bb_squeeze_lookback, chunk_rows=chunk_rows), p)
    keep = [c for c in BASE if f.has(c)] + [c for c in REGIME_COLS if c not in ("regime", "regime_live")]
    x = resolve_params(f.df.select(*keep, "_chunk", "_own"), overrides, p)
    out = chunk_scan(x, _switch, [T.StructField("regime", T.StringType()), T.StructField("regime_live", T.StringType())],
                     keep, KEYS)
    short = C("series_rows") < p.warmup + 10
    return out.withColumn("regime_live", F.when(short, "CHOP").otherwise(C("regime_live")))
