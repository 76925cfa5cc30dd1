"""Signals: chunk invariance, no look-ahead, stateful rules against plain loops, regime switching."""

import numpy as np
import pandas as pd
import pytest
from conftest import make_bars
from pyspark.sql import types as T

from barloom.functions.indicators import features
from barloom.operators import regime as rg
from barloom.operators.chunk_scan import chunk_scan
from barloom.series import KEYS, number_bars, with_halo
from barloom.strategies import base as sb
from barloom.strategies.signals import signals


def _set(df):
    return {tuple(r) for r in df.filter("signal != 0").select("symbol", "bar_no", "strategy_name", "param_hash", "signal").collect()}


def test_fifty_rules_and_retired_names():
    assert sb.count() == 50
    assert len(sb.names(sb.TREND)) == 18 and len(sb.names(sb.REVERSION)) == 18 and len(sb.names(sb.BREAKOUT)) == 14
    assert sb.get("VWAPDeviationReversionStrategy").name == "ZScoreVWAPReversionStrategy"
    with pytest.raises(ValueError):
        sb.get("nothing")
    for n in sb.names():
        grid = sb.get(n).full_grid()
        assert grid["sl_atr_mult"] == sb.SL_GRID and grid["tp_atr_mult"] == sb.TP_GRID


def test_signals_do_not_depend_on_chunk_size(bars):
    names = [*sb.names()[:5], "OBVDivergenceStrategy", "PivotBreakoutStrategy", "MarketStructureBOSPullbackStrategy", "LiquiditySweepReversalStrategy", "KaufmanAMATrendStrategy"]
    a = _set(signals(bars, names))
    assert a and a == _set(signals(bars, names, chunk_rows=60))


def test_no_rule_looks_ahead(spark, bars_pdf):
    part = bars_pdf[bars_pdf.ts < bars_pdf.ts.min() + pd.Timedelta(hours=250)]
    a = {x for x in _set(signals(spark.createDataFrame(bars_pdf))) if x[1] < 250}
    assert a == _set(signals(spark.createDataFrame(part)))


def test_variants_keep_apart(bars):
    two = [("EMACrossoverStrategy", {"fast_period": 5}), ("EMACrossoverStrategy", {"fast_period": 8}), ("ElderRayBullBearStrategy", {"entry_mode": "threshold_cross"}),
           ("TRIXMomentumStrategy", {"entry_mode": "zero_cross"}), ("KaufmanAMATrendStrategy", {"signal_mode": "crossover"}), ("VortexTrendStrategy", {"use_ema_filter": True, "use_adx_filter": True}),
           ("ADXDIStrengthStrategy", {"adx_period": 10}), ("InsideBarBreakoutStrategy", {"next_bar": True})]
    both = _set(signals(bars, two))
    for v in two:
        assert _set(signals(bars, [v])) == {x for x in both if x[3] == sb.param_hash(sb.get(v[0]).params(**v[1]))}


def test_every_rule_beside_a_second_variant_of_itself(spark):
    """Two far sets of each grid: together they give what each gives without the other."""
    pdf = make_bars(700, ("AAA",), seed=9)
    first = [(n, {k: v[0] for k, v in sb.get(n).grid.items()}) for n in sb.names()]
    last = [(n, {k: v[-1] for k, v in sb.get(n).grid.items()}) for n in sb.names()]
    df = spark.createDataFrame(pdf)
    a, b, both = (_set(signals(df, v)) for v in (first, last, first + last))
    assert both == a | b
    assert len({x[2] for x in both}) > 40


def test_repair_rounds_give_the_sequential_answer(spark):
    """A machine with a long memory and no useful halo: every guess is wrong at first."""
    n = 200
    pdf = pd.DataFrame({"symbol": "A", "timeframe": "H1", "bar_no": np.arange(n), "series_rows": n, "x": np.arange(n) % 7})

    def step(p, first, last, state):
        total, out = state or 0, []
        for v in p["x"].iloc[first:last]:
            total = (total * 3 + int(v)) % 1009
            out.append(total)
        return pd.DataFrame({"y": out}, dtype="int64"), total

    df = with_halo(spark.createDataFrame(pdf), 1, 25)
    got = chunk_scan(df, step, [T.StructField("y", T.LongType())], ["symbol", "timeframe", "bar_no"], KEYS).toPandas().sort_values("bar_no")
    want, total = [], 0
    for v in pdf.x:
        total = (total * 3 + int(v)) % 1009
        want.append(total)
    assert got["y"].tolist() == want


def _context(spark, bars_pdf):
    names = ["ATR_14", "PIVOTH_5", "PIVOTL_5"]
    return features(spark.createDataFrame(bars_pdf), names).toPandas().sort_values(["symbol", "bar_no"], ignore_index=True)


def _compare(spark, pdf, name, loop, over):
    ctx = _context(spark, pdf)
    got = signals(spark.createDataFrame(pdf), [(name, over)]).toPandas().sort_values(["symbol", "bar_no"], ignore_index=True)
    fired = 0
    for sym, g in ctx.groupby("symbol"):
        want = loop(g.reset_index(drop=True), sb.get(name).params(**over))
        have = got[got.symbol == sym]["signal"].to_numpy()
        assert (want == have).all(), (sym, np.flatnonzero(want != have)[:5])
        fired += int(np.abs(want).sum())
    assert fired > 0


def _origin_loop(g, p):
    sig, zones = np.zeros(len(g), int), []
    for i, b in g.iterrows():
        a = b.ATR_14
        if i < p["base_lookback"] + 30 or not a > 0:
            continue
        for side, hit in ((1, b.close > b.open), (-1, b.close < b.open)):
            if hit and abs(b.close - b.open) > p["impulse_body_atr"] * a:
                w = g.iloc[i - p["base_lookback"]:i]
                if w.high.max() - w.low.min() <= 3 * p["zone_width_atr"] * a:
                    zones = (zones + [{"lo": w.low.min(), "hi": w.high.max(), "d": side, "n": 0, "b": i}])[-15:]
        zones = [z for z in zones if i - z["b"] <= 200 and z["n"] < p["max_zone_touches"]]
        for z in zones:
            if z["d"] == 1:
                if b.low <= z["hi"] and b.close > z["lo"]:
                    z["n"] += 1
                    if (b.close - b.low) / (b.high - b.low + 1e-10) >= p["confirmation_close_pos"]:
                        sig[i], z["n"] = 1, p["max_zone_touches"]
                if b.close < z["lo"] - p["zone_width_atr"] * a:
                    z["n"] = p["max_zone_touches"]
            else:
                if b.high >= z["lo"] and b.close < z["hi"]:
                    z["n"] += 1
                    if (b.high - b.close) / (b.high - b.low + 1e-10) >= p["confirmation_close_pos"]:
                        sig[i], z["n"] = -1, p["max_zone_touches"]
                if b.close > z["hi"] + p["zone_width_atr"] * a:
                    z["n"] = p["max_zone_touches"]
    return sig


def _zone_loop(g, p):
    sig, zones, pend = np.zeros(len(g), int), [], None
    zw = p["zone_width_atr"]
    for i, b in g.iterrows():
        if i < 2 * p["fractal_order"] + p["retest_window"] + 20:
            continue
        a = b.ATR_14 if b.ATR_14 == b.ATR_14 else 0.0
        for price, side in ((b.PIVOTH_5, 1), (b.PIVOTL_5, -1)):
            if price == price and a > 0:
                same = [z for z in zones if z["s"] == side and abs(price - z["c"]) <= zw * a]
                if same:
                    z = same[0]
                    z["c"], z["t"] = (z["c"] * z["t"] + price) / (z["t"] + 1), z["t"] + 1
                else:
                    zones = (zones + [{"c": price, "w": zw * a / 2, "t": 1, "s": side, "b": i}])[-25:]
        zones = [z for z in zones if i - z["b"] <= 200]
        for k, z in enumerate(zones):
            if z["t"] >= p["min_zone_touches"]:
                if z["s"] == 1 and b.close > z["c"] + z["w"] + p["break_buffer_atr"] * a:
                    pend = (i, z["c"] + z["w"], 1, k)
                if z["s"] == -1 and b.close < z["c"] - z["w"] - p["break_buffer_atr"] * a:
                    pend = (i, z["c"] - z["w"], -1, k)
        if pend:
            age, lvl, d, at = i - pend[0], pend[1], pend[2], pend[3]
            ok = (b.low <= lvl + zw * a and b.close > lvl) if d == 1 else (b.high >= lvl - zw * a and b.close < lvl)
            if 0 < age <= p["retest_window"] and ok:
                sig[i] = d
                if at < len(zones):
                    zones.pop(at)
                pend = None
            elif age > p["retest_window"]:
                pend = None
    return sig


def _fib_loop(g, p):
    sig = np.zeros(len(g), int)
    hi = lo = leg = None
    touched = None
    for i, b in g.iterrows():
        if i < 4 * p["swing_order"] + p["max_pullback_bars"] + 20:
            continue
        a = b.ATR_14 if b.ATR_14 == b.ATR_14 else 0.0
        new = None
        if b.PIVOTH_5 == b.PIVOTH_5:
            if lo is not None and a > 0 and b.PIVOTH_5 - lo > p["min_impulse_atr"] * a:
                new = (1, lo, b.PIVOTH_5)
            hi = b.PIVOTH_5
        if b.PIVOTL_5 == b.PIVOTL_5:
            if hi is not None and a > 0 and hi - b.PIVOTL_5 > p["min_impulse_atr"] * a:
                new = (-1, hi, b.PIVOTL_5)
            lo = b.PIVOTL_5
        if new:
            leg, touched = new, None
            continue
        if not leg:
            continue
        d, start, end = leg
        at = lambda k: end - k * (end - start)
        if (d == 1 and b.close < at(0.786)) or (d == -1 and b.close > at(0.786)):
            leg = touched = None
            continue
        inside = (b.low <= at(0.5) and b.close >= at(0.618)) if d == 1 else (b.high >= at(0.5) and b.close <= at(0.618))
        out = b.close > at(0.5) if d == 1 else b.close < at(0.5)
        if inside:
            touched = i if touched is None else touched
            if i - touched <= p["max_pullback_bars"]:
                if out:
                    sig[i], leg, touched = d, None, None
            else:
                touched = None
        elif touched is not None and out:
            touched = None
    return sig


@pytest.mark.parametrize("name,loop,over", [
    ("SupplyDemandImpulseRetestStrategy", _origin_loop, {"impulse_body_atr": 0.7, "zone_width_atr": 0.9, "base_lookback": 3}),
    ("SupplyDemandImpulseRetestStrategy", _origin_loop, {"impulse_body_atr": 0.05, "zone_width_atr": 2.5, "max_zone_touches": 60, "confirmation_close_pos": 0.97}),
    ("FractalSRZoneBreakRetestStrategy", _zone_loop, {}), ("FibonacciRetracementPullbackStrategy", _fib_loop, {})])
def test_stateful_rules_against_plain_loops(spark, name, loop, over):
    _compare(spark, make_bars(600, ("A", "B", "C"), 11), name, loop, over)


def test_supertrend_warmup_modes(spark):
    pdf = make_bars(400, ("A",), 5)
    d, c = (_set(signals(spark.createDataFrame(pdf), [("SupertrendStrategy", {"multiplier": 1.5, "compat": k})])) for k in (False, True))
    assert d and not c


def _hold(raw, gaps, confirm=2, gap=0.1, hold=3):
    pdf = pd.DataFrame({"regime_raw": raw, "regime_gap": gaps, "k_confirm": confirm, "gap_min": gap, "k_hold": hold})
    return rg._switch(pdf, 0, len(pdf), None)[0]["regime"].tolist()


def test_hysteresis_cases():
    assert _hold(["T"] * 4 + ["R"] + ["T"] * 2, [1] * 7) == ["T"] * 7
    assert _hold(["T"] * 4 + ["R"] * 2, [1] * 6) == ["T"] * 5 + ["R"]
    assert _hold(["T"] * 4 + ["R"] * 3, [1, 1, 1, 1, .05, .05, .05]) == ["T"] * 7
    assert _hold(["T", "R", "R", "R"], [1] * 4, 1, 0.1, 3) == ["T", "T", "R", "R"]


def test_regimes_do_not_depend_on_chunk_size(spark):
    df = spark.createDataFrame(make_bars(420, ("A", "B"), 9))
    key = ["symbol", "bar_no"]
    a = rg.regimes(df).toPandas().sort_values(key, ignore_index=True)
    b = rg.regimes(df, chunk_rows=90).toPandas().sort_values(key, ignore_index=True)
    assert (a["regime"] == b["regime"]).all() and a["regime"].nunique() > 1
    assert (a["regime_live"].iloc[1:420].to_numpy() == a["regime"].iloc[:419].to_numpy()).all()
    assert np.allclose(a[list(rg.SCORES)].sum(axis=1), 1)
    short = rg.regimes(spark.createDataFrame(make_bars(100, ("A",)))).toPandas()
    assert (short["regime_live"] == "CHOP").all()


def test_numbered_input_is_accepted(bars):
    assert _set(signals(number_bars(bars), ["DonchianBreakoutStrategy"])) == _set(signals(bars, ["DonchianBreakoutStrategy"]))
