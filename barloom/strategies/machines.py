"""Rules that carry state from bar to bar: trailing bands, parabolic stop and swing levels."""

from __future__ import annotations

import numpy as np
import pandas as pd

from barloom.strategies.base import BREAKOUT, TREND, Strategy, register

NAN = float("nan")

# Bars that a level lives, and most levels at once.
ZONE_LIFE, SWING_ZONES = 200, 25


def _cols(p: pd.DataFrame, *names: str) -> list[np.ndarray]:
    return [p[n].to_numpy(dtype=float) for n in names]


def supertrend(prm: dict):
    """Bands that only tighten until price closes through them; fires when the side flips.

    ``compat`` keeps the behaviour of a series that starts inside the ATR warm-up: its bands never become known.
    """
    k, atr_col, compat = prm["multiplier"], f"ATR_{prm['atr_period']}", prm.get("compat", False)

    def step(p, first, last, state):
        hi, lo, close, atr = _cols(p, "high", "low", "close", atr_col)
        mid = (hi + lo) / 2
        up, dn = mid + k * atr, mid - k * atr
        sig, side = np.zeros(last - first, dtype=int), np.zeros(last - first, dtype=int)
        lines = np.full((2, last - first), NAN)
        top, bottom, d, prev = state or (None, None, 0, None)
        for i in range(first, last):
            known = up[i] == up[i]
            if prev is None:
                top, bottom = (up[i], dn[i]) if known else (None, None)
            elif top is None:
                if known and not compat:
                    top, bottom = up[i], dn[i]
            else:
                was_top, was_bottom = top, bottom
                if dn[i] > was_bottom or prev < was_bottom:
                    bottom = dn[i]
                if up[i] < was_top or prev > was_top:
                    top = up[i]
                nd = 1 if close[i] > was_top else -1 if close[i] < was_bottom else d
                if nd * d == -1:
                    sig[i - first] = nd
                d = nd
            prev = close[i]
            side[i - first] = d
            if top is not None:
                lines[:, i - first] = top, bottom
        return pd.DataFrame({"signal": sig, "side": side, "upper": lines[0], "lower": lines[1]}), [
            None if top is None else float(top), None if bottom is None else float(bottom), int(d),
            None if prev is None else float(prev)]

    return step


def parabolic(prm: dict):
    """Parabolic stop-and-reverse, started long with the first high as stop and the first low as extreme."""
    a0, cap, th = prm["af_start"], prm["af_max"], prm["adx_threshold"]

    def step(p, first, last, state):
        hi, lo, close, adx = _cols(p, "high", "low", "close", "ADX_14")
        sar_out, sig = np.full(last - first, NAN), np.zeros(last - first, dtype=int)
        st = state
        for i in range(first, last):
            if st is None:
                bull, sar, ep, af, over = True, hi[i], lo[i], a0, None
            else:
                bull, sar, ep, af, over = st
                sar = sar + af * (ep - sar)
                guard = (lo if bull else hi)[max(0, i - 2):i]
                sar = min(sar, *guard) if bull else max(sar, *guard)
                broke = lo[i] < sar if bull else hi[i] > sar
                best = hi[i] > ep if bull else lo[i] < ep
                if broke:
                    bull, sar, ep, af = not bull, ep, (lo if bull else hi)[i], a0
                elif best:
                    ep, af = (hi if bull else lo)[i], min(af + a0, cap)
            now = bool(close[i] > sar)
            was_long, was_short = (False, True) if over is None else (over, over)
            if adx[i] > th:
                if now and not was_long:
                    sig[i - first] = 1
                elif not now and was_short:
                    sig[i - first] = -1
            sar_out[i - first] = sar
            st = [bool(bull), float(sar), float(ep), float(af), now]
        return pd.DataFrame({"signal": sig, "psar": sar_out}), st

    return step


def swing_zones(prm: dict):
    """Pivots near each other are one level; a level met often enough, broken and retested within the window fires.

    Levels are columns of an array in order of age: middle, half width, pivots met, side, birth.  Every question about them is one array expression.
    """
    order, width, window = prm["fractal_order"], prm["zone_width_atr"], prm["retest_window"]
    start = order * 2 + window + 20
    MID, HALF, MET, SIDE, BORN = range(5)

    def met(levels: np.ndarray, price: float, side: int, atr: float, b: int) -> np.ndarray:
        near = np.flatnonzero((levels[SIDE] == side) & (np.abs(price - levels[MID]) <= width * atr))
        if not near.size:
            return np.column_stack((levels, (price, width * atr * 0.5, 1, side, b)))[:, -SWING_ZONES:]
        n = levels[MET, near[0]]
        levels[MID, near[0]] = (levels[MID, near[0]] * n + price) / (n + 1)
        levels[MET, near[0]] = n + 1
        return levels

    def step(p, first, last, state):
        hi, lo, close, atr, ph, pl = _cols(p, "high", "low", "close", "ATR_14", f"PIVOTH_{order}", f"PIVOTL_{order}")
        bar = p["bar_no"].to_numpy()
        atr = np.nan_to_num(atr)
        sig = np.zeros(last - first, dtype=int)
        levels = np.array(state["levels"], float).reshape(5, -1) if state else np.empty((5, 0))
        broken = state["broken"] if state else None
        for i in range(first, last):
            b, a, c = int(bar[i]), atr[i], close[i]
            if b < start:
                continue
            for price, side in ((ph[i], 1), (pl[i], -1)):
                if a > 0 and not np.isnan(price):
                    levels = met(levels, price, side, a, b)
            levels = levels[:, b - levels[BORN] <= ZONE_LIFE]
            edges = levels[MID] + levels[SIDE] * levels[HALF]
            through = np.flatnonzero((levels[MET] >= prm["min_zone_touches"]) & (levels[SIDE] * (c - edges) > prm["break_buffer_atr"] * a))
            if through.size:
                at = int(through[-1])
                broken = {"bar": b, "edge": float(edges[at]), "side": int(levels[SIDE, at]), "at": at}
            elif broken:  # a break at this very bar has no retest yet
                d, age = broken["side"], b - broken["bar"]
                touch = d * ((lo[i] if d == 1 else hi[i]) - broken["edge"]) <= width * a
                if age <= window and touch and d * (c - broken["edge"]) > 0:
                    sig[i - first] = d
                    levels = np.delete(levels, [broken["at"]] if broken["at"] < levels.shape[1] else [], axis=1)
                    broken = None
                elif age > window:
                    broken = None
        return pd.DataFrame({"signal": sig}), {"levels": levels.ravel().tolist(), "broken": broken}

    return step


def _machine(name, category, defaults, grid, kernel, inputs, sl=2.0):
    register(Strategy(name, category, {**defaults, "sl_atr_mult": sl, "tp_atr_mult": 3.0}, grid, kernel=kernel, inputs=inputs))


_machine("SupertrendStrategy", TREND, {"atr_period": 10, "multiplier": 3.0},
         {"atr_period": [7, 10, 14, 20, 25], "multiplier": [1.5, 2.0, 2.5, 3.0, 4.0]}, supertrend,
         lambda p: (f"ATR_{p['atr_period']}",), sl=1.5)
_machine("ParabolicSARTrendStrategy", TREND, {"af_start": 0.02, "af_max": 0.20, "adx_threshold": 20},
         {"af_start": [0.01, 0.02, 0.03], "af_max": [0.15, 0.20, 0.25], "adx_threshold": [15, 20, 25]}, parabolic,
         lambda p: ("ADX_14",))
_machine("FractalSRZoneBreakRetestStrategy", BREAKOUT,
         {"fractal_order": 5, "zone_width_atr": 0.4, "min_zone_touches": 2, "break_buffer_atr": 0.1, "retest_window": 4},
         {"fractal_order": [3, 5, 7, 9], "zone_width_atr": [0.25, 0.4, 0.6, 0.9], "min_zone_touches": [2, 3, 4],
          "break_buffer_atr": [0.05, 0.1, 0.2], "retest_window": [2, 4, 6, 8]}, swing_zones,
         lambda p: ("ATR_14", f"PIVOTH_{p['fractal_order']}", f"PIVOTL_{p['fractal_order']}"))
