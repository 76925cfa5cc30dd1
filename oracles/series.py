"""Reference SQL of bars, indicators, regimes and signals on hourly event bars."""

from __future__ import annotations

import hashlib
import json

from oracles.common import chain, ema, event_bars, lag, numbered, r, roll, win

BASE = numbered(event_bars("H1"))
D = 5

PREV = {"pc": lag("close"), "ph": lag("high"), "pl": lag("low"), "po": lag("open")}
MOVE = {"tr": "greatest(high - low, abs(high - pc), abs(low - pc))", "dc": "close - pc", "up": "high - ph", "dl": "low - pl",
        "tp": "(high + low + close) / 3"}
START = [PREV, MOVE]


def shown(levels: list[dict], cols: dict[str, str], extra: str = "", base: str = BASE) -> str:
    sel = "symbol, ts" + (", " + extra if extra else "") + "".join(f", {r(e, D)} AS {n}" for n, e in cols.items())
    return chain(base, levels, sel)


def sma(n: int, x: str = "close") -> str:
    return roll("avg", x, n)


def std(n: int, x: str = "close") -> str:
    return roll("stddev_samp", x, n)


def atr(n: int) -> str:
    return roll("avg", "tr", n)


def hh(n: int) -> str:
    return roll("max", "high", n)


def ll(n: int) -> str:
    return roll("min", "low", n)


def span(n: int) -> float:
    return 2 / (n + 1)


def first(x: str) -> str:
    return f"min(CASE WHEN {x} IS NOT NULL THEN i END) OVER (PARTITION BY symbol)"


def late(x: str, alpha: float, seed: str, wait: int = 0) -> str:
    """Smoothing that starts at row `seed`; null for the first `wait - 1` rows of it."""
    e = ema(x, alpha, seed)
    return f"CASE WHEN i >= ({seed}) + {max(wait - 1, 0)} THEN {e} END"


def rsi_levels(n: int, tag: str = "") -> list[dict]:
    return [{f"g{tag}": "CASE WHEN dc > 0 THEN dc ELSE 0.0 END", f"l{tag}": "CASE WHEN dc < 0 THEN -dc ELSE 0.0 END"},
            {f"ag{tag}": late(f"g{tag}", 1 / n, "0", n), f"al{tag}": late(f"l{tag}", 1 / n, "0", n)},
            {f"rsi{tag}": f"100 - 100 / (1 + ag{tag} / (al{tag} + 1e-10))"}]


def macd_levels(a: int, b: int, c: int, t: str = "") -> list[dict]:
    return [{f"macd{t}": f"{ema('close', span(a))} - {ema('close', span(b))}"}, {f"msig{t}": ema(f"macd{t}", span(c))},
            {f"mhist{t}": f"macd{t} - msig{t}"}]


ADX = [{"atr14": atr(14), "pdm": "CASE WHEN up > abs(dl) AND up > 0 THEN up ELSE 0.0 END"},
       {"mdm": "CASE WHEN abs(dl) > pdm AND abs(dl) > 0 THEN abs(dl) ELSE 0.0 END"},
       {"pdi0": f"100 * {roll('avg', 'pdm', 14)} / (atr14 + 1e-10)", "mdi0": f"100 * {roll('avg', 'mdm', 14)} / (atr14 + 1e-10)"},
       {"dx0": "100 * abs(pdi0 - mdi0) / (pdi0 + mdi0 + 1e-10)"}, {"adx": roll("avg", "dx0", 14)}]
DI = [{"upp": "CASE WHEN up > 0 THEN up ELSE 0.0 END", "drp": "abs(dl)", "atr14d": atr(14)},
      {"pdi": f"100 * ({roll('avg', 'upp', 14)} / (atr14d + 1e-10))", "mdi": f"100 * ({roll('avg', 'drp', 14)} / (atr14d + 1e-10))"}]
WADX = [{"wp": "CASE WHEN up > -dl AND up > 0 THEN up ELSE 0.0 END", "wm": "CASE WHEN -dl > up AND -dl > 0 THEN -dl ELSE 0.0 END"},
        {"wa": late("tr", 1 / 14, "0", 14), "wps": late("wp", 1 / 14, "0", 14), "wms": late("wm", 1 / 14, "0", 14)},
        {"wpdi": "100 * (wps / (wa + 1e-10))", "wmdi": "100 * (wms / (wa + 1e-10))"},
        {"wdx": "100 * abs(wpdi - wmdi) / (wpdi + wmdi + 1e-10)"}, {"wadx": late("wdx", 1 / 14, "13", 14)}]


def seeded(x: str, n: int) -> list[dict]:
    """Wilder smoothing seeded with the mean of the first n rows, zero before."""
    head = f"avg(CASE WHEN i < {n} THEN {x} END) OVER (PARTITION BY symbol)"
    src = f"CASE WHEN i = {n - 1} THEN {x}_h WHEN i >= {n} THEN {x} END"
    return [{f"{x}_h": head}, {f"{x}_q": src}, {f"{x}_s": f"CASE WHEN i >= {n - 1} THEN {ema(f'{x}_q', 1 / n, str(n - 1))} ELSE 0.0 END"}]


def merge(*lists: list[dict]) -> list[dict]:
    """Zip independent level lists."""
    return [{k: v for d in lists if i < len(d) for k, v in d[i].items()} for i in range(max(map(len, lists)))]


SADX = [{"xtr": "CASE WHEN i = 0 THEN 0.0 ELSE tr END", "xp": "CASE WHEN up > -dl AND up > 0 THEN up ELSE 0.0 END",
         "xm": "CASE WHEN -dl > up AND -dl > 0 THEN -dl ELSE 0.0 END"}] + merge(seeded("xtr", 14), seeded("xp", 14), seeded("xm", 14)) + [
    {"xpd": "CASE WHEN i >= 14 AND xtr_s > 1e-10 THEN 100 * xp_s / xtr_s ELSE 0.0 END",
     "xmd": "CASE WHEN i >= 14 AND xtr_s > 1e-10 THEN 100 * xm_s / xtr_s ELSE 0.0 END"},
    {"xdx": "CASE WHEN xpd + xmd > 1e-10 THEN 100 * abs(xpd - xmd) / (xpd + xmd) ELSE 0.0 END"}] + seeded("xdx", 14)

MAD = [{"tps": f"list(tp) OVER {win(20)}", "tpm": sma(20, "tp")},
       {"mad": "CASE WHEN tpm IS NOT NULL THEN list_sum(list_transform(tps, lambda v: abs(v - tpm))) / 20 END"}]


def wma(x: str, n: int) -> str:
    return "(" + " + ".join(f"{n - k} * {lag(x, k) if k else x}" for k in range(n)) + f") / {n * (n + 1) / 2}"


def hull(n: int, t: str = "") -> list[dict]:
    return [{f"hw{t}": wma("close", n // 2), f"hf{t}": wma("close", n)}, {f"hr{t}": f"2 * hw{t} - hf{t}"}, {f"hull{t}": wma(f"hr{t}", int(n ** 0.5))}]


def swing(x: str, k: int, t: str) -> list[dict]:
    return [{f"pv{t}": lag(x, k)},
            {f"swh{t}": f"coalesce(i >= {2 * k} AND pv{t} = max({x}) OVER {win(2 * k + 1)}, false)",
             f"swl{t}": f"coalesce(i >= {2 * k} AND pv{t} = min({x}) OVER {win(2 * k + 1)}, false)"}]


def pivots(k: int) -> list[dict]:
    return merge(swing("high", k, "h"), swing("low", k, "l")) + [{"pivh": "CASE WHEN swhh THEN pvh END", "pivl": "CASE WHEN swll THEN pvl END"}]


def rank(x: str, n: int, t: str) -> list[dict]:
    return [{f"rl{t}": f"list({x}) FILTER ({x} IS NOT NULL) OVER {win(n)}"},
            {f"rk{t}": f"CASE WHEN len(rl{t}) = {n} THEN len(list_filter(rl{t}, lambda v: v < {x})) / {n - 1} * 100.0 END"}]


TRIX = [{"e1": ema("close", span(12))}, {"e2": ema("e1", span(12))}, {"e3": ema("e2", span(12))},
        {"trix": f"(e3 / {lag('e3')} - 1) * 100"}, {"tsig": late("trix", span(9), "1")}]
AROON = [{"ah": f"list(high) OVER {win(26)}", "al": f"list(low) OVER {win(26)}"},
         {"aru": "CASE WHEN i >= 25 THEN 100.0 * (list_position(ah, list_max(ah)) - 1) / 25 END",
          "ard": "CASE WHEN i >= 25 THEN 100.0 * (list_position(al, list_min(al)) - 1) / 25 END"}]
FISHER = [{"ft": hh(10), "fb": ll(10)}, {"fr": "2 * (((high + low) / 2 - fb) / (ft - fb + 1e-10)) - 1"}, {"fs": late("fr", 0.5, "9")},
          {"fc": "least(0.999, greatest(-0.999, fs))"}, {"fx": "0.5 * ln((1 + fc) / (1 - fc))"},
          # zero seed on row 8, so that row 9 is half its own value
          {"fq": "CASE WHEN i < 9 THEN 0.0 ELSE fx END"}, {"fish": "CASE WHEN i < 9 THEN 0.0 ELSE " + ema("fq", 0.5, "8") + " END"}]
VWAP = [{"vw": f"{roll('sum', 'tp * volume', 50)} / ({roll('sum', 'volume', 50)} + 1e-10)"}, {"vd": "close - vw"},
        {"vz": f"(vd - {sma(50, 'vd')}) / ({std(50, 'vd')} + 1e-10)"}]
STOCHRSI = rsi_levels(14) + [{"srl": roll("min", "rsi", 14), "srh": roll("max", "rsi", 14)},
                             {"sr": "CASE WHEN srh - srl > 1e-8 THEN 100 * (rsi - srl) / (srh - srl) ELSE 50.0 END"},
                             {"srk": sma(3, "sr")}, {"srd": sma(3, "srk")}]
OBV = [{"sv": "volume * coalesce(sign(dc), 0)"}, {"obv": "sum(sv) OVER (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING)"},
       {"obvm": f"avg(obv) OVER {win(5)}"}]
KAMA = [{"kd": f"abs(close - {lag('close', 10)})", "kv": roll("sum", "abs(dc)", 10)},
        {"ksc": "CASE WHEN i > 10 THEN pow(CASE WHEN kv > 0 THEN kd / kv ELSE 0.0 END * (2.0 / 3 - 2.0 / 31) + 2.0 / 31, 2) END"},
        {"klp": "sum(ln(1 - ksc)) OVER (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING)"},
        {"kama": "CASE WHEN i >= 10 THEN exp(coalesce(klp, 0)) * sum(CASE WHEN i = 10 THEN close WHEN i > 10 THEN ksc * close / exp(klp) END) "
                 "OVER (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING) END"}]
ICHI = [{"ten": f"({hh(9)} + {ll(9)}) / 2", "kij": f"({hh(26)} + {ll(26)}) / 2", "sb0": f"({hh(52)} + {ll(52)}) / 2"},
        {"sa0": "(ten + kij) / 2"}, {"sa": lag("sa0", 26), "sb": lag("sb0", 26)}]
BB = [{"m20": sma(20), "s20": std(20)}, {"bbu": "m20 + 2.0 * s20", "bbl": "m20 - 2.0 * s20"}]
STOCH = [{"h14": hh(14), "l14": ll(14)}, {"sk": "100 * (close - l14) / nullif(h14 - l14, 0)"}, {"sd": sma(3, "sk")}]
ATRS = {f"ATR_{n}": atr(n) for n in (7, 10, 14, 20)}
MAS = (5, 8, 10, 13, 20, 21, 30, 50, 100, 200)
DON = {f"DONCHIAN_{k}_{n}": f(n) for n in (20, 50) for k, f in (("HIGH", hh), ("LOW", ll))}
KC = {"KC_MID": ema("close", span(20)), "KC_UPPER": f"{ema('close', span(20))} + 2.0 * {atr(20)}",
      "KC_LOWER": f"{ema('close', span(20))} - 2.0 * {atr(20)}"}
CHG = {"CHANGE": "dc", "CHANGE_PCT": "(close / pc - 1) * 100", "VOLATILITY": std(20)}


def recursive(cols: str, seed: str, step: str, out: str, src: list[dict]) -> str:
    """Row-by-row state over the staged bars `s`."""
    ctes = chain(BASE, START + src, "*")
    return (f"WITH RECURSIVE s AS MATERIALIZED ({ctes}), z({cols}) AS (SELECT {seed} FROM s WHERE i = 0 UNION ALL "
            f"SELECT {step} FROM z JOIN s ON s.symbol = z.symbol AND s.i = z.i + 1) {out}")


SUPER = recursive(
    "symbol, i, top, bot, d, sig, prev",
    "symbol, i, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 0, 0, close",
    """s.symbol, s.i,
    CASE WHEN z.top IS NULL THEN s.su WHEN s.su < z.top OR z.prev > z.top THEN s.su ELSE z.top END,
    CASE WHEN z.bot IS NULL THEN s.sl WHEN s.sl > z.bot OR z.prev < z.bot THEN s.sl ELSE z.bot END,
    CASE WHEN s.close > z.top THEN 1 WHEN s.close < z.bot THEN -1 ELSE z.d END,
    CASE WHEN s.close > z.top AND z.d = -1 THEN 1 WHEN NOT coalesce(s.close > z.top, false) AND s.close < z.bot AND z.d = 1 THEN -1 ELSE 0 END,
    s.close""", "", [{"atr10": atr(10)}, {"su": "(high + low) / 2 + 3.0 * atr10", "sl": "(high + low) / 2 - 3.0 * atr10"}])
PSAR = recursive(
    "symbol, i, bull, sar, ep, af, over1, was",
    "symbol, i, true, high, low, 0.02::DOUBLE, close > high, CAST(NULL AS BOOLEAN)",
    """q.symbol, q.i, CASE WHEN q.broke THEN NOT q.bull ELSE q.bull END, CASE WHEN q.broke THEN q.ep ELSE q.nsar END,
    CASE WHEN q.broke THEN CASE WHEN q.bull THEN q.low ELSE q.high END WHEN q.bull AND q.high > q.ep THEN q.high
         WHEN NOT q.bull AND q.low < q.ep THEN q.low ELSE q.ep END,
    CASE WHEN q.broke THEN 0.02::DOUBLE WHEN (q.bull AND q.high > q.ep) OR (NOT q.bull AND q.low < q.ep) THEN least(q.af + 0.02, 0.20::DOUBLE) ELSE q.af END,
    q.close > CASE WHEN q.broke THEN q.ep ELSE q.nsar END, q.over1""", "", ADX + [{"l2": "least(pl, coalesce(" + lag("low", 2) + ", pl))",
                                                                               "h2": "greatest(ph, coalesce(" + lag("high", 2) + ", ph))"}])
PSAR = PSAR.replace("FROM z JOIN s ON s.symbol = z.symbol AND s.i = z.i + 1) ", """FROM (
    SELECT s.*, z.bull, z.ep, z.af, z.over1, CASE WHEN z.bull THEN least(z.sar + z.af * (z.ep - z.sar), s.l2)
      ELSE greatest(z.sar + z.af * (z.ep - z.sar), s.h2) END AS nsar,
      CASE WHEN z.bull THEN s.low < least(z.sar + z.af * (z.ep - z.sar), s.l2)
      ELSE s.high > greatest(z.sar + z.af * (z.ep - z.sar), s.h2) END AS broke
    FROM z JOIN s ON s.symbol = z.symbol AND s.i = z.i + 1) q) """)
PSIG = "CASE WHEN s.adx > 20 AND over1 AND NOT coalesce(was, false) THEN 1 WHEN s.adx > 20 AND NOT over1 AND coalesce(was, true) THEN -1 ELSE 0 END"

# ---- regime ----------------------------------------------------------------------------------------------------------
_r = lambda fn, x, k, end=0: f"{fn}({x}) OVER {win(k, end)}"
COMP = ADX + [
    {"af": "coalesce(atr14, 0)", "ax": "coalesce(adx, 25)", "m20": sma(20), "sg": roll("stddev_pop", "close", 20)},
    {"ru": "m20 + 2.0 * sg", "rl": "m20 - 2.0 * sg"},
    {"bb_width": "CASE WHEN m20 > 1e-10 THEN (ru - rl) / m20 ELSE 0.0 END", "mv": _r("sum", "abs(dc)", 10),
     "ps": _r("sum", "CASE WHEN dc > 0 THEN 1 ELSE 0 END", 20), "ns": _r("sum", "CASE WHEN dc < 0 THEN 1 ELSE 0 END", 20),
     "hl": f"list({{'h': high, 'l': low}}) OVER {win(10)}", "apos": "CASE WHEN af > 0 THEN af END",
     "st": _r("max", "high", 20, -1), "sb": _r("min", "low", 20, -1), "sm": "CASE WHEN af > 0 THEN af * 0.1 ELSE 0.0 END",
     "rg": "CASE WHEN high - low > 1e-10 THEN high - low ELSE 0.0 END",
     "wk": "CASE WHEN high - low > 1e-10 THEN (high - greatest(open, close)) + (least(open, close) - low) ELSE 0.0 END",
     "fl": f"CASE WHEN sign(dc) * sign({lag('dc')}) < 0 THEN 1 ELSE 0 END"},
    {"wpos": "CASE WHEN bb_width > 0 THEN bb_width END",
     "efficiency": f"CASE WHEN i >= 10 AND mv > 1e-10 THEN abs(close - {lag('close', 10)}) / mv ELSE 0.0 END",
     "slope_consistency": "CASE WHEN i >= 20 THEN greatest(ps, ns) / 20 ELSE 0.0 END",
     "containment": "CASE WHEN i >= 20 AND sg > 1e-10 THEN len(list_filter(hl, lambda b: b.h <= ru AND b.l >= rl)) / 10 ELSE 0.0 END",
     "al": f"list(apos) FILTER (apos IS NOT NULL) OVER {win(100)}",
     "structure_break": """CASE WHEN i < 20 THEN 0.0 WHEN close > st + sm OR close < sb - sm THEN 1.0 WHEN sm > 0 THEN
        greatest(0.0, least(1.0, greatest((close - st) / (sm + 1e-10), (sb - close) / (sm + 1e-10)))) ELSE 0.0 END""",
     "whipsaw": f"CASE WHEN i >= 10 AND {_r('sum', 'rg', 10)} > 1e-10 THEN {_r('sum', 'wk', 10)} / {_r('sum', 'rg', 10)} ELSE 0.0 END",
     "direction_flips": f"CASE WHEN i >= 11 THEN {_r('sum', 'fl', 9)} / 9 ELSE 0.0 END"},
    {"wn": _r("count", "wpos", 200), "wt": f"quantile_cont(wpos, 0.2) OVER {win(200)}",
     "atr_percentile": "CASE WHEN i >= 100 AND len(al) > 10 AND af > 0 THEN len(list_filter(al, lambda a: a <= af)) / len(al) ELSE 0.0 END"},
    {"squeeze": """CASE WHEN i >= 200 AND wn > 10 AND bb_width > 0 THEN CASE WHEN bb_width <= wt THEN 1.0
        ELSE greatest(0.0, least(1.0, wt / bb_width)) END ELSE 0.0 END"""},
    {"rq": _r("max", "squeeze", 5, -1)},
    {"squeeze_release": "CASE WHEN i >= 5 AND rq > 0.5 AND squeeze < 0.5 THEN least(1.0, rq * (1 - squeeze) * 2) ELSE 0.0 END"}]
COMPONENTS = ("bb_width", "efficiency", "slope_consistency", "containment", "squeeze", "squeeze_release", "atr_percentile",
              "structure_break", "whipsaw", "direction_flips")
SCORE = COMP + [
    {"an": "CASE WHEN ax < 20 THEN ax / 40 WHEN ax < 40 THEN 0.5 + (ax - 20) / 40 ELSE least(1.0, 0.75 + (ax - 40) / 80) END",
     "am": "CASE WHEN ax < 15 THEN ax / 30 WHEN ax < 30 THEN 0.5 + (30 - abs(ax - 22.5)) / 30 ELSE greatest(0.0, 1.0 - (ax - 30) / 40) END"},
    {"r0": "0.40 * an + 0.35 * efficiency + 0.25 * slope_consistency", "r1": "0.35 * (1 - an) + 0.30 * (1 - efficiency) + 0.35 * containment",
     "r2": "0.35 * squeeze_release + 0.30 * atr_percentile + 0.35 * structure_break",
     "r3": "0.30 * am + 0.30 * (1 - efficiency) + 0.40 * (whipsaw * 0.5 + direction_flips * 0.5)", "ok": "i >= 200 AND n >= 210"},
    {f"s{k}": f"CASE WHEN ok AND r0 + r1 + r2 + r3 > 1e-10 THEN r{k} / (r0 + r1 + r2 + r3) ELSE 0.25 END" for k in range(4)},
    {"top": "greatest(s0, s1, s2, s3)"},
    {"raw": "CASE WHEN NOT ok THEN 'CHOP' WHEN s0 = top THEN 'TREND' WHEN s1 = top THEN 'RANGE' WHEN s2 = top THEN 'BREAKOUT' ELSE 'CHOP' END",
     "strength": "CASE WHEN ok THEN top ELSE 0.25 END", "gap": "CASE WHEN ok THEN top - list_sort([s0, s1, s2, s3])[3] ELSE 0.0 END"}]
_new = "s.raw <> z.cur AND s.gap >= 0.10"
_cnt = f"CASE WHEN {_new} THEN CASE WHEN s.raw = z.cand THEN z.seen + 1 ELSE 1 END ELSE 0 END"
_sw = f"({_cnt}) >= 2 AND z.held + 1 >= 3"
HYST = recursive("symbol, i, raw, cur, live, held, cand, seen", "symbol, i, raw, raw, CAST(NULL AS VARCHAR), 1, CAST(NULL AS VARCHAR), 0",
                 f"""s.symbol, s.i, s.raw, CASE WHEN {_sw} THEN s.raw ELSE z.cur END, z.cur, CASE WHEN {_sw} THEN 1 ELSE z.held + 1 END,
                 CASE WHEN {_new} AND NOT ({_sw}) THEN s.raw END, CASE WHEN {_sw} THEN 0 ELSE {_cnt} END""",
                 "SELECT z.symbol, s.ts, z.i AS bar_no, z.raw AS regime_raw, z.cur AS regime, "
                 "CASE WHEN s.n < 210 THEN 'CHOP' ELSE z.live END AS regime_live FROM z JOIN s USING (symbol, i)", SCORE)

ORACLES: dict[str, str] = {
    "bars_h1": f"SELECT symbol, ts, open, high, low, close, volume FROM ({event_bars('H1')})",
    "bars_daily_orders": """SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate)::TIMESTAMP AS ts,
        arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
        arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY 1, 2""",
    "true_range": shown(START, {"TR": "tr"}),
    "atr": shown(START, ATRS),
    "sma": shown([], {f"SMA_{n}": sma(n) for n in MAS}),
    "ema": shown([], {f"EMA_{n}": ema("close", span(n)) for n in MAS}),
    "rsi": shown(START + merge(*[rsi_levels(n, f"_{n}") for n in (7, 14, 21)]), {f"RSI_{n}": f"rsi_{n}" for n in (7, 14, 21)}),
    "bollinger": shown(BB, {"BB_MID_20": "m20", "BB_UPPER_20": "bbu", "BB_LOWER_20": "bbl"}),
    "macd": shown(macd_levels(12, 26, 9), {"MACD": "macd", "MACD_SIGNAL": "msig", "MACD_HIST": "mhist"}),
    "stochastic": shown(STOCH, {"STOCH_K": "sk", "STOCH_D": "sd"}),
    "adx_core": shown(START + ADX, {"ADX": "adx"}),
    "directional_core": shown(START + DI, {"PLUS_DI": "pdi", "MINUS_DI": "mdi"}),
    "adx_smoothed": shown(START + WADX, {"WADX_14": "wadx", "WPDI_14": "wpdi", "WMDI_14": "wmdi"}),
    "adx_seeded": shown(START + SADX, {"SADX_14": "xdx_s"}),
    "cci": shown(START + MAD, {"CCI": "(tp - tpm) / (0.015 * nullif(mad, 0))"}),
    "williams_r": shown(STOCH, {"WILLR": "-100 * (h14 - close) / nullif(h14 - l14, 0)"}),
    "donchian": shown([], DON),
    "keltner": shown(START, KC),
    "hull_ma": shown(hull(20), {"HULL_MA": "hull"}),
    "price_change": shown(START, CHG),
    "swing_points": chain(BASE, swing("close", 5, "c"), "symbol, ts, swhc AS swing_high, swlc AS swing_low"),
    "swing_state": shown(pivots(5), {k: f"last_value({v} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING)"
                                     for k, v in (("last_high", "pivh"), ("last_low", "pivl"))}),
    "percentile_rank": shown(START + [{"roc": f"(close / {lag('close', 10)} - 1) * 100", "a14": atr(14)}]
                             + merge(rank("roc", 100, "r"), rank("a14", 100, "a")), {"ROC_RANK": "rkr", "ATR_RANK": "rka"}),
    "vortex": shown(START + [{"vp": "abs(high - pl)", "vm": "abs(low - ph)"}],
                    {"VIP_14": f"{roll('sum', 'vp', 14)} / ({roll('sum', 'tr', 14)} + 1e-10)", "VIM_14": f"{roll('sum', 'vm', 14)} / ({roll('sum', 'tr', 14)} + 1e-10)"}),
    "trix": shown(TRIX, {"TRIX_12_9": "trix", "TRIXSIG_12_9": "tsig"}),
    "elder_power": shown([{"b": f"high - {ema('close', span(13))}", "c": f"low - {ema('close', span(13))}"}],
                         {"BULL_13_1": "b", "BEAR_13_1": "c", "BULL_13_3": ema("b", span(3)), "BEAR_13_3": ema("c", span(3))}),
    "aroon": shown(AROON, {"AROONU_25": "aru", "AROOND_25": "ard"}),
    "fisher": shown(FISHER, {"FISHER_10": "fish"}),
    "vwap_zscore": shown(START + VWAP, {"VWAP_50": "vw", "VWAPZ_50_50": "vz"}),
    "stoch_rsi": shown(START + STOCHRSI, {"K": "srk", "D": "srd"}),
    "obv": shown(START + OBV, {"obv": "obv", "obv_mean": "obvm"}),
    "parabolic_sar": PSAR + f" SELECT z.symbol, s.ts, {r('sar', D)} AS psar, {r(PSIG, D)} AS signal FROM z JOIN s USING (symbol, i)",
    "kaufman_ama": shown(START + KAMA, {"KAMA_10_2_30": "kama"}),
    "ichimoku": shown(ICHI, {"TENKAN": "ten", "KIJUN": "kij", "SENKOUA": "sa", "SENKOUB": "sb"}),
    "supertrend": SUPER + f" SELECT z.symbol, s.ts, {r('top', D)} AS upper, {r('bot', D)} AS lower, {r('d', D)} AS side, {r('sig', D)} AS signal FROM z JOIN s USING (symbol, i)",
    "feature_subset": None,
    "feature_table": shown(START + merge(*[rsi_levels(n, f"_{n}") for n in (7, 14, 21)], BB, macd_levels(12, 26, 9), STOCH, ADX, DI, MAD, hull(20)),
                           {**ATRS, **{f"SMA_{n}": sma(n) for n in MAS}, **{f"EMA_{n}": ema("close", span(n)) for n in MAS},
                            **{f"RSI_{n}": f"rsi_{n}" for n in (7, 14, 21)}, "BB_MID_20": "m20", "BB_UPPER_20": "bbu", "BB_LOWER_20": "bbl",
                            "MACD": "macd", "MACD_SIGNAL": "msig", "MACD_HIST": "mhist", "STOCH_K": "sk", "STOCH_D": "sd", "ADX": "adx",
                            "PLUS_DI": "pdi", "MINUS_DI": "mdi", "CCI": "(tp - tpm) / (0.015 * nullif(mad, 0))",
                            "WILLR": "-100 * (h14 - close) / nullif(h14 - l14, 0)", **DON, **KC, "HULL_MA": "hull", **CHG}),
    "warmup_zeroed": chain(BASE, START, "symbol, ts, CASE WHEN i < 19 THEN 0 ELSE coalesce(sign(dc), 0) END AS signal"),
    "helper_columns": shown(START + merge(rsi_levels(9), hull(9), macd_levels(8, 21, 7), [{"m10": sma(10), "s10": std(10), "h5": hh(5), "l5": ll(5)},
                                                                                          {"k5": "100 * (close - l5) / nullif(h5 - l5, 0)"}]),
                            {"EMA_7": ema("close", span(7)), "SMA_7": sma(7), "ATR_9": atr(9), "RSI_9": "rsi", "HULL_9": "hull",
                             "BBU_10_1p5": "m10 + 1.5 * s10", "BBL_10_1p5": "m10 - 1.5 * s10", "STOCHK_5": "k5", "STOCHD_5_5": sma(5, "k5"),
                             "MACD_8_21_7": "macd", "MACDHIST_8_21_7": "mhist"}),
    "regime_components": shown(START + COMP, {c: c for c in COMPONENTS}),
    "regime_scores": shown(START + SCORE, {"trend_score": "s0", "range_score": "s1", "breakout_score": "s2", "chop_score": "s3", "adx_norm": "an",
                                           "adx_mid": "am", "regime_strength": "strength", "regime_gap": "gap"}, "raw AS regime_raw, NOT ok AS regime_warmup"),
    "regime_hysteresis": HYST,
    "regime_params": """SELECT DISTINCT event_type AS symbol, 'H1' AS timeframe, CASE WHEN event_type = 'view' THEN 4 ELSE 2 END AS k_confirm,
        CASE WHEN event_type = 'view' THEN 0.2 ELSE 0.1 END::DOUBLE AS gap_min, CASE WHEN event_type = 'view' THEN 6 ELSE 3 END AS k_hold FROM events""",
}
_orders = numbered(ORACLES["bars_daily_orders"])
ORACLES["feature_subset"] = shown(START, {"ATR_14": atr(14), "EMA_50": ema("close", span(50)), "KC_UPPER": KC["KC_UPPER"],
                                          "DONCHIAN_HIGH_20": hh(20)}, base=_orders)

# ---- signals ---------------------------------------------------------------------------------------------------------


def over(a: str, b: str) -> str:
    return f"({a} > {b} AND {lag(a)} <= {lag(b)})"


def under(a: str, b: str) -> str:
    return f"({a} < {b} AND {lag(a)} >= {lag(b)})"


def rises(a: str, k: float) -> str:
    return f"({a} > {k} AND {lag(a)} <= {k})"


def falls(a: str, k: float) -> str:
    return f"({a} < {k} AND {lag(a)} >= {k})"


def turns(x: str) -> tuple[list[dict], str, str]:
    return [{"slope": f"{x} - {lag(x)}"}], rises("slope", 0), falls("slope", 0)


def diverge(x: str, k: int = 5) -> tuple[list[dict], str, str]:
    w = win(5 * k, -1)
    old = lambda mark, v: f"last_value(CASE WHEN {mark} THEN {v} END IGNORE NULLS) OVER {w}"
    return (swing("close", k, "c") + [{"lc": old("swlc", "close"), "lx": old("swlc", x), "hc": old("swhc", "close"), "hx": old("swhc", x)}],
            f"i >= {2 * k + 1} AND swlc AND close < lc AND {x} > lx", f"i >= {2 * k + 1} AND swhc AND close > hc AND {x} < hx")


def pending(t: str, event: str, level: str, k: int, good: str) -> list[dict]:
    """First bar within k of the latest event that meets `good` (which may use lvl_<t>)."""
    w = win(k, -1)
    last = lambda v: f"last_value(CASE WHEN {event} THEN {v} END IGNORE NULLS) OVER {w}"
    return [{f"at_{t}": f"CASE WHEN NOT {event} THEN {last('i')} END", f"lvl_{t}": f"CASE WHEN NOT {event} THEN {last(level)} END"},
            {f"ok_{t}": f"CASE WHEN {good} THEN at_{t} END"},
            {f"hit_{t}": f"ok_{t} IS NOT NULL AND coalesce(max(ok_{t}) OVER {w}, -1) < at_{t}"}]


CP = "(close - low) / (high - low + 1e-10)"
E = lambda n: {f"e{n}": ema("close", span(n))}
A14 = {"a14": atr(14)}
_t, _tl, _ts = turns("hull")
_k, _kl, _ks = turns("kama")
_rd, _rl, _rs = diverge("rsi")
_md, _ml, _ms = diverge("mhist")
_od, _ol, _os = diverge("obvm")
_dist = 'abs(pp - mm) / (pp + mm + 1e-10)'
_AT = [{"ap": "CASE WHEN up > -dl AND up > 0 THEN up ELSE 0.0 END", "a14": atr(14)}, {"amd": "CASE WHEN -dl > ap AND -dl > 0 THEN -dl ELSE 0.0 END"},
       {"pp": f"100 * ({roll('avg', 'ap', 14)} / nullif(a14, 0))", "mm": f"100 * ({roll('avg', 'amd', 14)} / nullif(a14, 0))"},
       {"atdx": f"100 * {_dist}"}, {"atx": roll("avg", "atdx", 14)}]
_KCX = lambda k: [{"e20": ema("close", span(20)), "a20": atr(20), "a14k": atr(14)},
                  {"ku": f"e20 + {k} * a20", "kl": f"e20 - {k} * a20", "fu": "e20 + 2.0 * a14k", "fl": "e20 - 2.0 * a14k"}]
_PIV = [{"h10": hh(10), "l10": ll(10), "a14": atr(14)}, {"top": lag("h10"), "bot": lag("l10"), "a0": "coalesce(a14, 0)"},
        {"el": "coalesce(i >= 11 AND close > top, false)", "es": "coalesce(i >= 11 AND close < bot, false)"}] + merge(
    pending("l", "el", "top", 5, "low <= lvl_l + 0.5 * a0 AND close > lvl_l"),
    pending("s", "es", "bot", 5, "high >= lvl_s - 0.5 * a0 AND close < lvl_s"))
_fill = lambda v: f"last_value({v} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING)"
_BOS = merge(pivots(5), [A14]) + [
    {"bh": "CASE WHEN i >= 34 THEN pivh END", "bl": "CASE WHEN i >= 34 THEN pivl END", "a0": "coalesce(a14, 0)"},
    {"th": _fill("bh"), "tl": _fill("bl")},
    {"bd": "CASE WHEN i >= 34 AND close < tl - 0.1 * a0 AND open - close > 1.2 * a0 THEN -1 WHEN i >= 34 AND close > th + 0.1 * a0 AND close - open > 1.2 * a0 THEN 1 END"},
    {"blv": "CASE WHEN bd = -1 THEN tl WHEN bd = 1 THEN th END", "ev": "bd IS NOT NULL", "pd": f"last_value(bd IGNORE NULLS) OVER {win(4, -1)}"}] + pending(
    "b", "ev", "blv", 4, "CASE WHEN pd = 1 THEN low <= lvl_b + 0.4 * a0 AND close > lvl_b ELSE high >= lvl_b - 0.4 * a0 AND close < lvl_b END")


def _pool(side: str, sign: str) -> list[dict]:
    p, edge = (("pivl", "low") if side == "l" else ("pivh", "-high"))
    return [{f"pool{side}": f"list_sort(list({sign}{p}) FILTER (i >= 60 AND {p} IS NOT NULL) OVER {win(41)})"},
            {f"tp{side}": f"list_filter(list_transform(range(1, greatest(len(pool{side}), 1)), lambda k: [pool{side}[k], pool{side}[k + 1]]), lambda q: q[2] - q[1] <= wd)"},
            {f"lv{side}": f"CASE WHEN i >= 60 AND len(tp{side}) > 0 THEN (tp{side}[1][1] + tp{side}[1][2]) / 2 END"},
            {f"swp{side}": f"coalesce({edge} < lv{side} - 0.1 * a0, false)"},
            {f"same{side}": f"swp{side} AND coalesce({sign}close > lv{side}, false)"}, {f"ev{side}": f"swp{side} AND NOT same{side}"}
            ] + pending(side, f"ev{side}", f"lv{side}", 2, f"i >= 60 AND {sign}close > lvl_{side}")


_SWEEP = merge(pivots(5), [A14]) + [{"a0": "coalesce(a14, 0)"}, {"wd": "CASE WHEN a0 > 0 THEN a0 * 0.1 * 8 ELSE 0.001 END"}] + merge(_pool("l", ""), _pool("h", "-"))
ZS = [{"m20": sma(20), "s20": std(20)}, {"z": "(close - m20) / (s20 + 1e-10)"}]

# name -> (levels after START, long, short, warm-up rows)
RULES: dict[str, tuple] = {
    "EMACrossover": ([{**E(10), **E(20)}], over("e10", "e20"), under("e10", "e20")),
    "MACDTrend": (macd_levels(12, 26, 9), over("macd", "msig"), under("macd", "msig")),
    "ADXTrend": (_AT, f"{over('pp', 'mm')} AND atx > 25", f"{over('mm', 'pp')} AND atx > 25"),
    "Ichimoku": (ICHI, f"{over('ten', 'kij')} AND close > greatest(sa, sb)", f"{under('ten', 'kij')} AND close < least(sa, sb)"),
    "HullMATrend": (hull(20) + _t, _tl, _ts),
    "AroonTrend": (AROON, f"{over('aru', 'ard')} AND aru > 70", f"{over('ard', 'aru')} AND ard > 70"),
    "ADXDIStrength": (merge(ADX, DI), f"{over('pdi', 'mdi')} AND adx > 20 AND adx > {lag('adx')} AND pdi - mdi > 5",
                      f"{over('mdi', 'pdi')} AND adx > 20 AND adx > {lag('adx')} AND mdi - pdi > 5"),
    "KeltnerPullback": ([E(20)], f"e20 > {lag('e20', 5)} AND close > e20 AND pl <= {lag('e20')} AND close > pc",
                        f"e20 < {lag('e20', 5)} AND close < e20 AND ph >= {lag('e20')} AND close < pc"),
    "EMARibbonADX": (merge(ADX, DI, [{**E(8), **E(21), **E(50)}]) + [
        {"rl": "coalesce(e8 > e21 AND e21 > e50 AND adx > 20 AND pdi > mdi, false)", "rs": "coalesce(e8 < e21 AND e21 < e50 AND adx > 20 AND mdi > pdi, false)"}],
        f"rl AND NOT coalesce({lag('rl')}, false)", f"rs AND NOT coalesce({lag('rs')}, false)"),
    "EMAPullbackContinuation": ([{**E(10), **E(30), **A14}], "e10 > e30 AND low <= e10 + 0.5 * a14 AND close > e10", "e10 < e30 AND high >= e10 - 0.5 * a14 AND close < e10"),
    "KaufmanAMATrend": (KAMA + _k, _kl, _ks),
    "VortexTrend": ([{"vp": "abs(high - pl)", "vm": "abs(low - ph)"}, {"vs": f"{roll('sum', 'vp', 14)} / ({roll('sum', 'tr', 14)} + 1e-10) - {roll('sum', 'vm', 14)} / ({roll('sum', 'tr', 14)} + 1e-10)"}],
                    rises("vs", 0.03), falls("vs", -0.03), 19),
    "ElderRayBullBear": ([{**E(13), **E(100)}, {"b": "high - e13", "c": "low - e13"}], f"{rises('c', 0)} AND e100 > {lag('e100')}", f"{falls('b', 0)} AND e100 < {lag('e100')}", 105),
    "RSIDivergence": (rsi_levels(14) + _rd, _rl, _rs),
    "MACDDivergence": (macd_levels(12, 26, 9) + _md, _ml, _ms),
    "OBVDivergence": (OBV + _od, _ol, _os),
    "RSIExtremes": (rsi_levels(14), rises("rsi", 30), falls("rsi", 70)),
    "BollingerBounce": (BB, "low <= bbl AND close > pc", "high >= bbu AND close < pc"),
    "ZScoreMR": (ZS, rises("z", -2.0), falls("z", 2.0)),
    "StochasticReversal": ([{"h14": hh(14), "l14": ll(14)}, {"k": "CASE WHEN h14 - l14 > 1e-8 THEN 100 * (close - l14) / (h14 - l14) ELSE 50.0 END"}, {"d": sma(3, "k")}],
                           f"{over('k', 'd')} AND k < 30", f"{under('k', 'd')} AND k > 70"),
    "CCIReversal": (MAD + [{"c": "(tp - tpm) / (0.015 * mad + 1e-10)"}], rises("c", -100), falls("c", 100)),
    "WilliamsR": ([{"h14": hh(14), "l14": ll(14)}, {"w": "CASE WHEN h14 - l14 > 1e-8 THEN -100 * (h14 - close) / (h14 - l14) ELSE -50.0 END"}], rises("w", -80), falls("w", -20)),
    "FisherTransformMR": (FISHER, rises("fish", -1.5), falls("fish", 1.5)),
    "ZScoreVWAPReversion": (merge(VWAP, ADX), f"adx < 25 AND {rises('vz', -2.0)}", f"adx < 25 AND {falls('vz', 2.0)}"),
    "RSITrendFilteredMR": (merge(rsi_levels(14), [E(200)]), f"close > e200 AND {rises('rsi', 30)}", f"close < e200 AND {falls('rsi', 70)}"),
    "StochRSITrendGate": (merge(STOCHRSI, [E(200)]), f"close > e200 AND {over('srk', 'srd')} AND srk < 20 AND srd < 20", f"close < e200 AND {under('srk', 'srd')} AND srk > 80 AND srd > 80"),
    "TurtleSoupReversal": ([{"h20": hh(20), "l20": ll(20)}],
                           f"(coalesce(pl < {lag('l20', 2)}, false) OR coalesce({lag('low', 2)} < {lag('l20', 3)}, false)) AND close > {lag('l20')}",
                           f"(coalesce(ph > {lag('h20', 2)}, false) OR coalesce({lag('high', 2)} > {lag('h20', 3)}, false)) AND close < {lag('h20')}"),
    "PinBarReversal": (merge(BB, [A14]) + [{"body": "greatest(abs(close - open), 1e-10)"},
                       {"pbl": "coalesce((least(open, close) - low) / body > 2.5 AND low <= bbl + a14, false)", "pbs": "coalesce((high - greatest(open, close)) / body > 2.5 AND high >= bbu - a14, false)"}],
                       lag("pbl"), lag("pbs")),
    "EngulfingPattern": (merge(BB, ADX), "pc < po AND close > open AND open <= pc AND close >= po AND low <= bbl + atr14 AND adx < 30",
                         "pc > po AND close < open AND open >= pc AND close <= po AND high >= bbu - atr14 AND adx < 30"),
    "KeltnerFade": (merge(_KCX(2.0), ADX), f"pl <= {lag('fl')} AND close > fl AND adx < 25", f"ph >= {lag('fu')} AND close < fu AND adx < 25"),
    "ROCExhaustionReversal": ([{"roc": f"(close / {lag('close', 10)} - 1) * 100"}] + rank("roc", 100, "r"), f"rkr > 10 AND {lag('rkr')} <= 10", f"rkr < 90 AND {lag('rkr')} >= 90"),
    "DonchianBreakout": ([{"h20": hh(20), "l20": ll(20)}], f"close > {lag('h20')}", f"close < {lag('l20')}"),
    "VolatilityBreakout": ([{"a20": atr(20)}], "dc > a20", "dc < -a20"),
    "MomentumBurst": ([{"roc": f"(close / {lag('close', 10)} - 1) * 100"}], "roc > 1.0", "roc < -1.0"),
    "SqueezeBreakout": (merge(BB, _KCX(1.5)) + [{"on1": "coalesce(bbl > kl AND bbu < ku, false)"}], f"NOT on1 AND coalesce({lag('on1')}, false) AND close > m20", f"NOT on1 AND coalesce({lag('on1')}, false) AND close < m20"),
    "KeltnerBreakout": (_KCX(2.0), "close > ku", "close < kl"),
    "PivotBreakout": (_PIV, "hit_l", "hit_s"),
    "MACDHistogramMomentum": (merge(macd_levels(12, 26, 9), [E(50)]), f"{rises('mhist', 0)} AND close > e50", f"{falls('mhist', 0)} AND close < e50"),
    "InsideBarBreakout": ([], "high < ph AND low > pl AND close > ph", "high < ph AND low > pl AND close < pl"),
    "NarrowRangeBreakout": ([{"hr": "high - low"}, {"nr": f"coalesce(hr = {roll('min', 'hr', 7)} AND hr > 0, false)"}], f"coalesce({lag('nr')}, false) AND close > ph", f"coalesce({lag('nr')}, false) AND close < pl"),
    "VolumeSpikeMomentum": ([], f"volume > 2.0 * {sma(20, 'volume')} AND {CP} > 0.7", f"volume > 2.0 * {sma(20, 'volume')} AND {CP} < 0.3"),
    "ATRPercentileBreakout": ([A14] + rank("a14", 100, "a"), f"rka >= 70 AND {lag('rka')} <= 20 AND {CP} > 0.6", f"rka >= 70 AND {lag('rka')} <= 20 AND {CP} < 0.4"),
    "TRIXMomentum": (TRIX, over("trix", "tsig"), under("trix", "tsig"), 50),
    "LiquiditySweepReversal": (_SWEEP, "samel OR hit_l", "sameh OR hit_h"),
    "MarketStructureBOSPullback": (_BOS, "hit_b AND pd = 1", "hit_b AND pd = -1"),
}
PARAMS: dict[str, str] = {}


def rule_sql(name: str, phash: str) -> str:
    levels, long, short, *warm = RULES[name]
    sig = f"CASE WHEN coalesce({short}, false) THEN -1 WHEN coalesce({long}, false) THEN 1 ELSE 0 END"
    if warm:
        sig = f"CASE WHEN i < {warm[0]} AND n > {warm[0]} THEN 0 ELSE {sig} END"
    return chain(BASE, START + levels, f"symbol, ts, i AS bar_no, '{name}Strategy' AS strategy_name, '{phash}' AS param_hash, {sig} AS signal")


def phash(params: dict) -> str:
    return hashlib.sha256(json.dumps(params, sort_keys=True).encode()).hexdigest()[:16]


def signal_oracles(params_of) -> dict[str, str]:
    """`params_of(name)` gives the default parameters a rule is identified by."""
    out = {f"signals_{n}": rule_sql(n, phash(params_of(f"{n}Strategy"))) for n in RULES}
    tail = "FROM z JOIN s USING (symbol, i)"
    for n, sql, sig in (("Supertrend", SUPER, "sig"), ("ParabolicSARTrend", PSAR, PSIG)):
        out[f"signals_{n}"] = sql + (f" SELECT z.symbol, s.ts, z.i AS bar_no, '{n}Strategy' AS strategy_name, "
                                     f"'{phash(params_of(f'{n}Strategy'))}' AS param_hash, {sig} AS signal {tail}")
    return out
