"""Reference SQL of ingest, resampling, specifications, tags and exports."""

from __future__ import annotations

from oracles.common import SECS, event_bars, lag, numbered, r, roll
from oracles.evidence import CAND, L, PRESETS, RG, SINGLE, ledger
from oracles.ledger import followed
from oracles.series import BASE, START, chain

H1 = event_bars("H1")
_k = "CAST(epoch(ts) AS BIGINT) // 3600 % 17"
RAW = f"""raw AS (SELECT symbol, ts, open, CASE WHEN {_k} = 3 THEN NULL ELSE high END AS high, CASE WHEN {_k} = 5 THEN high + 1 ELSE low END AS low,
  CASE WHEN {_k} = 7 THEN NULL ELSE close END AS close, CASE WHEN {_k} = 9 THEN volume * 2 ELSE volume END AS volume FROM ({H1}))"""


def resampled(tfs: list[str]) -> str:
    """Straight from the five-minute bars to each timeframe."""
    part = []
    for t in tfs:
        if t == "W1":
            b = "(CAST(ts AS DATE) + CAST((7 - dayofweek(ts)) % 7 AS INTEGER))::TIMESTAMP"
        else:
            s = SECS[t] * 1000000
            b = f"make_timestamp(CAST(epoch_us(ts) // {s} AS BIGINT) * {s})"
        part.append(f"SELECT symbol, '{t}' AS timeframe, {b} AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, "
                    f"sum(volume) AS volume FROM b GROUP BY 1, 2, 3")
    return f"WITH b AS ({event_bars('M5').replace(' AS ts,', ' AS t5,', 1)}), b2 AS (SELECT * RENAME (t5 AS ts) FROM b) " + " UNION ALL ".join(p.replace("FROM b ", "FROM b2 ") for p in part)


SYMBOLS = ["EURUSD", "usdjpy.x", "XAUUSD", "GBPJPY#m", "ABCXYZ", "US100", "NEWFX", "BTCUSD"]
QUOTES = f"""q AS (SELECT o_orderkey AS trade_id, {SYMBOLS!r}[o_custkey % 8 + 1] AS symbol, o_totalprice / 100000 AS mid, o_orderkey % 2 = 0 AS is_long,
  5.0::DOUBLE + o_custkey % 50 AS sl_pips, 10.0::DOUBLE + o_custkey % 70 AS tp_pips, o_orderkey % 12345 / 100.0 AS volume, 500 + o_totalprice / 10 AS equity FROM orders)"""
# worked out by hand from the resolution rules: pip position, pip value, spread, least lot, most lots, commission, swaps, tick size,
# tick value, contract, step, stops level, point, digits
_SPEC = [
    ("EURUSD", "built_in", 4, 10.0, 1.0, 0.01, 100, 6.5, -6.5, 1.2, 1e-5, 1.0, 100000, 0.01, 0, 1e-5, 5),
    ("usdjpy.x", "built_in", 2, 9.0, 1.0, 0.01, 100, 6.5, 8.5, -15, 1e-5, 0.009, 100000, 0.01, 0, 1e-5, 5),
    ("XAUUSD", "broker", 2, 1.0, 25.0, 0.01, 50, 7.0, 0, 0, 0.01, 1.0, 100, 0.1, 10, 0.01, 2),
    ("GBPJPY#m", "config", 2, 9.0, 3.3, 0.01, 100, 6.5, 8.5, -15, 1e-5, 0.009, 100000, 0.01, 0, 1e-5, 5),
    ("ABCXYZ", "generic", 4, 10.0, 2.0, 0.01, 100, 6.5, 0, 0, 1e-5, 1.0, 100000, 0.01, 0, 1e-5, 5),
    ("US100", "built_in", 0, 1.0, 2.0, 0.01, 100, 6.5, 0, 0, 1e-5, 1e-5, 100000, 0.01, 0, 1e-5, 5),
    ("NEWFX", "config", 2, 2.5, 1.7, 0.01, 100, 6.5, 0, 0, 1e-3, 0.25, 100000, 0.01, 0, 1e-3, 3),
    ("BTCUSD", "broker", 2, 10.0, 0.2, 0.01, 5, 7.0, 0, 0, 1e-3, 1.0, 1, 0.01, 0, 1e-3, 3)]
SPECS = "sp(symbol, spec_source, pip_position, pip_value, spread_avg, min_lot, max_lot, commission_per_lot, swap_long, swap_short, tick_size, tick_value, contract_size, " \
        "volume_step, stops_level, point, digits) AS (VALUES " + ", ".join(
            f"('{x[0]}', '{x[1]}', {x[2]}, " + ", ".join(f"{v!r}::DOUBLE" for v in x[3:14]) + f", {x[14]}, {x[15]!r}::DOUBLE, {x[16]})" for x in _SPEC) + ")"
_doubles = ("pip_value", "spread_avg", "min_lot", "max_lot", "commission_per_lot", "swap_long", "swap_short", "tick_size", "tick_value", "contract_size", "volume_step", "point")
PIP = "pow(10.0, -pip_position)"
PRICED = f"""WITH {QUOTES}, {SPECS}, a AS (SELECT *, {PIP} AS pip, spread_avg / 2.0 * {PIP} AS hs, CASE WHEN is_long THEN 1 ELSE -1 END AS d FROM q JOIN sp USING (symbol)),
  b AS (SELECT *, mid + d * hs AS entry, mid + d * (hs + 0.5 * pip) AS entry_slipped, mid * 1.01 - d * hs AS exit FROM a),
  c AS (SELECT *, entry - d * sl_pips * pip AS stop, entry + d * tp_pips * pip AS target, (exit - entry) * d / pip AS pips FROM b),
  e AS (SELECT *, CASE WHEN tick_size > 0 AND tick_value > 0 THEN (exit - entry) * d / tick_size * tick_value * volume ELSE pips * volume * pip_value END AS tick_profit,
    abs(CASE WHEN tick_size > 0 AND tick_value > 0 THEN (stop - entry) * d / tick_size * tick_value * volume ELSE (stop - entry) * d / pip * volume * pip_value END) AS loss,
    CASE WHEN stops_level > 0 AND point > 0 THEN stops_level * point ELSE 0 END AS min_stop FROM c)"""
_raw_size = "CASE WHEN tick_value > 0 AND tick_size > 0 THEN equity * 0.01 / (sl_pips * pip / tick_size * tick_value) ELSE equity * 0.01 / (sl_pips * pip_value) END"
_step = "floor(greatest(0.01, least(max_lot, rs)) / volume_step) * volume_step"
_TAG = """CASE o_orderkey % 9 WHEN 0 THEN 'PM:' || o_orderpriority || ':H1:EMACrossoverStrategy:LONG' WHEN 1 THEN 'PM2:' || o_orderpriority || ':H1:v17f2:L:2:' || o_custkey
  WHEN 2 THEN 'PM3:' || o_orderpriority || ':D1:v17f2:sell:' || o_custkey WHEN 3 THEN 'PM3:' || o_orderpriority || ':D1:v17f2' WHEN 4 THEN 'PM_' || o_orderstatus
  WHEN 5 THEN '' WHEN 6 THEN NULL WHEN 7 THEN 'PM2:' || o_orderpriority || ':H4:abc12:S:1' ELSE 'hello:world' END"""
_dir = lambda x: f"CASE WHEN upper(trim({x})) IN ('L', 'LONG', 'BUY', '1') THEN 'LONG' WHEN upper(trim({x})) IN ('S', 'SHORT', 'SELL', '-1') THEN 'SHORT' ELSE nullif(upper(trim({x})), '') END"
_names = {g: n for g, n in zip("1234567", ("G1_min_trades", "G2_max_drawdown", "G3_train_profitability", "G4_val_return", "G5_return_dd_ratio", "G6_val_profit_factor", "G7_robustness_gap"))}
_all = {**PRESETS, **SINGLE}
_slots = ", ".join(f"('{n}', {m.count('1')}, '{', '.join('G' + str(i + 1) for i in range(7) if m[i] == '1') or 'none'}', '{','.join(_names[str(i + 1)] for i in range(7) if m[i] == '1')}')"
                   for n, m in _all.items())

ORACLES: dict[str, str] = {
    "clean_bars": f"WITH {RAW} SELECT symbol, ts, open, high, low, close, volume FROM raw WHERE high IS NOT NULL AND close IS NOT NULL",
    "bar_quality": f"WITH {RAW} SELECT symbol, count(*) AS rows, count(*) FILTER (high IS NULL OR close IS NULL) AS dropped, "
                   "count(*) FILTER (high IS NOT NULL AND close IS NOT NULL AND (high < low OR high < open OR high < close OR low > open OR low > close)) AS invalid FROM raw GROUP BY symbol",
    "discover_symbols": f"SELECT symbol, count(*) AS rows FROM ({H1}) WHERE symbol <> 'error' GROUP BY 1 HAVING count(*) >= 10",
    "series_coverage": f"SELECT symbol, count(*) AS rows, min(ts) AS min_ts, max(ts) AS max_ts FROM ({H1}) GROUP BY 1",
    "bars_min_length": "SELECT o_orderpriority AS symbol, count(DISTINCT date_trunc('day', o_orderdate)) AS bars FROM orders GROUP BY 1 HAVING count(DISTINCT date_trunc('day', o_orderdate)) >= 500",
    "resample_six": resampled(["M5", "M15", "M30", "H1", "H4", "D1"]),
    "resample_weekly": resampled(["W1"]),
    "train_val_split": f"""WITH n AS ({numbered(H1)}) SELECT symbol, i AS bar_no, 'train' AS split, i AS split_bar FROM n WHERE i < CAST(trunc(n * 0.8::DOUBLE) AS BIGINT)
        UNION ALL SELECT symbol, i, 'val', i - CAST(trunc(n * 0.7::DOUBLE) AS BIGINT) FROM n WHERE i >= CAST(trunc(n * 0.7::DOUBLE) AS BIGINT)""",
    "decision_time_shift": chain(BASE, [], f"symbol, ts, {lag('close')} AS close_live"),
    "spec_resolution": f"WITH {SPECS} SELECT * REPLACE ({', '.join(f'{r(x, 8)} AS {x}' for x in _doubles)}) FROM sp",
    "spec_inheritance": f"""WITH {QUOTES}, e(key, pip_position, pip_value, spread_avg, min_lot, commission_per_lot, digits) AS (VALUES
        ('NEWFX', 2, 2.5::DOUBLE, 1.7::DOUBLE, 0.01::DOUBLE, 6.5::DOUBLE, 3), ('GBPJPY', 2, 9, 3.3, 0.01, 6.5, 5), ('CHILD', 2, 2.5, 1.7, 0.1, 6.5, 3)),
        c AS (SELECT upper(split_part(split_part(symbol, '.', 1), '#', 1)) AS key, count(*) AS quotes FROM q GROUP BY 1) SELECT e.*, quotes FROM e LEFT JOIN c USING (key)""",
    "price_arithmetic": PRICED + " SELECT trade_id, symbol, " + ", ".join(f"{r(x, 4)} AS {x}" for x in (
        "entry", "stop", "target", "entry_slipped", "exit", "tick_profit", "pips")) + f", {r('pips * volume * pip_value', 4)} AS pip_profit, {r('loss', 4)} AS loss, {r('min_stop', 4)} AS min_stop FROM e",
    "volume_and_size": PRICED + f", f AS (SELECT *, {_raw_size} AS rs FROM e) SELECT trade_id, {r('greatest(min_lot, least(max_lot, floor(volume / volume_step) * volume_step))', 6)} AS rounded, "
                                f"{r(f'CASE WHEN rs < min_lot OR {_step} < min_lot THEN 0 ELSE {_step} END', 6)} AS size FROM f",
    "atr_stop_distances": chain(BASE, START + [{"a": roll("avg", "tr", 14)}],
                                f"symbol, ts, {r('CASE WHEN a IS NOT NULL THEN greatest(5.0, a / 0.1::DOUBLE * 2.0) END', 4)} AS sl_pips, {r('CASE WHEN a IS NOT NULL THEN greatest(10.0, a / 0.1::DOUBLE * 3.0) END', 4)} AS tp_pips"),
    "mark_to_market": f"""WITH {followed()}, m AS (SELECT l.symbol, l.trade_id, b.i AS bar_no, (b.close - ep) * d / 0.1::DOUBLE AS pips
        FROM left_ l JOIN b ON b.symbol = l.symbol AND b.i BETWEEN l.trade_id AND l.trade_id + bars_held)
        SELECT symbol, trade_id, bar_no, {r('pips', 2)} AS unrealised_pips, {r('pips * 0.5 * 2.0', 2)} AS unrealised_dollars,
        {r('greatest(0.0::DOUBLE, max(pips) OVER (PARTITION BY symbol, trade_id ORDER BY bar_no ROWS UNBOUNDED PRECEDING))', 2)} AS best_pips FROM m""",
    "signal_contract": "SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN 0 ELSE CAST(trunc(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, value / 40 - 2))) AS INTEGER) END AS signal FROM events",
    "tag_decode": f"""WITH t AS (SELECT o_orderkey, {_TAG} AS c FROM orders), p AS (SELECT *, str_split(c, ':') AS a FROM t),
        f AS (SELECT *, len(a) AS n, a[1] IN ('PM2', 'PM3') AND len(a) >= 4 AS cm, a[1] = 'PM' AND len(a) >= 5 AS pl, c LIKE 'PM\\_%' ESCAPE '\\' AND length(c) > 3 AS old FROM p)
        SELECT o_orderkey, coalesce(cm OR pl OR old, false) AS is_tag, CASE WHEN cm OR pl THEN a[2] END AS symbol, CASE WHEN cm OR pl THEN a[3] END AS timeframe,
        CASE WHEN cm THEN a[4] END AS strategy_code, CASE WHEN pl THEN a[4] END AS strategy_name, CASE WHEN old AND NOT cm AND NOT pl THEN substr(c, 4) END AS strategy_tag,
        CASE WHEN (cm OR pl) AND n >= 5 THEN {_dir('a[5]')} END AS direction, CASE WHEN cm AND (n >= 7 OR (n = 6 AND a[1] = 'PM2')) THEN TRY_CAST(a[6] AS INTEGER) END AS tier,
        CASE WHEN cm AND n >= 7 THEN TRY_CAST(a[7] AS INTEGER)::DOUBLE / 10 WHEN cm AND n = 6 AND a[1] = 'PM3' THEN TRY_CAST(a[6] AS INTEGER)::DOUBLE / 10 END AS risk_pct FROM f""",
    "seeds_and_hashes": """SELECT p_partkey, CAST(('0x' || substr(sha256('set1|' || p_brand || '|H1|' || p_type || '|1'), 1, 8)) AS BIGINT) & 2147483647 AS seed,
        substr(sha256('{"p_size": ' || p_size || '}'), 1, 16) AS param_hash, sha256(p_brand || ':' || p_type || ':' || p_name) AS cache_key, upper(p_name) AS norm FROM part""",
    "slot_index": f"WITH {CAND}, h AS (SELECT symbol, timeframe, count(DISTINCT (strategy_name, param_hash)) AS k FROM cand GROUP BY ALL) SELECT s.symbol, t.timeframe, coalesce(k, 0) AS candidate_count, "
                  "CASE WHEN k IS NULL THEN 'pending' ELSE 'complete' END AS status FROM (SELECT DISTINCT symbol FROM cand) s CROSS JOIN (VALUES ('H1'), ('H4'), ('D1')) t(timeframe) "
                  "LEFT JOIN h ON h.symbol = s.symbol AND h.timeframe = t.timeframe",
    "no_trade_reasons": L + """, u AS (SELECT preset, timeframe, outcome, reason, nc FROM led UNION ALL
        SELECT preset, 'H1', 'NO_TRADE', 'slot is pending', 0 FROM presets, (SELECT DISTINCT symbol FROM cand), (VALUES (1), (2), (3), (4)) x)
        SELECT preset, timeframe, outcome, reason, count(*) AS slots, sum(nc) AS candidates FROM u GROUP BY ALL""",
    "candidate_wide": f"WITH {CAND} SELECT symbol, timeframe, strategy_name, param_hash, " + ", ".join(
        f"max({m}) FILTER (regime = '{g}') AS {g}_{m}" for g in RG for m in ("train_trades", "val_trades", "val_pf", "val_return")) + " FROM cand GROUP BY ALL",
    "rejection_json": L + """, x AS (SELECT preset, symbol, timeframe, regime, string_agg(strategy_name, ',' ORDER BY rk) AS rejected FROM rej GROUP BY ALL)
        SELECT led.preset, led.symbol, led.timeframe, led.regime, outcome, coalesce(rejected, '') AS rejected, len(binding) AS binding FROM led LEFT JOIN x USING (preset, symbol, timeframe, regime)""",
    "preset_catalogue": f"WITH {ledger(True)}, n(preset, gate_count, active_gates, gate_names) AS (VALUES {_slots}), k AS (SELECT preset, count(*) AS total_slots FROM led GROUP BY 1) SELECT n.*, total_slots FROM n JOIN k USING (preset)",
    "rule_catalogue": f"""WITH b AS (SELECT symbol, count(*) AS k FROM ({H1}) GROUP BY 1) SELECT symbol, category, rules, k * rules AS most_signals
        FROM b, (VALUES ('trend_following', 18), ('mean_reversion', 18), ('breakout_momentum', 14)) v(category, rules)""",
    "user_extensions": f"WITH {ledger(False, None)}" + f""", b AS ({chain(BASE, START, '*')}), s AS (SELECT symbol, count(*) FILTER (dc > 5) AS ups, count(*) FILTER (dc < -5) AS downs FROM b GROUP BY 1),
        g AS (SELECT count(*) FILTER (val_win_rate < 50) AS x1_failed, count(*) FILTER (NOT (val_win_rate < 50) AND val_trades >= 5) AS passed FROM ranked) SELECT * FROM s, g""",
}
