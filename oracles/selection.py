"""Reference SQL of scores, validation, selection, bookkeeping and replicated studies."""

from __future__ import annotations

from oracles.common import r
from oracles.evidence import PRESETS, SALES, clip, failed, metrics, preset_cte, selection
from oracles.ledger import TR
from oracles.ledger import metrics as full_metrics

def full_selection() -> str:
    """The selection score over the columns of full metrics."""
    k = lambda n: f"coalesce({n}, 0)::DOUBLE"
    mean = f"({k('avg_win')} * {k('win_rate')} / 100 - {k('avg_loss')} * (1 - {k('win_rate')} / 100))"
    return selection("").replace(mean, "expectancy_pips").replace("_approx", "_ratio")


_SPLITS = "sp AS (SELECT *, 'train' AS split, 0 AS lo, te AS hi FROM s0 WHERE i < te UNION ALL SELECT *, 'val', vs, n FROM s0 WHERE i >= vs)"
_WINDOWS = """wn AS (SELECT symbol, any_value(n) AS wn, any_value(vs) AS t0 FROM s0 GROUP BY symbol),
wd AS (SELECT symbol, p, p * 6 AS stp, wn, unnest(range(t0, wn - p * 24, p * 6)) AS st FROM wn, (VALUES (7), (14), (30), (60), (90)) v(p) WHERE p * 24 <= wn * 0.8),
wk AS (SELECT symbol, p || '@' || st AS split, st AS lo, least(wn, st + stp) AS hi FROM wd WHERE least(p * 24, st) >= 50 AND least(wn, st + stp) - st >= 10),
sp AS (SELECT s0.*, wk.split, wk.lo, wk.hi FROM s0 JOIN wk ON wk.symbol = s0.symbol AND i >= wk.lo AND i < wk.hi)"""
#: Every test window as a split with a ledger of its own, then its selection score.
WALKED = f"""SELECT symbol, CAST(split_part(split, '@', 1) AS INTEGER) AS period_days, CAST(split_part(split, '@', 2) AS BIGINT) AS start, total_trades, {full_selection()} AS score
FROM ({full_metrics(rows=TR.replace(_SPLITS, _WINDOWS))}) WHERE strategy_name = 'EMACrossoverStrategy'"""

RULE = "symbol, timeframe, strategy_name, param_hash"
_M = ("total_trades", "win_rate", "profit_factor", "total_pnl", "gross_profit", "gross_loss", "avg_win", "avg_loss", "sharpe_approx",
      "max_drawdown_pct", "total_return_pct", "max_consecutive_losses", "calmar_ratio", "mean_r", "worst_5pct_r", "sortino_approx")


def c(p: str, n: str, d: str = "0") -> str:
    return f"coalesce({p}{n}, {d})::DOUBLE"


def composite(p: str) -> str:
    k = lambda n, d="0": c(p, n, d)
    body = (f"{clip(k('sharpe_approx') + ' / 2.0 * 100', 0, 100)} * 0.25 + {clip('(' + k('profit_factor') + ' - 1) / 2.0 * 100', 0, 100)} * 0.20 + "
            f"{clip('(' + k('win_rate') + ' - 40) / 30 * 100', 0, 100)} * 0.15 + {clip(k('total_return_pct'), 0, 100)} * 0.15 + "
            f"greatest(0.0::DOUBLE, 100 - {k('max_drawdown_pct', '100')} / 30 * 100) * 0.15 + {clip('(' + k('total_trades') + ' - 20) / 80 * 100', 0, 100)} * 0.10")
    return f"CASE WHEN {k('total_trades')} < 15 THEN 0 ELSE {r(body, 2)} END"


def optimisation(p: str) -> str:
    k = lambda n, d="0": c(p, n, d)
    ra = f"(0.6 * {clip(k('sharpe_approx'), -2, 5)} + 0.4 * {clip(k('sortino_approx'), -2, 5)})"
    return (f"(({ra} * 30.0 + least({k('total_return_pct')}, 500) * 0.1 + {clip(k('profit_factor'), 0, 5)} * 2.0 + {k('win_rate')} / 100.0 * 5.0) "
            f"* exp(-0.03 * {k('max_drawdown_pct', '100')}))")


def criteria(p: str) -> str:
    k = lambda n, d="0": c(p, n, d)
    return (f"CASE WHEN {k('total_trades')} < 15 THEN 'few_trades' WHEN {k('win_rate')} < 30 THEN 'Low win rate' WHEN {k('profit_factor')} < 0.8 THEN "
            f"'Low profit factor' WHEN {k('sharpe_approx')} < -1 THEN 'Low Sharpe ratio' WHEN {k('max_drawdown_pct', '100')} > 60 THEN 'deep_drawdown' ELSE 'OK' END")


def ineligible(p: str) -> str:
    k = lambda n, d="0": c(p, n, d)
    return (f"CASE WHEN {k('profit_factor')} < 0.9 THEN 'train PF' WHEN {k('total_return_pct')} < -5 THEN 'train return' "
            f"WHEN {k('max_drawdown_pct', '100')} > 30 THEN 'train DD' END")


def pairs(keys: str) -> str:
    """CTEs ending in `pp`: train and validation metrics side by side with every paired score."""
    side = lambda s: ", ".join(f"{s}.{m} AS {s}_{m}" for m in _M)
    gen = lambda t, v: f"(({v}) - 0.70 * greatest(0.0::DOUBLE, ({t}) - ({v}))) * (0.85 + 0.15 * least(1.25::DOUBLE, ratio))"
    stab = lambda vn: (f"(0.7 + 0.3 * (0.3 * least(1.0::DOUBLE, ln(1 + {c('train_', 'total_trades')}) / ln(17.0::DOUBLE)) "
                       f"+ 0.7 * least(1.0::DOUBLE, ln(1 + {vn}) / ln(7.0::DOUBLE))))")
    vn = c("val_", "total_trades")
    pick = lambda n: f"CASE WHEN {vn} >= 3 THEN {c('val_', n)} ELSE {c('train_', n)} END"
    robust = (f"CASE WHEN {vn} >= 3 THEN CASE WHEN {c('train_', 'profit_factor')} > 0 THEN least(1.0::DOUBLE, {c('val_', 'profit_factor')} / "
              f"({c('train_', 'profit_factor')} + 0.1)) ELSE 0.5 END ELSE 0.7 END")
    legacy = (f"(least({pick('profit_factor')}, 5) * 20 + {pick('win_rate')} / 100 * 30 + {clip(pick('sharpe_approx'), -2, 3)} * 15 "
              f"+ least({pick('total_pnl')} / 50, 20) + ({robust}) * 20) * {stab(vn)}")
    return f"""{SALES}, {metrics(keys + ', split')},
      p0 AS (SELECT {', '.join('train.' + k for k in keys.split(', '))}, {side('train')}, {side('val')} FROM (FROM bm WHERE split = 'train') train
             LEFT JOIN (FROM bm WHERE split = 'val') val USING ({keys})),
      p1 AS (SELECT *, {selection('train_')} AS ts, {selection('val_')} AS vs, {optimisation('train_')} AS tso, {optimisation('val_')} AS vso FROM p0),
      p2 AS (SELECT *, least(2.0::DOUBLE, greatest(0.0::DOUBLE, vs / CASE WHEN abs(ts) > 1e-9 THEN ts ELSE 1e-9 END)) AS ratio FROM p1),
      pp AS (SELECT *, {gen('ts', 'vs')} AS general, {gen('tso', 'vso')} AS general_opt, ts * 0.7 * {stab('0')} AS rst,
        CASE WHEN {c('train_', 'sharpe_approx')} <= 0 THEN 0 ELSE {r(f"least({c('val_', 'sharpe_approx')} / train_sharpe_approx, 2)", 3)} END AS srob,
        CASE WHEN {vn} >= 3 THEN {gen('ts', 'vs')} * {stab(vn)} ELSE ts * 0.7 * {stab(vn)} END AS rs, {legacy} AS legacy,
        coalesce(val_max_drawdown_pct, 100) AS vdd, train_max_drawdown_pct AS tdd, coalesce(val_total_return_pct, -100) AS vret,
        coalesce(val_total_return_pct, -100) / greatest(coalesce(val_max_drawdown_pct, 100), 0.5) AS eff FROM p2)"""


PR = "WITH " + pairs(RULE)
RP = "WITH " + pairs(RULE + ", regime")
VN, VPF, VSH = c("val_", "total_trades"), c("val_", "profit_factor"), c("val_", "sharpe_approx")
CHAIN = f"""CASE WHEN train_total_trades < 8 THEN 'train trades' WHEN {VN} < 3 THEN 'G1' WHEN vdd > 40 THEN 'G2 val' WHEN tdd > 50 THEN 'G2 train'
  WHEN eff < -0.2 THEN 'G5' WHEN {VPF} < 0.9 THEN 'G6' WHEN vret < -5 THEN 'G4' END"""
INVALID = f"""CASE WHEN {VN} < 3 THEN 'few_val_trades' WHEN vdd > 40 THEN 'val_drawdown' WHEN tdd > 50 THEN 'train_drawdown'
  WHEN (train_profit_factor < 1 OR train_total_return_pct < 0) AND NOT ({VPF} >= 1.5 AND vret >= 10 AND {VN} >= 6 AND vdd < 30 AND {c('val_', 'win_rate')} > 50 AND eff >= -0.2)
    THEN 'weak_train' WHEN {VPF} < 0.9 THEN 'no_profit' WHEN vret < -5 THEN 'low_return' WHEN eff < -0.2 THEN 'low_efficiency'
  WHEN ratio < 0.8 AND {VSH} <= 0.3 THEN 'unstable' END"""
SLOT = "symbol, timeframe, regime"
DESC = RP + f""", live AS (SELECT *, row_number() OVER (PARTITION BY {SLOT} ORDER BY rs DESC, strategy_name, param_hash) AS rk, {INVALID} AS why FROM pp WHERE ({CHAIN}) IS NULL),
  topk AS (FROM live WHERE rk <= 5),
  b AS (SELECT {SLOT}, coalesce(min(rk) FILTER (why IS NULL), 1) AS pick, count(*) FILTER (why IS NULL) > 0 AS is_validated, count(*) AS tried FROM topk GROUP BY ALL),
  w AS (SELECT t.*, b.is_validated, b.tried, 1 / (1 + exp(-(rs - 45) / 30)) AS quality FROM topk t JOIN b USING ({SLOT}) WHERE rk = pick)"""


def best(score: str, general: str, least: int) -> str:
    return PR + f""", k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY {score} DESC, timeframe, strategy_name) AS rk FROM pp WHERE train_total_trades >= {least}),
      t AS (SELECT *, {VN} >= 8 AND vdd < 40 AS ok FROM k WHERE rk <= 5),
      b AS (SELECT symbol, coalesce(arg_max(rk, ({general}, -rk)) FILTER (ok), 1) AS pick, count(*) FILTER (ok) > 0 AS v FROM t GROUP BY symbol)
      SELECT t.symbol, timeframe, strategy_name, rk AS rank, {r(score, 6)} AS train_rank_score, {r(general, 6)} AS final_score,
        CASE WHEN v THEN 'validated' ELSE 'train fallback' END AS how FROM t JOIN b ON b.symbol = t.symbol AND rk = pick"""


CFG = """cfg AS (SELECT s_name AS symbol, s_acctbal > 2000 AS is_validated, CASE WHEN s_suppkey % 11 <> 0 THEN DATE '2024-01-01' + CAST(s_suppkey % 60 AS INTEGER) END AS valid_until,
  CASE WHEN s_nationkey % 2 = 0 THEN 'v1' ELSE 'v0' END AS stored FROM supplier WHERE s_suppkey % 7 <> 0)"""


def rows(m: int, name: str) -> str:
    return (f"{name} AS (SELECT s_name AS symbol, s_acctbal > {1000 * (1 - m)} AS success, s_acctbal > 5000 AS is_validated, s_suppkey % 4 + {m} AS regime_winners "
            f"FROM supplier WHERE s_suppkey % 5 <> {m})")


REP = f"WITH {CFG}, {rows(0, 'ro')}, rp AS (SELECT s_name AS symbol FROM supplier LEFT JOIN ro ON ro.symbol = s_name LEFT JOIN cfg ON cfg.symbol = s_name " \
      "WHERE success IS NULL OR NOT success OR (regime_winners > 0 AND cfg.symbol IS NULL))"

# ---- replicated studies
_K = "replication_id, symbol, timeframe, regime, strategy_name"
POOL = f"""{SALES}, hr AS (SELECT *, CAST(l_suppkey % 20 AS INTEGER) AS replication_id FROM halves), {metrics(_K + ', split', src='hr')},
  pool0 AS (SELECT {', '.join('t.' + k for k in _K.split(', '))}, t.total_return_pct AS train_return_pct, t.profit_factor AS train_profit_factor,
    t.max_drawdown_pct AS train_drawdown_pct, v.total_trades AS val_trades, v.total_return_pct AS val_return_pct, v.max_drawdown_pct AS val_drawdown_pct,
    v.profit_factor AS val_profit_factor, v.sharpe_approx AS val_sharpe, v.win_rate AS val_win_rate
    FROM (FROM bm WHERE split = 'train') t JOIN (FROM bm WHERE split = 'val') v USING ({_K})),
  pool AS (SELECT *, CASE WHEN val_drawdown_pct > 0 THEN val_return_pct / val_drawdown_pct ELSE 0 END AS val_return_dd_ratio,
    least(2.0::DOUBLE, greatest(0.0::DOUBLE, val_profit_factor / (train_profit_factor + 0.1) * (1 / (1 + 0.05 * abs(train_return_pct - val_return_pct))))) AS robustness_ratio FROM pool0)"""
HPOOL = {1: "val_trades < 5", 2: "val_drawdown_pct >= 20", 3: "train_return_pct < 0", 4: "val_return_pct < 5", 5: "val_return_dd_ratio < 1",
         6: "val_profit_factor < 1", 7: "robustness_ratio < 0.75"}
_exc = "val_profit_factor >= 1.15 AND val_return_pct >= 8 AND val_trades >= 30 AND val_drawdown_pct < 13.5 AND val_win_rate > 50 AND val_return_dd_ratio >= 1"
PPOOL = [(1, "val_trades < 15"), (2, "val_drawdown_pct > 18"), (2, "train_drawdown_pct > 22.5"),
         (3, f"(train_profit_factor < 1 OR train_return_pct < 0) AND NOT ({_exc})"), (4, "val_return_pct < 5"), (5, "val_return_dd_ratio < 1"),
         (6, "val_profit_factor < 1.05"), (7, "robustness_ratio < 0.80 AND val_sharpe <= 0.30")]
_plist = "list_filter([" + ", ".join(f"CASE WHEN mask[{g}] = '1' AND ({q}) THEN 'G{g}' END" for g, q in PPOOL) + "], lambda x: x IS NOT NULL)"


def study(fail: str) -> str:
    """CTEs ending in `sm`: the summary per replication and preset, unrounded."""
    med = lambda x, q=0.5: f"coalesce(quantile_cont({x}, {q}) FILTER (ok), 0)"
    return f"""WITH {POOL}, {preset_cte()}, f0 AS (SELECT *, {fail} AS fg FROM pool, presets), f1 AS (SELECT *, len(fg) = 0 AS ok FROM f0),
    sm0 AS (SELECT replication_id, preset, count(*) AS total_candidates, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS rejected,
      count(*) FILTER (ok AND robustness_ratio < 0.5) AS false_accepted, {med('robustness_ratio')} AS median_robustness,
      coalesce(avg(robustness_ratio) FILTER (ok), 0) AS mean_robustness, {med('robustness_ratio', 0.25)} AS robustness_q25, {med('robustness_ratio', 0.75)} AS robustness_q75,
      min(robustness_ratio) FILTER (ok) AS robustness_min, max(robustness_ratio) FILTER (ok) AS robustness_max, {med('val_return_pct')} AS median_val_return_pct,
      {med('val_drawdown_pct')} AS median_val_drawdown_pct, {med('val_profit_factor')} AS median_val_pf, {med('val_return_dd_ratio')} AS median_val_return_dd,
      {', '.join(f"sum(len(list_filter(fg, lambda x: x = 'G{g}'))) AS G{g}_rejections, count(*) FILTER (fg[1] = 'G{g}') AS G{g}_first" for g in range(1, 8))}
      FROM f1 GROUP BY ALL),
    sm AS (SELECT *, accepted / total_candidates * 100 AS acceptance_rate_pct, false_accepted / greatest(accepted, 1) * 100 AS false_acceptance_rate_pct FROM sm0)"""


ROUND = ("mean_robustness", "median_robustness", "robustness_q25", "robustness_q75", "robustness_min", "robustness_max", "median_val_return_pct",
         "median_val_drawdown_pct", "median_val_pf", "median_val_return_dd", "acceptance_rate_pct", "false_acceptance_rate_pct")
_sum = " SELECT * REPLACE (" + ", ".join(f"{r(m, 4)} AS {m}" for m in ROUND) + ") FROM sm"
TM = ("acceptance_rate_pct", "median_robustness", "false_acceptance_rate_pct", "median_val_return_pct", "median_val_return_dd")
H = study(failed(HPOOL))
LONG = H + ", lg AS (" + " UNION ALL ".join(f"SELECT replication_id, preset, '{m}' AS metric, CAST({m} AS DOUBLE) AS v FROM sm" for m in TM) + ")"
DIFF = LONG + """, df AS (SELECT a.metric, b.preset AS preset_b, round(a.v - b.v, 9) AS d FROM lg a JOIN lg b USING (metric, replication_id)
  WHERE a.preset = 'all_gates' AND b.preset <> 'all_gates'),
  tot AS (SELECT metric, preset_b, count(*) AS prs FROM df GROUP BY ALL),
  rk AS (SELECT *, rank() OVER (PARTITION BY metric, preset_b ORDER BY ad) + (t - 1) / 2 AS q FROM (SELECT *, abs(d) AS ad,
     count(*) OVER (PARTITION BY metric, preset_b, abs(d)) AS t FROM df WHERE abs(d) > 1e-12)),
  ws AS (SELECT tot.metric, tot.preset_b, any_value(prs) AS prs, count(q) AS n, coalesce(sum(q) FILTER (d > 0), 0) AS wp, coalesce(sum(q) FILTER (d < 0), 0) AS wm,
     coalesce(sum(t * t - 1), 0)::DOUBLE AS tie FROM tot LEFT JOIN rk ON rk.metric = tot.metric AND rk.preset_b = tot.preset_b GROUP BY ALL)"""


def wilcoxon(lib: bool) -> str:
    var = "(n * (n + 1) * (2 * n + 1) / 24.0" + (" - tie / 48.0)" if lib else ")")
    ok = "n > 0" if lib else "prs >= 10 AND n >= 10"
    note = ("CASE WHEN n = 0 THEN 'no non-zero difference' WHEN n <= 50 THEN 'normal approximation' END" if lib else
            "CASE WHEN prs < 10 THEN 'fewer than ten pairs' WHEN n < 10 THEN 'fewer than ten differences' END")
    return DIFF + (f" SELECT metric, preset_b, CASE WHEN {ok} THEN {r('least(wp, wm)', 4)} END AS W, {'n' if lib else 'CASE WHEN prs < 10 THEN prs ELSE n END'} AS n, {note} AS note, "
                   f"CASE WHEN {ok} THEN {r(f'CASE WHEN {var} < 1e-24 THEN 0 ELSE (least(wp, wm) - n * (n + 1) / 4.0) / sqrt({var}) END', 4)} END AS z FROM ws")


def friedman(tie: bool) -> str:
    chi = "12.0 * (ss - s * s / k) / (n * k * (k + 1))" + (" / (1 - tie / (n * k * (k * k - 1)))" if tie else "")
    return LONG + f""", q AS (SELECT *, rank() OVER (PARTITION BY metric, replication_id ORDER BY x) + (t - 1) / 2 AS rr FROM (SELECT *, count(*) OVER (PARTITION BY metric, replication_id, x) AS t
        FROM (SELECT *, round(v, 9) AS x FROM lg WHERE metric IN ('median_robustness', 'false_acceptance_rate_pct')))),
      b AS (SELECT metric, preset, sum(rr) AS rs, count(*) AS nb, sum(t * t - 1)::DOUBLE AS tie FROM q GROUP BY ALL),
      f AS (SELECT metric, max(nb)::DOUBLE AS n, count(*)::DOUBLE AS k, sum(tie) AS tie, sum(rs * rs) AS ss, sum(rs) AS s FROM b GROUP BY metric)
      SELECT metric, {r(chi, 4)} AS chi2, CAST(k - 1 AS INTEGER) AS df, n, k, CAST(NULL AS VARCHAR) AS note FROM f"""


_dist = [*TM, "accepted", "G2_rejections", "G5_first"]
ORACLES: dict[str, str] = {
    "score_table": f"WITH {SALES}, {metrics(RULE + ', split')} SELECT symbol, timeframe, strategy_name, split, {r(composite(''), 6)} AS composite, {r(selection(''), 6)} AS selection, "
                   f"{r(optimisation(''), 6)} AS optimisation, {criteria('')} AS criteria, {ineligible('')} AS ineligible, {r(f'1 / (1 + exp(-({selection(str())} - 45) / 30))', 6)} AS normalised FROM bm",
    "pair_scores": PR + f" SELECT symbol, timeframe, strategy_name, {r('ratio')} AS score_ratio, {r('general')} AS general, {r('general_opt')} AS general_opt, {r('srob')} AS sharpe_ratio, "
                        f"{r('legacy')} AS legacy_score, {r('rs')} AS regime_score, {r(f'CASE WHEN {VN} >= 8 THEN 0.8 * rst + (1 - 0.8) * rs ELSE rst END')} AS blended, "
                        f"CASE WHEN {VN} < 8 THEN 'few_trades' WHEN vdd >= 40 THEN 'deep_drawdown' WHEN ratio < 0.8 AND {VSH} <= 0.3 THEN 'unstable' ELSE 'valid' END AS stage_fx, "
                        f"CASE WHEN ({criteria('val_')}) <> 'OK' THEN ({criteria('val_')}) WHEN srob < 0.2 THEN 'unstable' ELSE 'valid' END AS stage_legacy FROM pp",
    "robustness_and_efficiency": PR + f""", x AS (SELECT *, val_profit_factor / (train_profit_factor + 0.1) * (1 / (1 + 0.05 * abs(train_total_return_pct - val_total_return_pct))) AS rho,
        val_total_return_pct AS vr, val_max_drawdown_pct AS vd FROM pp) SELECT symbol, timeframe, strategy_name, {r('rho')} AS rho,
        CASE WHEN vd IS NULL THEN NULL ELSE {r('vr / greatest(vd, 0.5::DOUBLE)')} END AS return_dd_0p5, CASE WHEN vd IS NULL THEN NULL ELSE {r('vr / greatest(vd, 0.01::DOUBLE)')} END AS return_dd_0p01,
        {r('CASE WHEN vd > 0 THEN vr / vd ELSE 0 END')} AS return_dd_0, rho < 0.5 AS far FROM x""",
    "winner_gate_chain": RP + f" SELECT {SLOT}, strategy_name, {CHAIN} AS dropped, {INVALID} AS invalid FROM pp",
    "winner_descent": DESC + f" SELECT {SLOT}, strategy_name, rk AS rank, {r('rs')} AS regime_score, why, is_validated, tried, {r('quality')} AS quality, "
                             f"coalesce({VPF} >= 0.9 AND val_total_return_pct >= -5 AND val_max_drawdown_pct <= 40 AND eff >= -0.2, false) AS live_ok FROM w",
    "default_config": DESC + f" SELECT symbol, {r('max(quality)')} AS quality FROM w WHERE is_validated GROUP BY symbol",
    "top_rules_per_regime": RP + f", k AS (SELECT *, row_number() OVER (PARTITION BY {SLOT} ORDER BY rs DESC, strategy_name) AS rk FROM pp WHERE train_total_trades >= 4) "
                                 f"SELECT {SLOT}, strategy_name, rk AS rank, {r('rs')} AS regime_score FROM k WHERE rk <= 3",
    "select_best_rule": best("ts", "general", 15),
    "select_best_params": best("tso", "general_opt", 10),
    "select_legacy": PR + f""", k AS (SELECT *, 0.4 * ({composite('train_')}) + 0.6 * ({composite('val_')}) AS cb FROM pp WHERE ({criteria('train_')}) = 'OK'),
        o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY cb DESC, timeframe DESC, strategy_name DESC) AS rk FROM k)
        SELECT symbol, timeframe, strategy_name, {r('cb')} AS combined FROM o WHERE rk = 1""",
    "collect_candidates": PR + f", a AS (SELECT symbol, timeframe, strategy_name, false AS is_tuned FROM pp WHERE ({ineligible('train_')}) IS NULL), "
                               + pairs(RULE + ", regime").replace(SALES + ",", "", 1).replace("bm_", "rm_").replace("bm ", "rm ").replace("p0", "q0").replace("p1", "q1").replace("p2 ", "q2 ").replace("FROM p2", "FROM q2").replace("pp AS", "qq AS")
                               + f", k AS (SELECT *, row_number() OVER (PARTITION BY {SLOT} ORDER BY rs DESC, strategy_name) AS rk FROM qq WHERE train_total_trades >= 4) "
                               "SELECT * FROM a UNION ALL SELECT DISTINCT symbol, timeframe, strategy_name, true FROM k WHERE rk = 1",
    "early_rejection": PR + f""", k AS (SELECT *, (row_number() OVER (PARTITION BY symbol, timeframe ORDER BY param_hash) - 1) / count(*) OVER (PARTITION BY symbol, timeframe) AS pos FROM pp),
        o AS (SELECT strategy_name, CASE WHEN train_total_trades < 30 THEN 'no trades' WHEN tdd > 10.0 * CASE WHEN pos < 0.2 THEN 1.5 ELSE 1.0 END THEN 'train drawdown'
          WHEN vdd > 8.0 * CASE WHEN pos < 0.2 THEN 1.5 ELSE 1.0 END THEN 'val drawdown' ELSE 'completed' END AS outcome FROM k)
        SELECT strategy_name, outcome, count(*) AS members FROM o GROUP BY ALL""",
    "parameter_grid": "SELECT p_brand AS strategy_name, count(*) AS parts, 1100 AS sets, 1100 AS distinct_sets, 1100 AS legal FROM part GROUP BY p_brand",
    "parameter_constraints": """WITH a AS (SELECT p_partkey, p_size AS fast_period, p_size % 30 + 1 AS sg, least(p_size, 14) AS d_period, 14 AS k_period,
        CASE WHEN 26 <= p_size THEN coalesce(list_min(list_filter([20, 26, 30, 40, 50], lambda v: v > p_size)), p_size + 5) ELSE 26 END AS slow_period FROM part)
        SELECT p_partkey, fast_period, slow_period, CASE WHEN sg >= slow_period THEN coalesce(list_max(list_filter([3, 7, 9, 12], lambda v: v < slow_period)), greatest(1, slow_period - 1)) ELSE sg END
        AS signal_period, k_period, d_period FROM a""",
    "walk_forward_period": f"""WITH wm AS ({WALKED}), sc AS (SELECT symbol, period_days AS p, score AS x FROM wm WHERE total_trades >= 3),
        nn AS (SELECT DISTINCT event_type AS symbol FROM events),
        cs AS (SELECT symbol, p, count(*) AS windows, CASE WHEN coalesce(stddev_samp(x), 0) > 0 THEN avg(x) / (stddev_samp(x) + 1) ELSE avg(x) END AS con FROM sc GROUP BY ALL),
        bs AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY con DESC, p) AS rk FROM cs)
        SELECT nn.symbol, coalesce(p, 30) AS period_days, {r('con', 4)} AS consistency, windows FROM nn LEFT JOIN bs ON bs.symbol = nn.symbol AND rk = 1""",
    "walk_window_scores": f"SELECT symbol, period_days, start, total_trades, {r('score', 6)} AS score FROM ({WALKED})",
    "run_status": f"WITH {CFG}, x AS (SELECT s_name AS symbol, c.* EXCLUDE (symbol), DATE '2024-01-31' AS now FROM supplier LEFT JOIN cfg c ON c.symbol = s_name), "
                  "y AS (SELECT symbol, CASE WHEN is_validated IS NULL THEN 'missing' WHEN NOT is_validated THEN 'invalid' WHEN valid_until IS NULL THEN 'no_expiry' "
                  "WHEN now >= valid_until THEN 'expired:' || (now - valid_until) WHEN stored <> 'v1' THEN 'regime_changed' "
                  "ELSE 'valid:' || (valid_until - now) END AS reason FROM x) "
                  "SELECT symbol, CASE WHEN reason LIKE 'valid:%' THEN 'skip' ELSE 'optimise' END AS action, reason FROM y",
    "ledger_stats": f"WITH {CFG} SELECT CASE WHEN NOT is_validated THEN 'invalid' WHEN valid_until IS NOT NULL AND DATE '2024-01-31' >= valid_until THEN 'expired' ELSE 'valid' END AS status, "
                    "count(*) AS configs FROM cfg GROUP BY 1",
    "repair_symbols": REP + " SELECT symbol FROM rp",
    "repair_merge": REP + f", {rows(1, 'rn0')}, rn AS (SELECT * FROM rn0 WHERE symbol IN (SELECT symbol FROM rp)) SELECT s_name AS symbol, "
                    + ", ".join(f"CASE WHEN rn.symbol IS NOT NULL THEN rn.{k} ELSE ro.{k} END AS {k}" for k in ("success", "is_validated", "regime_winners"))
                    + " FROM supplier LEFT JOIN ro ON ro.symbol = s_name LEFT JOIN rn ON rn.symbol = s_name",
    "run_summary": f"WITH {rows(0, 'ro')} SELECT count(*) AS symbols, count(*) FILTER (success) AS success_count, count(*) FILTER (is_validated) AS validated_count, "
                   "sum(regime_winners) AS regime_winner_count, count(*) FILTER (success AND regime_winners > 0) AS winner_symbols FROM ro",
    "successful_configs": f"WITH {CFG}, {rows(0, 'ro')} SELECT symbol, is_validated FROM cfg WHERE symbol IN (SELECT symbol FROM ro WHERE success AND regime_winners > 0)",
    "regime_version_change": "SELECT DISTINCT event_type AS symbol, event_type = 'view' AS changed FROM events",
    "candidate_pool": f"WITH {POOL} SELECT * REPLACE ({r('val_return_dd_ratio')} AS val_return_dd_ratio, {r('robustness_ratio')} AS robustness_ratio) FROM pool",
    "ablation_summary": H + _sum,
    "ablation_summary_production": study(_plist) + _sum,
    "ablation_distribution": H + ", lx AS (" + " UNION ALL ".join(f"SELECT preset, '{m}' AS metric, CAST({m} AS DOUBLE) AS v FROM sm" for m in _dist) + ") SELECT preset, metric, "
                             + f"{r('avg(v)', 4)} AS mean, " + ", ".join(f"{r(f'quantile_cont(v, {q})', 4)} AS {n}" for q, n in (
                                 (0.5, "median"), (0.25, "q25"), (0.75, "q75"), (0.025, "ci95_low"), (0.975, "ci95_high")))
                             + f", {r('min(v)', 4)} AS min, {r('max(v)', 4)} AS max FROM lx GROUP BY ALL",
    "rejection_heatmap": H + " SELECT preset, " + ", ".join(f"G{g}_rejections, G{g}_first" for g in range(1, 8)) + " FROM sm WHERE replication_id = 0",
    "wilcoxon_simulation": wilcoxon(False),
    "wilcoxon_library": wilcoxon(True),
    "friedman_simulation": friedman(False),
    "friedman_library": friedman(True),
    "result_comparison": "SELECT preset, CASE preset WHEN 'no_gates' THEN 'share' WHEN 'minimal' THEN 'filled_slots,share' ELSE '' END AS mismatched, "
                         f"preset NOT IN ('no_gates', 'minimal') AS ok FROM (VALUES {', '.join(f'({chr(39)}{p}{chr(39)})' for p in PRESETS)}) v(preset)",
}
