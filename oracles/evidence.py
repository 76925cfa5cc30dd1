"""Reference SQL of the ledger, evidence, gate and analysis queries."""

from __future__ import annotations

from oracles.common import r

SALES = f"""
sales0 AS (
  SELECT n_name AS symbol, CASE WHEN l_linestatus = 'F' THEN 'H4' ELSE 'D1' END AS timeframe,
    CASE WHEN l_tax >= 0.07 THEN 'CHOP' WHEN l_returnflag = 'A' THEN 'TREND' WHEN l_returnflag = 'N' THEN 'RANGE'
         ELSE 'BREAKOUT' END AS regime,
    p_brand AS strategy_name, substr(sha256(p_brand), 1, 16) AS param_hash, l_shipdate, l_orderkey, l_linenumber, l_suppkey,
    {r('l_extendedprice * (l_discount - 0.05::DOUBLE) / 10', 2)} AS pnl, {r('(l_discount - 0.05::DOUBLE) * 100', 3)} AS rm
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey),
sales AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, timeframe ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS pos,
    count(*) OVER (PARTITION BY symbol, timeframe) AS n_slot FROM sales0),
halves AS (
  SELECT *, 'train' AS split FROM sales WHERE pos < CAST(trunc(n_slot * 0.8::DOUBLE) AS BIGINT)
  UNION ALL
  SELECT *, 'val' AS split FROM sales WHERE pos >= CAST(trunc(n_slot * 0.7::DOUBLE) AS BIGINT))"""


def metrics(keys: str, name: str = "bm", src: str = "halves") -> str:
    """CTEs ending in `name`: metrics per bucket of `keys`."""
    root = "sqrt(252.0::DOUBLE)"
    return f"""
{name}_a AS (
  SELECT *, 10000 + sum(pnl) OVER w AS eq, row_number() OVER w AS k FROM {src}
  WINDOW w AS (PARTITION BY {keys} ORDER BY pos ROWS UNBOUNDED PRECEDING)),
{name}_b AS (
  SELECT *, greatest(10000.0::DOUBLE, max(eq) OVER w) AS peak, coalesce(max(CASE WHEN pnl >= 0 THEN k END) OVER w, 0) AS okk
  FROM {name}_a WINDOW w AS (PARTITION BY {keys} ORDER BY pos ROWS UNBOUNDED PRECEDING)),
{name}_c AS (
  SELECT {keys}, count(*) AS n, count(*) FILTER (pnl > 0) AS wins, count(*) FILTER (pnl < 0) AS losses, sum(pnl) AS pnl,
    coalesce(sum(pnl) FILTER (pnl > 0), 0) AS gp, abs(coalesce(sum(pnl) FILTER (pnl < 0), 0)) AS gl, avg(pnl) AS mean,
    stddev_samp(pnl) AS sd, stddev_samp(pnl) FILTER (pnl < 0) AS dsd, greatest(0.0::DOUBLE, max((peak - eq) / peak * 100)) AS mdd,
    max(CASE WHEN pnl < 0 THEN k - okk ELSE 0 END) AS streak, avg(rm) AS mr, min(rm) AS minr, quantile_cont(rm, 0.05) AS p5
  FROM {name}_b GROUP BY ALL),
{name}_d AS (SELECT *, CASE WHEN sd > 0 THEN mean / sd * {root} ELSE 0 END AS sh, pnl / 10000 * 100 AS ret FROM {name}_c),
{name} AS (
  SELECT {keys}, n AS total_trades, {r('wins / n * 100', 2)} AS win_rate,
    {r('CASE WHEN gl > 0 THEN gp / gl WHEN gp > 0 THEN 10 ELSE 0 END', 3)} AS profit_factor, {r('pnl', 2)} AS total_pnl,
    {r('gp', 2)} AS gross_profit, {r('gl', 2)} AS gross_loss,
    {r('CASE WHEN wins > 0 THEN gp / wins ELSE 0 END', 2)} AS avg_win, {r('CASE WHEN losses > 0 THEN gl / losses ELSE 0 END', 2)} AS avg_loss,
    {r('sh', 3)} AS sharpe_approx, {r('mdd', 2)} AS max_drawdown_pct, {r('ret', 2)} AS total_return_pct,
    CAST(streak AS BIGINT) AS max_consecutive_losses, {r('CASE WHEN mdd > 0 THEN ret / mdd ELSE 0 END', 2)} AS calmar_ratio,
    {r('mr', 3)} AS mean_r, {r('CASE WHEN n >= 20 THEN p5 ELSE minr END', 3)} AS worst_5pct_r,
    {r(f'''CASE WHEN n < 2 THEN 0 WHEN losses >= 2 THEN CASE WHEN dsd > 1e-10 THEN mean / dsd * {root} ELSE 0 END
           WHEN mean > 0 THEN sh * 1.5 ELSE 0 END''', 3)} AS sortino_approx
  FROM {name}_d)"""


def clip(x: str, lo: float, hi: float) -> str:
    return f"least({hi}::DOUBLE, greatest({lo}::DOUBLE, {x}))"


def selection(p: str) -> str:
    """Selection score of bucket columns prefixed `p`; an absent bucket is drawdown 100 and zero elsewhere."""
    c = lambda n, d="0": f"coalesce({p}{n}, {d})::DOUBLE"
    dd, ret, wr = c("max_drawdown_pct", "100"), c("total_return_pct"), c("win_rate")
    ra = f"(0.6 * {clip(c('sharpe_approx'), -2, 5)} + 0.4 * {clip(c('sortino_approx'), -2, 5)})"
    eff = clip(f"CASE WHEN {dd} > 0 THEN {ret} / {dd} ELSE {ret} END", -5, 20)
    ex = f"({c('avg_win')} * {wr} / 100 - {c('avg_loss')} * (1 - {wr} / 100))"
    n, w5, st = c("total_trades"), c("worst_5pct_r"), c("max_consecutive_losses")
    return f"""((({ra} + 2.0) / 7.0 * 25.0 + {clip(c('profit_factor'), 0, 10)} / 10.0 * 20.0 + {wr} / 100.0 * 15.0
      + ({eff} + 5.0) / 25.0 * 25.0 + least({ex} / 10.0, 1.0::DOUBLE) * 15.0) * exp(-0.03 * {dd})
      * CASE WHEN {w5} < -3 THEN greatest(0.70::DOUBLE, 1.0 + 0.05 * {w5}) ELSE 1.0 END
      * CASE WHEN {st} > 8 THEN greatest(0.75::DOUBLE, 1.0 - 0.03 * ({st} - 8)) ELSE 1.0 END
      * CASE WHEN {n} > 30 THEN 1.0 + least(0.08::DOUBLE, 0.03 * ln({n} / 30.0)) ELSE 1.0 END)"""


FLAT = {"trades": "total_trades", "pf": "profit_factor", "return": "total_return_pct", "dd": "max_drawdown_pct",
        "sharpe": "sharpe_approx", "win_rate": "win_rate"}
M = ("total_trades", "win_rate", "profit_factor", "total_pnl", "gross_profit", "gross_loss", "avg_win", "avg_loss",
     "sharpe_approx", "max_drawdown_pct", "total_return_pct", "max_consecutive_losses", "calmar_ratio", "mean_r",
     "worst_5pct_r", "sortino_approx")
_CK = "symbol, timeframe, strategy_name, param_hash"
_side = lambda s: ", ".join(f"{s}.{m} AS {s}_{m}" for m in M)
CAND = f"""{SALES}, {metrics(f'{_CK}, regime, split')},
spine AS (SELECT DISTINCT {_CK}, x.regime FROM bm, (VALUES ('TREND'), ('RANGE'), ('BREAKOUT'), ('CHOP')) x(regime) WHERE split = 'train'),
both_sides AS (
  SELECT spine.*, {_side('train')}, {_side('val')} FROM spine
  LEFT JOIN (FROM bm WHERE split = 'train') train USING ({_CK}, regime)
  LEFT JOIN (FROM bm WHERE split = 'val') val USING ({_CK}, regime)),
scored AS (
  SELECT *, {selection('train_')} AS ts, {selection('val_')} AS vs,
    0.7 + 0.3 * (0.3 * least(1.0::DOUBLE, ln(1 + coalesce(train_total_trades, 0)) / ln(51.0::DOUBLE))
               + 0.7 * least(1.0::DOUBLE, ln(1 + coalesce(val_total_trades, 0)) / ln(31.0::DOUBLE))) AS stab FROM both_sides),
cand AS (
  SELECT {_CK}, regime, {', '.join(f'coalesce({s}_{m}, 0) AS {s}_{k}' for s in ('train', 'val') for k, m in FLAT.items())},
    ts AS train_score, vs AS val_score,
    CASE WHEN coalesce(val_total_trades, 0) >= 15 THEN
      (vs - 0.70 * greatest(0.0::DOUBLE, ts - vs)) * (0.85 + 0.15 * least(1.25::DOUBLE, least(2.0::DOUBLE, greatest(0.0::DOUBLE,
        vs / CASE WHEN abs(ts) > 1e-9 THEN ts ELSE 1e-9 END)))) * stab
    ELSE ts * 0.7 * stab END AS quality_score FROM scored)"""

PRESETS = {"all_gates": "1111111", "no_gates": "0000000", "drawdown_only": "0100000", "profitability_only": "0010010",
           "minimal": "1100000", "quality_focused": "0100110", "robustness_focused": "1000101"}
SINGLE = {f"single_g{k}": "0" * (k - 1) + "1" + "0" * (7 - k) for k in range(1, 8)}


def preset_cte(single: bool = False) -> str:
    rows = ", ".join(f"('{n}', '{m}')" for n, m in {**PRESETS, **(SINGLE if single else {})}.items())
    return f"presets(preset, mask) AS (VALUES {rows})"


HIST = {1: "val_trades < 5", 2: "val_dd >= 20", 3: "train_return < 0", 4: "val_return < 5",
        5: "val_return / greatest(val_dd, 0.01::DOUBLE) < 1", 6: "val_pf < 1",
        7: "CASE WHEN train_score > 0.001 THEN val_score / train_score ELSE 0 END < 0.75"}


def failed(conds: dict[int, str]) -> str:
    parts = ", ".join(f"CASE WHEN mask[{g}] = '1' AND ({c}) THEN 'G{g}' END" for g, c in conds.items())
    return f"list_filter([{parts}], lambda x: x IS NOT NULL)"


def ledger(single: bool = False, top: int | None = 20) -> str:
    """CTEs ending in `led` (one row per preset and slot) and `tested` (top candidates per preset, or all)."""
    return f"""{CAND}, {preset_cte(single)},
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, timeframe, regime
    ORDER BY quality_score DESC, strategy_name, param_hash) AS rk FROM cand WHERE train_trades > 0) WHERE {f'rk <= {top}' if top else 'true'}),
tested AS (SELECT *, {failed(HIST)} AS fg FROM ranked, presets),
wr AS (SELECT preset, symbol, timeframe, regime, min(rk) FILTER (len(fg) = 0) AS wrank FROM tested GROUP BY ALL),
cnt AS (SELECT symbol, timeframe, regime, count(*) AS nc, count(*) FILTER (train_trades > 0) AS nu FROM cand GROUP BY ALL),
rej AS (SELECT t.* FROM tested t JOIN wr USING (preset, symbol, timeframe, regime) WHERE len(fg) > 0 AND (wrank IS NULL OR rk < wrank)),
rej1 AS (SELECT preset, symbol, timeframe, regime, count(*) AS n_rej, list_sort(list_distinct(flatten(list(fg)))) AS binding
         FROM rej GROUP BY ALL),
led AS (
  SELECT preset, mask, symbol, timeframe, regime, nc, wrank, CASE WHEN wrank IS NOT NULL THEN wrank ELSE least(nu, 20) END AS considered,
    CASE WHEN wrank IS NOT NULL THEN 'FILLED' ELSE 'NO_TRADE' END AS outcome, coalesce(n_rej, 0) AS n_rej,
    coalesce(binding, []) AS binding,
    CASE WHEN wrank IS NOT NULL THEN '' WHEN nu = 0 THEN 'nobody traded in training'
         ELSE 'every ranked candidate failed' END AS reason
  FROM (SELECT * FROM cnt, presets) LEFT JOIN wr USING (preset, symbol, timeframe, regime) LEFT JOIN rej1 USING (preset, symbol, timeframe, regime)),
won AS (SELECT t.* FROM tested t JOIN wr USING (preset, symbol, timeframe, regime) WHERE rk = wrank),
wonr AS (SELECT *, val_pf / (train_pf + 0.1) * (1 / (1 + 0.05 * abs(train_return - val_return))) AS rho,
         val_return / greatest(val_dd, 0.5::DOUBLE) AS vrd FROM won)"""


L = "WITH " + ledger()
RG = ("TREND", "RANGE", "BREAKOUT", "CHOP")
_f = "count(*) FILTER (outcome = 'FILLED')"


def share(a: str, b: str, d: int = 1) -> str:
    return r(f"100 * ({a}) / greatest({b}, 1)", d)


def med(x: str, d: int) -> str:
    return f"coalesce({r(f'median({x})', d)}, 0)"


def medians(rho: int, far: int, ret: int) -> str:
    return (f"{med('rho', rho)} AS median_rho, {r('avg(CASE WHEN rho < 0.5 THEN 1.0 ELSE 0.0 END) * 100', far)} AS far_pct, "
            f"{med('val_return', ret)} AS median_val_return, {med('val_dd', ret)} AS median_val_dd, {med('val_pf', rho)} AS median_pf, "
            f"{med('vrd', rho)} AS median_return_dd")


MED = ("median_rho", "far_pct", "median_val_return", "median_val_dd", "median_pf", "median_return_dd")
_coal = ", ".join(f"coalesce({m}, 0) AS {m}" for m in MED)
_gates = "array_to_string(list_filter(list_transform(range(1, 8), lambda g: CASE WHEN mask[g] = '1' THEN 'G' || g END), lambda x: x IS NOT NULL), ', ')"

_SYMBOLS = (f"m AS (SELECT preset, symbol, {medians(6, 6, 6)} FROM wonr GROUP BY ALL), sy AS (SELECT preset, symbol, count(*) AS total_slots, "
            f"{_f} AS filled_slots, {share(_f, 'count(*)', 4)} AS acceptance_pct FROM led GROUP BY ALL)")
#: Every symbol under every preset; what is absent counts 0.0.
_DENSE = L + f", {_SYMBOLS}, ag AS (SELECT sy.*, {_coal} FROM sy LEFT JOIN m USING (preset, symbol)), dn AS (SELECT symbol, preset, metric, " + (
    "coalesce(CASE metric WHEN 'acceptance_pct' THEN acceptance_pct WHEN 'median_rho' THEN median_rho ELSE far_pct END, 0)::DOUBLE AS v FROM (SELECT DISTINCT symbol FROM ag) "
    "CROSS JOIN (SELECT preset FROM presets) CROSS JOIN (VALUES ('acceptance_pct'), ('median_rho'), ('far_pct')) t(metric) LEFT JOIN ag USING (symbol, preset))")

ORACLES: dict[str, str] = {
    "sales_ledger": f"WITH {SALES} SELECT symbol, timeframe, regime, strategy_name, param_hash, l_orderkey, l_linenumber, "
                    "pos AS entry_bar, pnl AS pnl_dollars, rm AS r_multiple, n_slot AS slot_trades FROM sales",
    "bucket_metrics": f"WITH {SALES}, {metrics(_CK + ', regime, split')} SELECT * FROM bm",
    "candidate_evidence": f"WITH {CAND} SELECT * REPLACE ({r('train_score', 6)} AS train_score, {r('val_score', 6)} AS val_score, "
                          f"{r('quality_score', 6)} AS quality_score) FROM cand",
    "gate_check": f"WITH {ledger(True, None)} SELECT preset, symbol, timeframe, regime, strategy_name, rk AS rank, "
                  "array_to_string(fg, ',') AS failed, len(fg) = 0 AS passed FROM tested",
    "rejection_ledger": L + " SELECT preset, symbol, timeframe, regime, nc AS candidate_count, considered AS candidates_considered, "
                        "n_rej AS rejections, array_to_string(binding, ',') AS binding_gates, outcome, reason, wrank AS winner_rank FROM led",
    "winners": L + f" SELECT preset, symbol, timeframe, regime, strategy_name, param_hash, {r('quality_score', 6)} AS quality_score, "
               "rk AS rank, val_trades, val_pf, val_return, val_dd, val_sharpe, val_win_rate, train_trades, train_pf, train_return FROM won",
    "fill_totals": L + f" SELECT preset, count(*) AS total_slots, {_f} AS filled_slots, count(*) - {_f} AS no_trade_slots FROM led GROUP BY preset",
    "fill_rates": L + f" SELECT preset, count(*) AS total_slots, {_f} AS filled_slots, count(*) - {_f} AS no_trade_slots, "
                  f"{share(_f, 'count(*)')} AS fill_rate_pct, " + ", ".join(
                      f"count(*) FILTER (outcome = 'FILLED' AND regime = '{g}') AS {g}_filled, count(*) FILTER (regime = '{g}') AS {g}_total, "
                      + share(f"count(*) FILTER (outcome = 'FILLED' AND regime = '{g}')", f"count(*) FILTER (regime = '{g}')") + f" AS {g}_fill_pct"
                      for g in RG) + " FROM led GROUP BY preset",
    "convergence": L + ", fp AS (SELECT DISTINCT preset, symbol, timeframe, regime, strategy_name, param_hash FROM won), "
                   "sz AS (SELECT preset, count(*) AS n FROM fp GROUP BY 1), "
                   "ab AS (SELECT a.preset AS pa, b.preset AS pb, count(*) AS inter FROM fp a JOIN fp b USING (symbol, timeframe, regime, "
                   "strategy_name, param_hash) GROUP BY ALL) SELECT p.preset, " + ", ".join(
                       r(f"coalesce(max(inter) FILTER (pb = '{q}'), 0) / greatest(coalesce(max(s.n), 0) + coalesce((SELECT n FROM sz WHERE preset = '{q}'), 0) "
                         f"- coalesce(max(inter) FILTER (pb = '{q}'), 0), 1)", 4) + f" AS {q}" for q in PRESETS)
                   + " FROM presets p LEFT JOIN ab ON pa = p.preset LEFT JOIN sz s ON s.preset = p.preset GROUP BY p.preset",
    "binding_gates": L + f" SELECT preset, {_f} AS filled, count(*) - {_f} AS no_trade, count(*) FILTER (wrank > 1) AS slots_with_top1_rejected, "
                     f"{r('coalesce(avg(wrank), 0)', 2)} AS avg_winner_rank, " + ", ".join(
                         f"count(*) FILTER (list_contains(binding, 'G{g}')) AS G{g}_binding_slots" for g in range(1, 8)) + " FROM led GROUP BY preset",
    "quality_by_regime": L + f" SELECT preset, {r('avg(quality_score)', 4)} AS overall_mean_quality, {r('median(quality_score)', 4)} AS overall_median_quality, "
                         "count(*) AS winner_count, " + ", ".join(
                             f"coalesce({r(f'''avg(quality_score) FILTER (regime = '{g}')''', 4)}, 0) AS {g}_mean_quality, count(*) FILTER (regime = '{g}') AS {g}_count"
                             for g in RG) + ", " + ", ".join(f"{r(f'avg({m})', 4)} AS mean_{m}" for m in ("val_pf", "val_return", "val_dd"))
                         + " FROM won GROUP BY preset",
    "headline": L + f", m AS (SELECT preset, {medians(3, 2, 2)} FROM wonr GROUP BY preset), s AS (SELECT preset, "
                f"CASE WHEN max({_gates}) = '' THEN 'none' ELSE max({_gates}) END AS active_gates, max(len(replace(mask, '0', ''))) AS gate_count, "
                f"{_f} AS accepted_slots, {share(_f, 'count(*)')} AS acceptance_pct FROM led GROUP BY preset) "
                f"SELECT s.*, {_coal} FROM s LEFT JOIN m USING (preset)",
    "symbol_aggregates": L + f", m AS (SELECT preset, symbol, {medians(6, 6, 6)} FROM wonr GROUP BY ALL), s AS (SELECT preset, symbol, count(*) AS total_slots, "
                         f"{_f} AS filled_slots, {share(_f, 'count(*)', 4)} AS acceptance_pct FROM led GROUP BY ALL) "
                         f"SELECT s.*, {_coal} FROM s LEFT JOIN m USING (preset, symbol)",
    "symbol_blocked_friedman": _DENSE + """, r AS (SELECT *, count(*) OVER (PARTITION BY metric, symbol, q) AS t,
        rank() OVER (PARTITION BY metric, symbol ORDER BY q) + (count(*) OVER (PARTITION BY metric, symbol, q) - 1) / 2 AS rk FROM (SELECT *, round(v, 12) AS q FROM dn)),
      s AS (SELECT metric, preset, sum(rk) AS rs, count(*) AS n, sum(t * t - 1) AS tie FROM r GROUP BY ALL),
      f AS (SELECT metric, max(n) AS n, count(*) AS k, sum(tie) AS tie, sum(rs * rs) - sum(rs) * sum(rs) / count(*) AS spread FROM s GROUP BY metric)
      SELECT metric, CAST(k - 1 AS INTEGER) AS df, n, k, """ + r("12.0 * spread / (n * k * (k + 1)) / (1 - tie / (n * k * (k * k - 1)))", 4) + " AS chi2 FROM f",
    "symbol_blocked_wilcoxon": _DENSE + f""", d AS (SELECT x.metric, x.preset, b.v - x.v AS d FROM dn x JOIN dn b ON b.symbol = x.symbol AND b.metric = x.metric AND b.preset = 'all_gates'
        WHERE x.preset <> 'all_gates'),
      z AS (SELECT *, count(*) OVER (PARTITION BY metric, preset, q) AS t, rank() OVER (PARTITION BY metric, preset ORDER BY q)
        + (count(*) OVER (PARTITION BY metric, preset, q) - 1) / 2 AS rk FROM (SELECT *, round(abs(d), 12) AS q FROM d WHERE d <> 0)),
      w AS (SELECT metric, preset, count(*) AS n, least(sum(CASE WHEN d > 0 THEN rk ELSE 0 END), sum(CASE WHEN d < 0 THEN rk ELSE 0 END)) AS w, sum(t * t - 1) AS tie FROM z GROUP BY ALL),
      a AS (SELECT metric, preset, count(*) AS pairs, median(d) AS md FROM d GROUP BY ALL),
      j AS (SELECT metric, preset, pairs, md, coalesce(n, 0) AS n, w, tie FROM a LEFT JOIN w USING (metric, preset)),
      p AS (SELECT *, CASE WHEN n = pairs AND tie = 0 AND n BETWEEN 1 AND 50 THEN least(1.0, list_sum(list_reduce(
          list_prepend([1.0::DOUBLE], list_transform(range(1, n + 1), lambda k: [k::DOUBLE])),
          lambda c, k: list_transform(range(1, len(c) + CAST(k[1] AS BIGINT) + 1), lambda i: coalesce(c[i], 0) + CASE WHEN i > k[1] THEN c[i - CAST(k[1] AS BIGINT)] ELSE 0 END)
        )[1:CAST(floor(w) AS BIGINT) + 1]) * 2 / pow(2, n)) END AS p, n * (n + 1) * (2 * n + 1) / 24.0 - tie / 48.0 AS var FROM j)
      SELECT metric, preset AS preset_b, n, {r('w', 4)} AS W, {r('md', 4)} AS median_delta, {r('p', 9)} AS p_value, CASE WHEN var > 1e-24 THEN {r('(w - n * (n + 1) / 4.0) / sqrt(var)', 4)} END AS z,
        CASE WHEN n = 0 THEN 'no non-zero difference' WHEN p IS NULL THEN 'normal approximation' ELSE 'exact' END AS note, CASE WHEN p IS NOT NULL THEN {r('least(1.0, p * 6)', 9)} END AS bonferroni_p FROM p""",
    "far_sensitivity": L + ", f AS (SELECT p.preset, " + ", ".join(
        f"coalesce({r(f'avg(CASE WHEN rho < {t} THEN 1.0 WHEN rho IS NOT NULL THEN 0.0 END) * 100', 2)}, 0) AS far_pct_rho_lt_{str(t).replace('.', '_')}" for t in (0.4, 0.5, 0.6))
        + " FROM presets p LEFT JOIN wonr USING (preset) GROUP BY p.preset), k AS (SELECT *, " + ", ".join(
        f"row_number() OVER (ORDER BY far_pct_rho_lt_0_{d}, preset) AS rank_0_{d}" for d in (4, 5, 6))
        + " FROM f) SELECT *, bool_and(rank_0_4 = rank_0_5 AND rank_0_5 = rank_0_6) OVER () AS ranking_stable FROM k",
    "gate_overlap": L + """, u AS (SELECT 'slot' AS level, binding AS g FROM led WHERE preset = 'all_gates'
        UNION ALL SELECT 'candidate', fg FROM rej WHERE preset = 'all_gates'),
        c AS (SELECT level, count(*) FILTER (a AND b) AS bo, count(*) FILTER (a AND NOT b) AS ao, count(*) FILTER (b AND NOT a) AS bn,
              count(*) FILTER (NOT a AND NOT b) AS ne FROM (SELECT level, list_contains(g, 'G2') AS a, list_contains(g, 'G5') AS b FROM u) GROUP BY level),
        d AS (SELECT *, sqrt((bo + ao)::DOUBLE * (bo + bn) * (ao + ne) * (bn + ne)) AS den FROM c)
        SELECT 'all_gates' AS preset, 'G2' AS gate_a, 'G5' AS gate_b, level, bo AS both_failed, ao AS a_only, bn AS b_only, ne AS neither, """
        + f"CASE WHEN bo + ao + bn > 0 THEN {r('bo / (bo + ao + bn)', 4)} ELSE 0 END AS jaccard, "
        f"CASE WHEN den > 0 THEN {r('(bo * ne - ao * bn) / den', 4)} ELSE 0 END AS phi, "
        f"{share('bo', 'bo + ao', 2)} AS p_b_given_a_pct, {share('bo', 'bo + bn', 2)} AS p_a_given_b_pct FROM d",
    "mcnemar": L + """, x AS (SELECT b.preset AS preset_b, a.outcome = 'FILLED' AS fa, b.outcome = 'FILLED' AS fb FROM led a
        JOIN led b USING (symbol, timeframe, regime) WHERE a.preset = 'all_gates' AND b.preset <> 'all_gates'),
        c AS (SELECT preset_b, count(*) FILTER (fa AND fb) AS n11, count(*) FILTER (fa AND NOT fb) AS n10,
              count(*) FILTER (NOT fa AND fb) AS n01, count(*) FILTER (NOT fa AND NOT fb) AS n00 FROM x GROUP BY 1)
        SELECT 'all_gates' AS preset_a, *, """ + f"CASE WHEN n10 + n01 > 0 THEN {r('pow(abs(n10 - n01) - 1, 2) / (n10 + n01)', 4)} ELSE 0 END AS chi2_approx, "
        "n10 + n01 AS discordant_pairs FROM c",
    "cohens_d": L + """, x AS (SELECT b.preset AS preset_b, a.quality_score - b.quality_score AS d FROM won a JOIN won b
        USING (symbol, timeframe, regime) WHERE a.preset = 'all_gates' AND b.preset <> 'all_gates')
        SELECT 'all_gates' AS preset_a, preset_b, count(*) AS common_filled_slots, """
        + r("CASE WHEN stddev_samp(d) > 0 THEN avg(d) / stddev_samp(d) ELSE 0 END", 4) + " AS cohens_d FROM x GROUP BY preset_b",
}
