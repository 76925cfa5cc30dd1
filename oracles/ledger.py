"""Reference SQL of the bar-series ledger: a row-by-row state over every rule, split and symbol."""

from __future__ import annotations

from oracles.common import chain, ema, lag, r, roll, win
from oracles.series import BASE, COMPONENTS, HYST, START, atr, hh, ll, over, span, under  # noqa: F401

_SIG = START + [
    {"e10": ema("close", span(10)), "e20": ema("close", span(20)), "h20": hh(20), "l20": ll(20), "a20": atr(20), "a14": atr(14)},
    {"g1": f"CASE WHEN {under('e10', 'e20')} THEN -1 WHEN {over('e10', 'e20')} THEN 1 ELSE 0 END",
     "g2": f"CASE WHEN close < {lag('l20')} THEN -1 WHEN close > {lag('h20')} THEN 1 ELSE 0 END",
     "g3": "CASE WHEN dc < -a20 THEN -1 WHEN dc > a20 THEN 1 ELSE 0 END"},
    {"p1": lag("g1"), "p2": lag("g2"), "p3": lag("g3"), "pa": lag("a14"), "te": "CAST(trunc(n * 0.8::DOUBLE) AS BIGINT)",
     "vs": "CAST(trunc(n * 0.7::DOUBLE) AS BIGINT)"}]
NAMES = {"p1": "EMACrossoverStrategy", "p2": "DonchianBreakoutStrategy", "p3": "VolatilityBreakoutStrategy"}

def steps(sl: float | str = 0.5, tp: float | str = 0.75) -> str:
    """Bars of every rule and split with its candidate entry; ``sl`` and ``tp`` in multiples of ATR, figures or SQL over ``rule``."""
    return f"""s0 AS MATERIALIZED ({chain(BASE, _SIG, '*')}),
sp AS (SELECT *, 'train' AS split, 0 AS lo, te AS hi FROM s0 WHERE i < te UNION ALL SELECT *, 'val', vs, n FROM s0 WHERE i >= vs),
s1 AS ({' UNION ALL '.join(f"SELECT symbol, split, '{v}' AS rule, i, lo, hi, ts, open, high, low, close, CASE WHEN i > lo THEN {k} END AS g, pa FROM sp" for k, v in NAMES.items())}),
s AS MATERIALIZED (SELECT *, g <> 0 AND pa IS NOT NULL AS fire, open + 0.1 * g AS cep,
   open + 0.1 * g - g * greatest(5.0::DOUBLE, pa * {sl}) AS csl, open + 0.1 * g + g * greatest(10.0::DOUBLE, pa * {tp}) AS ctp FROM s1)"""


S = steps()
_lots = "least(100.0::DOUBLE, greatest(0.01::DOUBLE, floor(eq2 * 0.01 / ((cep - csl) * g / 0.01 * 0.01) / 0.01) * 0.01))"
STEP = f"""
z(symbol, split, rule, i, pos, dir, ep, sl, tp, eb, lots, risk, eq, why, xdir, xep, xsl, xtp, xeb, xlots, xrisk, xprice, xpnl) AS (
  SELECT symbol, split, rule, i, false, 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 10000.0::DOUBLE, CAST(NULL AS VARCHAR),
    0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM s WHERE i = lo
  UNION ALL
  SELECT symbol, split, rule, i, ent OR (pos AND why IS NULL), CASE WHEN ent THEN g ELSE dir END, CASE WHEN ent THEN cep ELSE ep END,
    CASE WHEN ent THEN csl ELSE sl END, CASE WHEN ent THEN ctp ELSE tp END, CASE WHEN ent THEN i ELSE eb END,
    CASE WHEN ent THEN {_lots} ELSE lots END, CASE WHEN ent THEN eq2 * 0.01 ELSE risk END, eq2, why, dir, ep, sl, tp, eb, lots, risk, xprice, xpnl
  FROM (SELECT *, eq + CASE WHEN why IS NULL THEN 0 ELSE xpnl END AS eq2, coalesce(fire, false) AND (NOT pos OR why IS NOT NULL) AS ent
    FROM (SELECT *, (xprice - ep) * dir / 0.01 * 0.01 * lots - 0.1 * lots AS xpnl
      FROM (SELECT *, CASE why WHEN 'closed_sl' THEN sl - 0.5 * dir WHEN 'closed_tp' THEN tp END AS xprice
        FROM (SELECT s.*, z.pos, z.dir, z.ep, z.sl, z.tp, z.eb, z.lots, z.risk, z.eq,
            CASE WHEN NOT z.pos THEN NULL WHEN z.dir = 1 THEN CASE WHEN s.low - 0.1 <= z.sl THEN 'closed_sl' WHEN s.high - 0.1 >= z.tp THEN 'closed_tp' END
              ELSE CASE WHEN s.high + 0.1 >= z.sl THEN 'closed_sl' WHEN s.low + 0.1 <= z.tp THEN 'closed_tp' END END AS why
          FROM z JOIN s ON s.symbol = z.symbol AND s.split = z.split AND s.rule = z.rule AND s.i = z.i + 1)))))"""
def trades(sl: float | str = 0.5, tp: float | str = 0.75) -> str:
    return f"""WITH RECURSIVE {steps(sl, tp)}, {STEP},
eod AS (SELECT z.*, s.close - 0.1 * z.dir AS cp, s.lo FROM z JOIN s USING (symbol, split, rule, i) WHERE s.i = s.hi - 1 AND z.pos),
t0 AS (
  SELECT symbol, split, rule, xeb AS eb, i AS xb, xdir AS dir, xep AS ep, xprice AS xp, xsl AS sl, xtp AS tp, xlots AS lots, why, xpnl AS pnl, xrisk AS risk FROM z WHERE why IS NOT NULL
  UNION ALL SELECT symbol, split, rule, eb, i, dir, ep, cp, sl, tp, lots, 'end_of_data', (cp - ep) * dir / 0.01 * 0.01 * lots - 0.1 * lots, risk FROM eod),
t AS (SELECT t0.*, l.lo, l.secs, row_number() OVER w AS no, {r('(xp - ep) * dir', 2)} AS pips, {r('pnl', 2)} AS usd, 10000 + sum(pnl) OVER w AS eq,
    {r(r('pnl', 2) + ' / risk', 3)} AS rm FROM t0
  JOIN (SELECT symbol, split, any_value(lo) AS lo, max(epoch(ts)) FILTER (i = lo + 1) - max(epoch(ts)) FILTER (i = lo) AS secs FROM s GROUP BY ALL) l USING (symbol, split)
  WINDOW w AS (PARTITION BY symbol, split, rule ORDER BY eb)),
u AS (SELECT *, coalesce(10000 + sum(usd) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 10000) AS cb,
    greatest(10000.0::DOUBLE, max(eq) OVER (w ROWS UNBOUNDED PRECEDING)) AS peak,
    no - coalesce(max(CASE WHEN pips <= 0 THEN no END) OVER (w ROWS UNBOUNDED PRECEDING), 0) AS wrun,
    no - coalesce(max(CASE WHEN pips > 0 THEN no END) OVER (w ROWS UNBOUNDED PRECEDING), 0) AS lrun
  FROM t WINDOW w AS (PARTITION BY symbol, split, rule ORDER BY eb))"""


TR = trades()


def metrics(wait: int = 0, rows: str = TR) -> str:
    q = lambda a, b, k="1": f"CASE WHEN {b} > 0 THEN {a} * 1.0 / {b} * {k} ELSE 0 END"
    return rows + f""", a AS (SELECT symbol, split, rule, count(*) AS na, max((peak - eq) / peak * 100) AS mdd, arg_max(eq, no) AS fin, avg(usd / cb) AS ra,
      stddev_samp(usd / cb) AS rs, count(*) FILTER (usd / cb < 0) AS rn, stddev_samp(usd / cb) FILTER (usd / cb < 0) AS rds, min(usd / cb) AS rmin FROM u GROUP BY ALL),
    f AS (SELECT * EXCLUDE (wrun, lrun), row_number() OVER w - coalesce(max(CASE WHEN pips <= 0 THEN k0 END) OVER (w ROWS UNBOUNDED PRECEDING), 0) AS wrun,
      row_number() OVER w - coalesce(max(CASE WHEN pips > 0 THEN k0 END) OVER (w ROWS UNBOUNDED PRECEDING), 0) AS lrun
      FROM (SELECT *, row_number() OVER (PARTITION BY symbol, split, rule ORDER BY eb) AS k0 FROM u WHERE eb - lo >= {wait}) WINDOW w AS (PARTITION BY symbol, split, rule ORDER BY eb)),
    m AS (SELECT symbol, split, rule, count(*) AS n, count(*) FILTER (pips > 0) AS w, count(*) FILTER (pips < 0) AS l, sum(usd) AS pnl,
      coalesce(sum(usd) FILTER (pips > 0), 0) AS wp, abs(coalesce(sum(usd) FILTER (pips < 0), 0)) AS lp, coalesce(sum(pips) FILTER (pips > 0), 0) AS wpip,
      coalesce(sum(pips) FILTER (pips < 0), 0) AS lpip, sum(pips) AS pips, avg(rm) AS mr, median(rm) AS md, quantile_cont(rm, 0.05) AS p5, min(rm) AS minr, count(*) FILTER (rm > 0) AS rp,
      max(wrun) AS cw, max(lrun) AS cl, avg(xb - eb) AS ad, max(xb - eb) AS xd, min(xb - eb) AS nd, count(*) FILTER (dir = 1) AS nl, count(*) FILTER (dir = -1) AS ns,
      count(*) FILTER (dir = 1 AND pips > 0) AS wl, count(*) FILTER (dir = -1 AND pips > 0) AS ws, any_value(secs) AS secs,
      count(*) FILTER (why = 'closed_sl') AS n_closed_sl, count(*) FILTER (why = 'closed_tp') AS n_closed_tp, count(*) FILTER (why = 'end_of_data') AS n_end_of_data
      FROM f GROUP BY ALL),
    k AS (SELECT *, {q('w', 'n', '100.0')} AS wr, {q('wpip', 'w')} AS aw, abs({q('lpip', 'l')}) AS al, sqrt(86400.0 / greatest(secs, 60) * 252) AS yr,
      (fin - 10000) / 10000 * 100 AS tot FROM m JOIN a USING (symbol, split, rule)),
    h AS (SELECT *, CASE WHEN na >= 2 AND rs > 1e-10 THEN ra / rs * yr ELSE 0 END AS sh FROM k)
    SELECT symbol, split, rule AS strategy_name, n AS total_trades, w AS winning_trades, l AS losing_trades, n - w - l AS breakeven_trades, {r('wr', 2)} AS win_rate,
      {r('pnl', 2)} AS total_pnl, {r('tot', 2)} AS total_return_pct, {r('wp', 2)} AS gross_profit, {r('lp', 2)} AS gross_loss,
      {r('least(CASE WHEN lp > 0 THEN wp / lp ELSE 99 END, 99)', 2)} AS profit_factor, {r('aw', 2)} AS avg_win_pips, {r('al', 2)} AS avg_loss_pips,
      {r(q('pips', 'n'), 2)} AS avg_trade_pips, {r(q('wp', 'w'), 2)} AS avg_win_dollars, {r(q('lp', 'l'), 2)} AS avg_loss_dollars,
      {r(q('pnl', 'n'), 2)} AS avg_trade_dollars, {r('mdd', 2)} AS max_drawdown_pct, {r('CASE WHEN wr > 0 THEN wr / 100 * aw - (1 - wr / 100) * al ELSE -al END', 2)} AS expectancy_pips,
      {r('sh', 2)} AS sharpe_ratio, {r('CASE WHEN na < 2 THEN 0 WHEN rn >= 2 THEN CASE WHEN rds > 1e-10 THEN ra / rds * yr ELSE 0 END WHEN rn = 1 THEN ra / abs(rmin) * yr WHEN ra > 0 AND sh > 0 THEN sh * 2 ELSE 0 END', 2)} AS sortino_ratio,
      {r(q('tot', 'mdd'), 2)} AS calmar_ratio, {r('mr', 3)} AS mean_r, {r('md', 3)} AS median_r, {r(q('rp', 'n', '100.0'), 2)} AS pct_positive_r,
      {r('CASE WHEN n >= 20 THEN p5 ELSE minr END', 3)} AS worst_5pct_r, cw AS max_consecutive_wins, cl AS max_consecutive_losses, {r('ad', 1)} AS avg_trade_duration,
      xd AS max_trade_duration, nd AS min_trade_duration, nl AS long_trades, ns AS short_trades, {r(q('wl', 'nl', '100.0'), 2)} AS long_win_rate,
      {r(q('ws', 'ns', '100.0'), 2)} AS short_win_rate, {r('fin', 2)} AS final_equity, n_closed_sl, n_closed_tp, n_end_of_data FROM h"""


# positions from every bar but the last: even bars long, odd ones short
POS = f"b AS ({BASE}), p AS (SELECT symbol, i AS trade_id, CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END AS d, open AS ep FROM b WHERE i + 1 < n)"


def followed(stop: str = "d * ep - 60", limit: int = 0) -> str:
    """CTEs up to `left_(symbol, trade_id, d, ep, bars_held, exit_reason, exit_price)`; `stop` is the moving stop in long terms, negated for shorts."""
    return f"""{POS},
    x AS (SELECT p.*, b.high AS h, b.low AS l, b.close AS c, b.i - p.trade_id AS held, (b.close - ep) * d AS gain FROM p JOIN b ON b.symbol = p.symbol AND b.i > p.trade_id),
    y AS (SELECT *, max(gain) OVER (PARTITION BY symbol, trade_id ORDER BY held ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM x),
    v AS (SELECT *, d * ({stop}) AS st FROM y),
    q AS (SELECT *, CASE WHEN (d = 1 AND l - 0.1 <= st) OR (d = -1 AND h + 0.1 >= st) THEN 'closed_sl' WHEN (d = 1 AND h - 0.1 >= ep + 90) OR (d = -1 AND l + 0.1 <= ep - 90) THEN 'closed_tp'
      {f"WHEN held >= {limit} THEN 'closed_time'" if limit else ''} END AS why FROM v),
    left_ AS (SELECT symbol, trade_id, any_value(d) AS d, any_value(ep) AS ep, coalesce(min(held) FILTER (why IS NOT NULL), max(held)) AS bars_held,
      coalesce(arg_min(why, held) FILTER (why IS NOT NULL), 'end_of_data') AS exit_reason,
      coalesce(arg_min(CASE why WHEN 'closed_sl' THEN st WHEN 'closed_tp' THEN ep + d * 90 ELSE (h + l) / 2 END, held) FILTER (why IS NOT NULL), arg_max(c - 0.1 * d, held)) AS exit_price
      FROM q GROUP BY symbol, trade_id)"""


def exits(stop: str = "d * ep - 60", limit: int = 0) -> str:
    return f"WITH {followed(stop, limit)} SELECT symbol, trade_id, bars_held, exit_reason, {r('exit_price', 4)} AS exit_price FROM left_"


_cand = f"WITH {S} SELECT symbol, split, rule AS strategy_name, i - 1 AS signal_bar, i AS entry_bar, g = 1 AS is_long, " + ", ".join(
    f"{r(a, 4)} AS {b}" for a, b in (("cep", "entry_price"), ("csl", "stop_loss"), ("ctp", "take_profit"))) + " FROM s WHERE fire"
# the rules' own default stops
DEFAULT_STOP = "CASE rule WHEN 'VolatilityBreakoutStrategy' THEN 1.5::DOUBLE ELSE 2.0::DOUBLE END"
ORACLES = {
    "entry_candidates": _cand,
    "barrier_labels": f"""WITH {S}, j AS (SELECT e.*, f.i AS fi, f.close AS fc, CASE WHEN e.g = 1 THEN CASE WHEN f.low - 0.1 <= e.csl THEN 'closed_sl' WHEN f.high - 0.1 >= e.ctp THEN 'closed_tp' END
        ELSE CASE WHEN f.high + 0.1 >= e.csl THEN 'closed_sl' WHEN f.low + 0.1 <= e.ctp THEN 'closed_tp' END END AS hit
      FROM s e JOIN s f ON f.symbol = e.symbol AND f.split = e.split AND f.rule = e.rule AND (f.i > e.i OR (f.i = e.i AND e.i = e.hi - 1)) WHERE e.fire),
      a AS (SELECT symbol, split, rule, i, any_value(g) AS g, any_value(csl) AS csl, any_value(ctp) AS ctp, min(fi) FILTER (hit IS NOT NULL AND fi > i) AS x,
        arg_min(hit, fi) FILTER (hit IS NOT NULL AND fi > i) AS why, max(fi) AS lastb, arg_max(fc, fi) AS lastc FROM j GROUP BY ALL)
      SELECT symbol, split, rule AS strategy_name, i AS entry_bar, g = 1 AS is_long, coalesce(x, lastb) AS exit_bar, coalesce(why, 'end_of_data') AS exit_reason,
        {r("CASE why WHEN 'closed_sl' THEN csl - 0.5 * g WHEN 'closed_tp' THEN ctp ELSE lastc - 0.1 * g END", 4)} AS exit_price FROM a""",
    "ledger_trades": TR + " SELECT symbol, split, rule AS strategy_name, no AS trade_no, eb - 1 - lo AS signal_bar, eb - lo AS entry_bar, xb - lo AS exit_bar, "
                          "CASE WHEN dir = 1 THEN 'LONG' ELSE 'SHORT' END AS direction, " + ", ".join(
                              f"{r(a, 4)} AS {b}" for a, b in (("ep", "entry_price"), ("xp", "exit_price"), ("sl", "stop_loss"), ("tp", "take_profit"), ("lots", "position_size")))
                     + f", why AS exit_reason, pips AS pnl_pips, usd AS pnl_dollars, {r('risk', 2)} AS risk_amount, rm AS r_multiple FROM t",
    "ledger_equity": TR + f" SELECT symbol, split, rule AS strategy_name, no AS trade_no, {r('eq', 2)} AS equity, {r('(peak - eq) / peak * 100', 4)} AS drawdown_pct FROM u",
    "ledger_metrics": metrics(),
    "ledger_metrics_after_warmup": metrics(50),
    "default_parameters": f"SELECT * EXCLUDE (n_closed_sl, n_closed_tp, n_end_of_data) FROM ({metrics(0, trades(DEFAULT_STOP, 3.0))})",
    "ledger_with_empty": TR + f""", g AS (SELECT symbol, split, count(*) AS n, {r('least(CASE WHEN coalesce(sum(usd) FILTER (pips < 0), 0) < 0 THEN coalesce(sum(usd) FILTER (pips > 0), 0) / abs(sum(usd) FILTER (pips < 0)) ELSE 99 END, 99)', 2)} AS pf,
        {r('arg_max(eq, no)', 2)} AS fin FROM t WHERE rule = 'EMACrossoverStrategy' GROUP BY ALL)
      SELECT b.symbol, x.split, y.rule AS strategy_name, coalesce(n, 0) AS total_trades, coalesce(pf, 0) AS profit_factor, coalesce(fin, 10000) AS final_equity
      FROM (SELECT DISTINCT symbol FROM s) b, (VALUES ('train'), ('val')) x(split), (VALUES ('EMACrossoverStrategy'), ('InsideBarBreakoutStrategy')) y(rule)
      LEFT JOIN g ON g.symbol = b.symbol AND g.split = x.split AND y.rule = 'EMACrossoverStrategy'""",
    "ledger_totals": TR + f" SELECT symbol, count(*) AS closed, {r('sum(usd)', 2)} AS realised, count(*) FILTER (why = 'end_of_data') AS open_at_end FROM t GROUP BY symbol",
    "timing_audit": TR + " SELECT symbol, count(*) AS trades, 0 AS bad_delay, 0 AS bad_order, true AS ok FROM t GROUP BY symbol",
    "exit_time_limit": exits(limit=12),
    "exit_trailing_stop": exits("greatest(d * ep - 60, CASE WHEN seen >= 15 THEN d * ep + seen - 20 END)"),
    "exit_breakeven_stop": exits("greatest(d * ep - 60, CASE WHEN seen >= 20 THEN d * ep + 1 END)"),
}

# regime buckets: ledger rows joined with the regime known at their entry bar
_hyst_ctes, _hyst_sel = HYST.removeprefix("WITH RECURSIVE ").rsplit(") SELECT z.symbol", 1)
_hyst = _hyst_ctes.replace("s AS MATERIALIZED (", "hs AS MATERIALIZED (", 1).replace("z(symbol, i, raw", "hz(symbol, i, raw", 1)
_hyst = _hyst.replace("FROM s WHERE i = 0", "FROM hs WHERE i = 0").replace("FROM z JOIN s ON s.symbol = z.symbol AND s.i = z.i + 1", "FROM hz z JOIN hs s ON s.symbol = z.symbol AND s.i = z.i + 1")


def _regime_buckets() -> str:
    from oracles.evidence import metrics as bucket
    live = ("live AS (SELECT z.symbol, z.i, CASE WHEN s.n < 210 THEN 'CHOP' ELSE z.live END AS regime FROM hz z JOIN hs s USING (symbol, i))")
    src = "src AS (SELECT t.symbol, t.split, t.rule AS strategy_name, l.regime, t.eb AS pos, t.usd AS pnl, t.rm FROM t JOIN live l ON l.symbol = t.symbol AND l.i = t.eb WHERE l.regime IS NOT NULL)"
    body = TR.removeprefix("WITH RECURSIVE ")
    return f"WITH RECURSIVE {_hyst}), {live}, {body}, {src}, {bucket('symbol, split, strategy_name, regime', 'bk', 'src')} SELECT * FROM bk"


ORACLES["regime_buckets"] = _regime_buckets()
