"""Registered queries over the bar-series ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import instruments as ins
from barloom.functions.rounding import rnd
from barloom.operators import buckets as bk
from barloom.operators import ledger as lg
from barloom.operators import regime as rg
from barloom.operators.resample import timing_audit
from barloom.series import number_bars
from barloom.session import cut_lineage
from barloom.sources.adapters import event_bars

C = F.col
# Stop and target multiples that suit the noisy event prices.
TIGHT = {"sl_atr_mult": 0.5, "tp_atr_mult": 0.75}
VARIANTS = [("EMACrossoverStrategy", TIGHT), ("DonchianBreakoutStrategy", TIGHT), ("VolatilityBreakoutStrategy", TIGHT)]


def event_specs(bars):
    """Specification of every symbol of the bars: one-unit pips, two digits."""
    fields = {"pip_position": 0, "pip_value": 1.0, "spread_avg": 0.2, "min_lot": 0.01, "max_lot": 100.0, "commission_per_lot": 0.1,
              "tick_size": 0.01, "tick_value": 0.01, "volume_step": 0.01}
    return bars.select("symbol").distinct().select("symbol", *[F.lit(v).alias(f) for f, v in fields.items()])


def trades(s, d, variants=None):
    bars = event_bars(s, d)
    return lg.ledger(bars, variants or VARIANTS, event_specs(bars))


def _trades(s, d):
    t = trades(s, d)
    return t.select("symbol", "split", "strategy_name", "trade_no", (C("signal_bar") - C("split_start")).alias("signal_bar"),
                    (C("entry_bar") - C("split_start")).alias("entry_bar"), (C("exit_bar") - C("split_start")).alias("exit_bar"),
                    "direction", *[rnd(c, 4).alias(c) for c in ("entry_price", "exit_price", "stop_loss", "take_profit", "position_size")],
                    "exit_reason", "pnl_pips", "pnl_dollars", rnd("risk_amount", 2).alias("risk_amount"), "r_multiple")


def _entries(s, d):
    bars = event_bars(s, d)
    _, c = lg.entries(bars, VARIANTS, event_specs(bars))
    return c.select("symbol", "split", "strategy_name", "signal_bar", "entry_bar", "is_long",
                    *[rnd(x, 4).alias(x) for x in ("entry_price", "stop_loss", "take_profit")])


def _labels(s, d):
    bars = event_bars(s, d)
    bars, c = lg.entries(bars, VARIANTS, event_specs(bars))
    return lg.barrier_labels(bars, c).select(
        "symbol", "split", "strategy_name", "entry_bar", "is_long", "exit_bar", "exit_reason", rnd("exit_price", 4).alias("exit_price"))


def _metrics(s, d, warmup=0):
    bars = event_bars(s, d)
    t = trades(s, d)
    m = lg.full_metrics(t, lg.bar_seconds(number_bars(bars)), warmup)
    return m.select("symbol", "split", "strategy_name", *lg.FULL,
                    *[F.coalesce(C("exit_reasons")[k], F.lit(0)).alias(f"n_{k}") for k in ("closed_sl", "closed_tp", "end_of_data")])


def _with_empty(s, d):
    """Every rule and split expected, traded or not: the inside-bar rule never fires."""
    variants = [VARIANTS[0], ("InsideBarBreakoutStrategy", TIGHT)]
    bars = event_bars(s, d)
    m = lg.full_metrics(trades(s, d, variants), lg.bar_seconds(number_bars(bars)))
    names = F.explode(F.array(*[F.struct(F.lit(n).alias("strategy_name"), F.lit(lg.param_hash(lg.get(n).params(**o))).alias("param_hash"))
                                for n, o in variants])).alias("_v")
    want = bars.select("symbol", "timeframe").distinct().select("symbol", "timeframe", names).select(
        "symbol", "timeframe", "_v.*", F.explode(F.array(F.lit("train"), F.lit("val"))).alias("split"))
    return lg.with_empty(m, want).select("symbol", "split", "strategy_name", "total_trades", "profit_factor", "final_equity")


def _curve(s, d):
    return lg.equity_curve(trades(s, d)).select("symbol", "split", "strategy_name", "trade_no", "equity", "drawdown_pct")


def _timing(s, d):
    return timing_audit(trades(s, d)).drop("timeframe")


def _totals(s, d):
    return lg.totals(trades(s, d))


def _positions(s, d):
    """Long and short test positions: every bar but the last enters at its open with fixed barriers."""
    b = cut_lineage(number_bars(event_bars(s, d)))
    x = b.filter(C("bar_no") + 1 < C("series_rows"))
    long = C("bar_no") % 2 == 0
    return b, x.select(
        "symbol", "timeframe", C("bar_no").alias("trade_id"), C("bar_no").alias("entry_bar"), long.alias("is_long"), C("open").alias("entry_price"),
        F.when(long, C("open") - 60).otherwise(C("open") + 60).alias("stop_loss"),
        F.when(long, C("open") + 90).otherwise(C("open") - 90).alias("take_profit"), F.lit(0.1).alias("half_spread"), F.lit(0.0).alias("slippage"), F.lit(1.0).alias("pip"),
        C("series_rows").alias("end_bar"))


def _exits(**kw):
    def run(s, d):
        b, p = _positions(s, d)
        out = lg.follow(b, p, ("trade_id",), lg.ExitRule(**kw))
        return out.select("symbol", "trade_id", "bars_held", "exit_reason", rnd("exit_price", 4).alias("exit_price"))
    return run


def _by_regime(s, d):
    """Ledger metrics by the regime known at the entry bar."""
    bars = event_bars(s, d)
    t = trades(s, d)
    b = bk.bucket_by_regime(t, rg.regimes(bars))
    m = bk.bucket_metrics(b, [*lg.LEDGER, "regime"])
    return m.drop("timeframe", "param_hash")


QUERIES = {
    "entry_candidates": _entries,
    "barrier_labels": _labels,
    "ledger_trades": _trades,
    "ledger_equity": _curve,
    "ledger_metrics": _metrics,
    "ledger_metrics_after_warmup": lambda s, d: _metrics(s, d, 50),
    "ledger_with_empty": _with_empty,
    "ledger_totals": _totals,
    "timing_audit": _timing,
    "exit_time_limit": _exits(max_bars=12),
    "exit_trailing_stop": _exits(trailing_pips=20.0, trail_after=15.0),
    "exit_breakeven_stop": _exits(breakeven_after=20.0, breakeven_offset=1.0),
    "regime_buckets": _by_regime,
}
