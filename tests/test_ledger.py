"""Ledger: hand cases and independence from chunking."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import ledger as lg
from barloom.plans.ledger_queries import TIGHT
from barloom.series import number_bars

BASE = {"symbol": "A", "timeframe": "H1", "split": "train", "strategy_name": "s", "param_hash": "h", "half_spread": 0.1, "slippage": 0.05, "split_start": 0}
MONEY = {"pip_position": 0, "pip_value": 1.0, "spread_avg": 0.2, "min_lot": 0.01, "max_lot": 100.0, "commission_per_lot": 0.1, "tick_size": 0.01,
         "tick_value": 0.01, "volume_step": 0.01}


def _run(spark, ohlc, entries, chunk_rows=65536):
    n = len(ohlc)
    b = pd.DataFrame(ohlc, columns=["open", "high", "low", "close"]).astype(float)
    b = b.assign(symbol="A", timeframe="H1", bar_no=range(n), ts=pd.date_range("2024-01-01", periods=n, freq="h"), series_rows=n)
    e = pd.DataFrame([{**BASE, "signal_bar": bar - 1, "entry_bar": bar, "is_long": d == 1, "entry_price": px, "stop_loss": px - d * sl, "take_profit": px + d * tp,
                       "signal_time": b.ts[max(bar - 1, 0)], "entry_time": b.ts[bar], "split_end": n} for bar, d, px, sl, tp in entries])
    out = lg.take_positions(spark.createDataFrame(b), spark.createDataFrame(e), chunk_rows)
    return out.toPandas().sort_values("entry_bar", ignore_index=True)


def test_stop_wins_when_one_bar_touches_both(spark):
    t = _run(spark, [(10, 11, 9, 10), (10, 10.5, 9.5, 10), (10, 20, 1, 10)], [(1, 1, 10.0, 2, 2)])
    assert t.exit_reason[0] == "closed_sl" and t.exit_bar[0] == 2 and t.exit_price[0] == pytest.approx(8 - 0.05)


def test_entry_bar_is_not_tested_and_reentry_on_the_exit_bar(spark):
    t = _run(spark, [(10, 11, 9, 10), (10, 20, 1, 10), (10, 13, 9.9, 12), (12, 12.5, 11.5, 12), (12, 12.1, 11.9, 12)], [(1, 1, 10.0, 2, 2), (2, 1, 10.2, 3, 5), (3, -1, 12.0, 1, 1)])
    assert t.entry_bar.tolist() == [1, 2] and t.exit_bar.tolist() == [2, 4]
    assert t.exit_reason.tolist() == ["closed_tp", "end_of_data"] and t.exit_price[1] == pytest.approx(12 - 0.1)


def test_short_leaves_on_the_ask(spark):
    t = _run(spark, [(10, 10, 10, 10)] * 2 + [(10, 10.95, 9.5, 10)], [(1, -1, 10.0, 1, 5)])
    assert t.exit_reason[0] == "closed_sl" and t.exit_price[0] == pytest.approx(11.05)


def test_position_crosses_chunks(spark):
    ohlc = [(10, 10.2, 9.8, 10)] * 40 + [(10, 30, 9.8, 10)] + [(10, 10.2, 9.8, 10)] * 9
    entries = [(2, 1, 10.0, 5, 5), (7, 1, 10.0, 5, 5), (38, -1, 10.0, 50, 50), (41, 1, 10.0, 5, 5), (44, 1, 10.0, 5, 5)]
    a, b = _run(spark, ohlc, entries), _run(spark, ohlc, entries, 6)
    cols = ["entry_bar", "exit_bar", "exit_reason", "exit_price"]
    assert a[cols].equals(b[cols]) and a.entry_bar.tolist() == [2, 41]


def test_money_compounds_and_clamps(spark):
    rows = [{**BASE, **MONEY, "entry_bar": i, "is_long": True, "entry_price": 100.0, "stop_loss": 90.0, "exit_price": px} for i, px in enumerate([110.0, 90.0, 120.0])]
    t = lg.money(spark.createDataFrame(pd.DataFrame(rows))).toPandas().sort_values("entry_bar")
    assert t.position_size.tolist() == [10.0, 10.09, 9.99]
    assert t.pnl_dollars.tolist() == [99.0, -101.91, 198.8]
    assert t.loss_run.tolist() == [0, 1, 0] and t.r_multiple.iloc[0] == pytest.approx(0.99)


def test_ledger_does_not_depend_on_chunk_size(spark, bars):
    specs = spark.createDataFrame([(s, *MONEY.values()) for s in ("AAA", "BBB")], "symbol string, pip_position int, " + ", ".join(f"{k} double" for k in list(MONEY)[1:]))
    v = [("EMACrossoverStrategy", {**TIGHT, "sl_atr_mult": 3.0, "tp_atr_mult": 5.0}), ("MomentumBurstStrategy", TIGHT)]
    key = ["symbol", "split", "strategy_name", "entry_bar"]
    a, b = (lg.ledger(bars, v, specs, chunk_rows=c).select(*key, "exit_bar", "pnl_dollars", "equity_after").toPandas().sort_values(key, ignore_index=True) for c in (65536, 50))
    assert len(a) > 30 and a.equals(b)
    plain, cand = lg.entries(bars, v, specs)
    one, many = (lg.take_positions(plain, cand, batches=k).select(*key, "exit_bar").toPandas().sort_values(key, ignore_index=True) for k in (1, 3))
    assert len(one) == len(a) and one.equals(many)
    t = lg.ledger(bars, v, specs)
    m = lg.full_metrics(t, lg.bar_seconds(number_bars(bars)))
    got = m.agg(F.sum("total_trades")).first()[0]
    assert got == len(a)
