"""Registered queries that replay tables as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.indicators import Frame
from barloom.functions.rounding import rnd
from barloom.operators import regime as rg
from barloom.plans.ledger_queries import _positions
from barloom.session import cut_lineage
from barloom.sources.adapters import event_bars, table
from barloom.streaming import twins

C = F.col


def _bars(s, d):
    ticks = twins.closing_tick(table(s, d, "events"), "event_type", "ts")
    out = twins.run_to_table(twins.stream_bars(twins.replay(ticks, "ts"), "event_type", "value", "ts", "event_id", "H1"), s)
    return out.select("symbol", C("ts").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")


def _regimes(s, d):
    f = rg.scores(Frame.of(event_bars(s, d), lookback=900))
    rows = rg.resolve_params(f.own().select("symbol", "timeframe", "ts", "bar_no", "regime_raw", "regime_gap"))
    out = twins.run_to_table(twins.stream_regimes(twins.replay(cut_lineage(rows), "bar_no")), s)
    return out.select("symbol", C("ts").cast("timestamp_ntz").alias("ts"), "bar_no", "regime_raw", "regime", "regime_live")


def _exits(s, d):
    bars, pos = _positions(s, d)
    x = bars.select("symbol", "bar_no", "high", "low")
    out = twins.run_to_table(twins.stream_exits(twins.replay(x, "bar_no"), twins.replay(pos)), s)
    return out.select("symbol", "trade_id", "bar_no", "exit_reason", rnd("exit_price", 4).alias("exit_price"))


QUERIES = {"stream_bars": _bars, "stream_regimes": _regimes, "stream_exits": _exits}
