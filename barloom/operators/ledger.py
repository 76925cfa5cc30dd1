"""Trade ledger: entries from signals, first barrier touch, one position at a time, compounding size.

Three stages with different parallelism:
1. entries are stateless columns of the signal bar and the bar after it;
2. which entries are taken and where they leave depends on prices only, so it runs per (series, chunk); a position
   still open at the end of a chunk is handed to the next chunk and only chunks whose opening position changed rerun;
3. money compounds from trade to trade and is a constant-memory pass over the sorted trades of each ledger.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions import instruments as ins
from barloom.functions.rounding import rnd
from barloom.functions.scoring import DEFAULT, Config
from barloom.operators.resample import split_bounds
from barloom.series import chunk_length, number_bars
from barloom.session import cut_lineage
from barloom.strategies.base import get, param_hash
from barloom.strategies.signals import signal_columns

C = F.col
LEDGER = ("symbol", "timeframe", "split", "strategy_name", "param_hash")
SPEC = ("pip_position", "pip_value", "spread_avg", "min_lot", "max_lot", "commission_per_lot", "tick_size", "tick_value", "volume_step")


def entries(bars: DataFrame, variants: Sequence, specs: DataFrame, cfg: Config = DEFAULT, chunk_rows: int | None = None,
            ranges: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(numbered bars, entry candidates per split).  A signal enters at the open of the next bar.

    ``ranges``: the splits (split, lo, hi) that may hold a signal, an array over symbol, timeframe, signal_bar and series_rows; train and validation
    unless given.  An entry whose loss per lot isn't positive can't be sized and is left out, so that it takes no position.
    """
    numbered = bars if "bar_no" in bars.columns else number_bars(bars, chunk_rows=chunk_rows)
    # sets that differ in stop and target only share a signal column
    sets: dict[tuple[str, str], list[tuple[str, float, float]]] = {}
    plain_variants = {}
    for v in variants:
        name, over = (v, {}) if isinstance(v, str) else v
        p = get(name).params(**over)
        base = {k: x for k, x in p.items() if k not in ("sl_atr_mult", "tp_atr_mult")}
        key = param_hash(get(name).params(**base))
        plain_variants[get(name).name, key] = (name, base)
        sets.setdefault((get(name).name, key), []).append((param_hash(p), float(p["sl_atr_mult"]), float(p["tp_atr_mult"])))
    wide, meta = signal_columns(numbered, list(plain_variants.values()), extra=["ATR_14"], chunk_rows=chunk_rows)
    rows = F.array(*[F.struct(F.lit(n).alias("strategy_name"), F.array(*[
        F.struct(F.lit(h).alias("param_hash"), F.lit(sl).alias("sl_mult"), F.lit(tp).alias("tp_mult")) for h, sl, tp in sets[n, key]]).alias("sets"),
        C(c).alias("signal")) for c, n, key in meta])
    fired = wide.select("symbol", "timeframe", C("ts").alias("signal_time"), C("bar_no").alias("signal_bar"), "series_rows", "ATR_14",
                        F.explode(F.filter(rows, lambda r: r["signal"] != 0)).alias("_r"))
    fired = fired.select("symbol", "timeframe", "signal_time", "signal_bar", "series_rows", "ATR_14", "_r.strategy_name", "_r.signal",
                         F.explode("_r.sets").alias("_v"), (C("signal_bar") + 1).alias("entry_bar")).select("*", "_v.*").drop("_v")
    # prices come from the numbered bars, so the indicator passes run once, for the signals only
    plain = numbered.select("symbol", "timeframe", "ts", "bar_no", "series_rows", "open", "high", "low", "close")
    nxt = plain.select("symbol", "timeframe", C("bar_no").alias("entry_bar"), C("open").alias("_open"), C("ts").alias("entry_time"))
    x = fired.join(nxt, ["symbol", "timeframe", "entry_bar"]).join(specs.select("symbol", *SPEC), "symbol")
    is_long = C("signal") == 1
    slip = cfg.slippage_pips if cfg.use_slippage else 0.0
    size = ins.pip_size(C("pip_position"))
    half = ins.half_spread() if cfg.use_spread else F.lit(0.0)
    sl_pips, tp_pips = ins.atr_stops(C("ATR_14"), C("sl_mult"), C("tp_mult"))
    x = x.withColumns({"is_long": is_long, "half_spread": half, "slippage": slip * size, "_slp": sl_pips, "_tpp": tp_pips})
    x = x.filter(C("_slp").isNotNull()).withColumn(
        "entry_price", F.when(is_long, C("_open") + half).otherwise(C("_open") - half))
    sl, tp = ins.stop_prices(C("entry_price"), C("_slp"), C("_tpp"), is_long)
    x = x.withColumns({"stop_loss": sl, "take_profit": tp})
    by_tick = (C("tick_size") > 0) & (C("tick_value") > 0)
    worth = F.when(by_tick, C("tick_value") / C("tick_size")).otherwise(C("pip_value") / size)
    x = x.filter(F.when(is_long, C("entry_price") - sl).otherwise(sl - C("entry_price")) * worth > 0)
    end, start = split_bounds(C("series_rows"))
    ranges = ranges if ranges is not None else F.array(F.struct(F.lit("train").alias("split"), F.lit(0).cast("long").alias("lo"), end.alias("hi")),
                     F.struct(F.lit("val").alias("split"), start.alias("lo"), C("series_rows").alias("hi")))
    x = x.withColumn("_s", F.explode(ranges)).filter((C("signal_bar") >= C("_s.lo")) & (C("entry_bar") < C("_s.hi")))
    return plain, x.select(
        *LEDGER[:2], C("_s.split").alias("split"), "strategy_name", "param_hash", "signal_bar", "entry_bar", "signal_time", "entry_time",
        "is_long", "entry_price", "stop_loss", "take_profit", "half_spread", "slippage", C("_s.lo").alias("split_start"),
        C("_s.hi").alias("split_end"), *SPEC)


# Rules that share one copy of the bars of a chunk.
BATCH_RULES = 16
_POSITION = ("split", "strategy_name", "param_hash", "signal_bar", "entry_bar", "signal_time", "entry_time", "is_long", "entry_price",
             "stop_loss", "take_profit", "half_spread", "slippage", "split_start", "split_end")


def _first_hit(high, low, start: int, stop: int, long: bool, sl: float, tp: float, half: float) -> tuple[int, str] | None:
    """First bar in [start, stop) that touches a barrier; the stop is tested before the target."""
    step = 64
    while start < stop:
        end = min(start + step, stop)
        if long:
            hit_sl, hit_tp = low[start:end] - half <= sl, high[start:end] - half >= tp
        else:
            hit_sl, hit_tp = high[start:end] + half >= sl, low[start:end] + half <= tp
        any_hit = np.flatnonzero(hit_sl | hit_tp)
        if len(any_hit):
            k = any_hit[0]
            return start + int(k), "closed_sl" if hit_sl[k] else "closed_tp"
        start, step = end, step * 2
    return None


def _walk(bars: pd.DataFrame, cand: pd.DataFrame, one_position: bool = True) -> pd.DataFrame:
    """Trades closed in one chunk, and the position left open at its end, for every ledger of the chunk.

    A candidate whose entry lies before the chunk is the position carried in.
    """
    bars = bars.sort_values("bar_no", ignore_index=True)
    base, count = int(bars["bar_no"].iloc[0]), len(bars)
    high, low, close = (bars[c].to_numpy() for c in ("high", "low", "close"))
    when = bars["ts"]
    out = []
    for _, g in cand.sort_values("entry_bar").groupby(["split", "strategy_name", "param_hash"], sort=False):
        free = -1
        for e in g.to_dict("records"):
            at = int(e["entry_bar"])
            if one_position and at < free:
                continue
            last = min(int(e["split_end"]) - base, count)
            hit = _first_hit(high, low, max(at + 1 - base, 0), last, e["is_long"], e["stop_loss"], e["take_profit"], e["half_spread"])
            row = {k: e[k] for k in _POSITION}
            if hit:
                k, why = hit
                price = e["take_profit"] if why == "closed_tp" else e["stop_loss"] - (e["slippage"] if e["is_long"] else -e["slippage"])
                row |= {"kind": "trade", "exit_bar": base + k, "exit_time": when.iloc[k], "exit_price": price, "exit_reason": why}
                free = base + k
            elif int(e["split_end"]) <= base + count:
                price = close[last - 1] - (e["half_spread"] if e["is_long"] else -e["half_spread"])
                row |= {"kind": "trade", "exit_bar": base + last - 1, "exit_time": when.iloc[last - 1], "exit_price": price, "exit_reason": "end_of_data"}
                free = int(e["split_end"])
            else:
                row |= {"kind": "open", "exit_bar": None, "exit_time": pd.NaT, "exit_price": None, "exit_reason": None}
                free = base + count
            out.append(row)
    return pd.DataFrame(out)


def take_positions(bars: DataFrame, cand: DataFrame, chunk_rows: int | None = None, one_position: bool = True,
                   batches: int = 1) -> DataFrame:
    """Entries actually taken with their exits.

    One group holds the bars of a chunk and the candidates of one batch of rules; ``batches`` splits the rules of a
    large sweep, each batch with its own copy of the bars, so a group stays small however many rules there are.
    """
    chunk_rows = chunk_length(bars, chunk_rows)
    on = ["symbol", "timeframe", "_chunk", "_batch"]
    bon = [f"b_{k}" for k in on]
    b = bars.select(C("symbol").alias("b_symbol"), C("timeframe").alias("b_timeframe"), "ts", "bar_no", "high", "low", "close",
                    F.expr(f"bar_no div {chunk_rows}").alias("b__chunk"),
                    F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("b__batch"))
    c = cand.select("symbol", "timeframe", *_POSITION, F.expr(f"entry_bar div {chunk_rows}").alias("_chunk"),
                    F.pmod(F.hash("strategy_name", "param_hash"), F.lit(batches)).alias("_batch"))
    b, c = cut_lineage(b), cut_lineage(c)
    schema = T.StructType([c.schema[k] for k in on] + [c.schema[k] for k in _POSITION] + [
        T.StructField("kind", T.StringType()), T.StructField("exit_bar", T.LongType()), T.StructField("exit_time", T.TimestampType()),
        T.StructField("exit_price", T.DoubleType()), T.StructField("exit_reason", T.StringType())])
    names = schema.fieldNames()

    def run(key, bars_pdf: pd.DataFrame, cand_pdf: pd.DataFrame) -> pd.DataFrame:
        if not len(bars_pdf) or not len(cand_pdf):
            return pd.DataFrame(columns=names)
        out = _walk(bars_pdf, cand_pdf, one_position)
        for k, v in zip(on, key):
            out[k] = v
        return out.reindex(columns=names)

    go = lambda x: b.groupBy(*bon).cogroup(x.groupBy(*on)).applyInPandas(run, schema)
    lk = ["symbol", "timeframe", "split", "strategy_name", "param_hash"]
    result, used = cut_lineage(go(c)), None
    while True:
        # what every chunk should start with: the position its predecessor left open
        carry = result.filter(C("kind") == "open").withColumn("_chunk", C("_chunk") + 1).select(*c.columns)
        if used is None:
            changed = carry.select(*lk, "_chunk")
        else:
            a = carry.select(*lk, "_chunk", C("entry_bar").alias("n"))
            o = used.select(*lk, "_chunk", C("entry_bar").alias("o"))
            changed = a.join(o, [*lk, "_chunk"], "full_outer").filter(~C("n").eqNullSafe(C("o"))).select(*lk, "_chunk")
        changed = cut_lineage(changed.distinct())
        if changed.isEmpty():
            break
        used = cut_lineage(carry)
        again = c.join(changed, [*lk, "_chunk"], "left_semi").unionByName(used.join(changed, [*lk, "_chunk"], "left_semi"))
        result = cut_lineage(result.join(changed, [*lk, "_chunk"], "left_anti").unionByName(go(again)))
    return result.filter(C("kind") == "trade").drop("kind", "_chunk", "_batch")


def ledger(bars: DataFrame, variants: Sequence, specs: DataFrame, cfg: Config = DEFAULT, chunk_rows: int | None = None,
           ranges: Column | None = None) -> DataFrame:
    """Complete trade ledger of the rule variants on every series and split (``ranges`` as in ``entries``)."""
    plain, cand = entries(bars, variants, specs, cfg, chunk_rows, ranges)
    taken = take_positions(plain, cand, chunk_rows, batches=math.ceil(len(variants) / BATCH_RULES))
    return money(taken.join(specs.select("symbol", *SPEC), "symbol"), cfg)


_PATH = ("entry_bar", "end_bar", "is_long", "entry_price", "stop_loss", "take_profit", "half_spread", "slippage", "pip")


@dataclass(frozen=True)
class ExitRule:
    """What moves the stop or ends a position besides its barriers; zero switches a part off."""

    max_bars: int = 0
    trailing_pips: float = 0.0
    trail_after: float = 0.0
    breakeven_after: float = 0.0
    breakeven_offset: float = 0.0

    def stops(self, stop: float, entry: float, pip: float, seen: np.ndarray) -> np.ndarray:
        """Stop on each bar in long terms, from the best gain seen before it."""
        out = np.full(len(seen), stop)
        if self.trailing_pips > 0:
            out = np.where(seen >= self.trail_after, np.maximum(out, entry + (seen - self.trailing_pips) * pip), out)
        if self.breakeven_after > 0:
            out = np.where(seen >= self.breakeven_after, np.maximum(out, entry + self.breakeven_offset * pip), out)
        return out


def _leave(high, low, close, base: int, count: int, e, rule: ExitRule):
    """(exit bar, reason, price, best gain) of one position within a chunk; the bar is None while it stays open."""
    side = 1.0 if e.is_long else -1.0
    # a short is a long in mirrored prices
    near, far = (low, high) if e.is_long else (-high, -low)
    stop, target, entry = e.stop_loss * side, e.take_profit * side, e.entry_price * side
    at, last, step, seen = max(e.entry_bar + 1 - base, 0), min(e.end_bar - base, count), 64, e.seen
    while at < last:
        to = min(at + step, last)
        gains = (close[at:to] * side - entry) / e.pip
        best = np.maximum.accumulate(np.concatenate(([seen], gains)))
        stops = rule.stops(stop, entry, e.pip, best[:-1])
        hit_sl, hit_tp = near[at:to] - e.half_spread <= stops, far[at:to] - e.half_spread >= target
        late = np.arange(at, to) + base - e.entry_bar >= rule.max_bars if rule.max_bars else np.zeros(to - at, bool)
        hits = np.flatnonzero(hit_sl | hit_tp | late)
        if len(hits):
            k = hits[0]
            if hit_sl[k]:
                return base + at + k, "closed_sl", (stops[k] - e.slippage) * side, best[k]
            if hit_tp[k]:
                return base + at + k, "closed_tp", e.take_profit, best[k]
            return base + at + k, "closed_time", (high[at + k] + low[at + k]) / 2, best[k]
        seen, at, step = best[-1], to, step * 2
    if e.end_bar <= base + count:
        k = max(last - 1, 0)
        return base + k, "end_of_data", close[k] - e.half_spread * side, seen
    return None, None, None, seen


def follow(bars: DataFrame, pos: DataFrame, ids: Sequence[str], rule: ExitRule = ExitRule(), chunk_rows: int | None = None) -> DataFrame:
    """Exit of every position on its own: ``ids``, exit_bar, bars_held, exit_reason, exit_price.

    ``pos`` holds the series keys, ``ids`` and the columns of ``_PATH``; ``end_bar`` is the bar after the last one that counts.  A chunk follows
    the positions that are open in it; those still open go on to the next chunk, until all have left or their data ends.
    """
    n = chunk_length(bars, chunk_rows)
    on = ["symbol", "timeframe", "_chunk"]
    extra = [c for c in ids if c not in (*on, *_PATH)]
    bon = [f"b_{k}" for k in on]  # positions may be made from the same bars
    b = cut_lineage(bars.select(C("symbol").alias("b_symbol"), C("timeframe").alias("b_timeframe"), F.expr(f"bar_no div {n}").alias("b__chunk"),
                                "bar_no", "high", "low", "close"))
    live = pos.select("symbol", "timeframe", *extra, *_PATH, F.lit(float("-inf")).alias("seen"), F.expr(f"entry_bar div {n}").alias("_chunk"))
    schema = T.StructType([*live.schema.fields, T.StructField("exit_bar", T.LongType()), T.StructField("exit_reason", T.StringType()),
                           T.StructField("exit_price", T.DoubleType())])
    names = schema.fieldNames()

    def run(bars_pdf: pd.DataFrame, pos_pdf: pd.DataFrame) -> pd.DataFrame:
        if not len(pos_pdf) or not len(bars_pdf):
            return pd.DataFrame(columns=names)
        bars_pdf = bars_pdf.sort_values("bar_no")
        high, low, close = (bars_pdf[c].to_numpy(float) for c in ("high", "low", "close"))
        base, count = int(bars_pdf["bar_no"].iloc[0]), len(bars_pdf)
        left = [_leave(high, low, close, base, count, e, rule) for e in pos_pdf.itertuples()]
        bar, why, price, seen = zip(*left, strict=True)
        out = pos_pdf.assign(seen=seen, exit_reason=list(why), exit_price=pd.array(price, dtype="Float64"), exit_bar=pd.array(bar, dtype="Int64"))
        return out[names]

    left = []
    while True:
        here = b.join(live.select(*[C(k).alias(f"b_{k}") for k in on]).distinct(), bon, "left_semi")
        out = cut_lineage(here.groupBy(*bon).cogroup(live.groupBy(*on)).applyInPandas(run, schema))
        left.append(out.filter("exit_bar IS NOT NULL"))
        live = out.filter("exit_bar IS NULL").drop("exit_bar", "exit_reason", "exit_price").withColumn("_chunk", C("_chunk") + 1)
        if live.isEmpty():
            break
    return reduce(DataFrame.unionByName, left).select(
        "symbol", "timeframe", *[c for c in ids if c not in ("symbol", "timeframe", "entry_bar")], "entry_bar", "exit_bar", (C("exit_bar") - C("entry_bar")).alias("bars_held"), "exit_reason", "exit_price")


def barrier_labels(bars: DataFrame, cand: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """First barrier touched by every entry on its own, without the one-position rule."""
    pos = cand.withColumns({"end_bar": C("split_end"), "pip": F.lit(1.0)})
    return follow(bars, pos, (*LEDGER[2:], "is_long"), chunk_rows=chunk_rows)


def marks(bars: DataFrame, exits: DataFrame, ids: Sequence[str]) -> DataFrame:
    """A row for each position and bar from its entry to its exit, with that bar's close."""
    bar = F.explode(F.sequence("entry_bar", "exit_bar")).alias("bar_no")
    return exits.select("symbol", "timeframe", *ids, bar).join(bars.select("symbol", "timeframe", "bar_no", "close"), ["symbol", "timeframe", "bar_no"])


_MONEY = ("position_size double, risk_amount double, pnl_pips double, pnl_dollars double, equity_after double, curve_before double, "
          "drawdown_pct double, win_run long, loss_run long, trade_no long")


def _floor2(x: float) -> float:
    return math.floor(x * 100 + 0.500001) / 100


def money(taken: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Size and result of each trade from the live equity of its ledger.

    Compounding is sequential, so each ledger is one sorted stream; it holds only trades, is never collected, and the
    pass keeps one small state.
    """
    schema = T.StructType(taken.schema.fields + T._parse_datatype_string(_MONEY).fields)
    keys = list(LEDGER)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, equity, curve, peak, worst, wins, losses, no = None, 0.0, 0.0, 0.0, 0.0, 0, 0, 0
        for p in batches:
            rows = []
            for t in p.to_dict("records"):
                k = tuple(t[c] for c in keys)
                if k != key:
                    key, equity, curve, peak, worst, wins, losses, no = k, cfg.initial_capital, cfg.initial_capital, cfg.initial_capital, 0.0, 0, 0, 0
                side = 1 if t["is_long"] else -1
                pip = 10.0 ** -t["pip_position"]
                by_tick = t["tick_size"] > 0 and t["tick_value"] > 0
                unit, value = (t["tick_size"], t["tick_value"]) if by_tick else (pip, t["pip_value"])
                risk = equity * (cfg.position_size_pct / 100.0)
                per_lot = (t["entry_price"] - t["stop_loss"]) * side / unit * value
                step = t["volume_step"] if t["volume_step"] > 0 else 0.01
                lots = min(max(math.floor(risk / per_lot / step) * step, t["min_lot"]), t["max_lot"])
                lots = round(lots, 8)
                move = (t["exit_price"] - t["entry_price"]) * side
                pnl = move / unit * value * lots - (t["commission_per_lot"] * lots if cfg.use_commission else 0.0)
                before, pips = curve, _floor2(move / pip)
                equity, no = equity + pnl, no + 1
                curve += _floor2(pnl)
                peak = max(peak, equity)
                dd = (peak - equity) / peak * 100 if peak > 0 else 0.0
                wins, losses = (wins + 1, 0) if pips > 0 else (0, losses + 1)
                rows.append((lots, risk, pips, _floor2(pnl), equity, before, dd, wins, losses, no))
            extra = pd.DataFrame(rows, columns=[f.split()[0] for f in _MONEY.split(", ")], index=p.index)
            yield pd.concat([p, extra], axis=1)

    ordered = taken.repartition(*keys).sortWithinPartitions(*keys, "entry_bar")
    x = ordered.mapInPandas(run, schema)
    return x.withColumn("r_multiple", F.when(C("risk_amount") > 0, rnd(C("pnl_dollars") / C("risk_amount"), 3)).otherwise(0.0)).withColumn(
        "direction", F.when(C("is_long"), "LONG").otherwise("SHORT")).drop(*[s for s in SPEC])


def bar_seconds(bars: DataFrame) -> DataFrame:
    """Seconds between the first two bars of each split."""
    end, start = split_bounds(C("series_rows"))
    pick = lambda k: F.max(F.when(C("bar_no") == k, F.unix_timestamp("ts")))
    t = bars.groupBy("symbol", "timeframe").agg((pick(1) - pick(0)).alias("train"), (pick(start + 1) - pick(start)).alias("val"))
    return t.select("symbol", "timeframe", F.explode(F.create_map(F.lit("train"), C("train"), F.lit("val"), C("val"))).alias("split", "bar_secs"))


FULL = ("total_trades", "winning_trades", "losing_trades", "breakeven_trades", "win_rate", "total_pnl", "total_return_pct", "gross_profit",
        "gross_loss", "profit_factor", "avg_win_pips", "avg_loss_pips", "avg_trade_pips", "avg_win_dollars", "avg_loss_dollars",
        "avg_trade_dollars", "max_drawdown_pct", "expectancy_pips", "sharpe_ratio", "sortino_ratio", "calmar_ratio", "mean_r", "median_r",
        "pct_positive_r", "worst_5pct_r", "max_consecutive_wins", "max_consecutive_losses", "avg_trade_duration", "max_trade_duration",
        "min_trade_duration", "long_trades", "short_trades", "long_win_rate", "short_win_rate", "final_equity")


def full_metrics(trades: DataFrame, spacing: DataFrame, warmup_bars: int = 0, cfg: Config = DEFAULT) -> DataFrame:
    """All ledger metrics per rule, series and split.  Wins are judged on pips, money on dollars."""
    pnl, pips, r = C("pnl_dollars"), C("pnl_pips"), C("r_multiple")
    ret = pnl / F.when(C("curve_before") != 0, C("curve_before")).otherwise(1.0)
    kept = C("entry_bar") - C("split_start") >= warmup_bars
    x = trades.withColumns({"_ret": ret, "_kept": kept})
    wins, losses = C("win_run"), C("loss_run")
    if warmup_bars:
        # a streak counts only its trades after the warm-up; equity, returns and drawdown keep the whole ledger
        first = x.filter("_kept").groupBy(*LEDGER).agg(F.min("trade_no").alias("_first"))
        x = x.join(first, list(LEDGER))
        since = C("trade_no") - C("_first") + 1
        wins, losses = F.least(wins, since), F.least(losses, since)
    k = lambda v: F.when(C("_kept"), v)
    n = lambda cond: F.sum(F.when(C("_kept") & cond, 1).otherwise(0))
    s = lambda cond, v: F.sum(F.when(C("_kept") & cond, v).otherwise(0.0))
    long, hold = C("is_long"), k(C("exit_bar") - C("entry_bar"))
    a = x.groupBy(*LEDGER).agg(
        n(F.lit(True)).alias("n"), n(pips > 0).alias("w"), n(pips < 0).alias("l"), F.sum(k(pnl)).alias("pnl"),
        s(pips > 0, pnl).alias("wp"), F.abs(s(pips < 0, pnl)).alias("lp"), s(pips > 0, pips).alias("wpip"), s(pips < 0, pips).alias("lpip"),
        F.sum(k(pips)).alias("pips"), F.max("drawdown_pct").alias("mdd"), F.max_by("equity_after", "trade_no").alias("fin"),
        F.count(F.lit(1)).alias("na"), F.avg("_ret").alias("rm"), F.stddev_samp("_ret").alias("rs"),
        F.sum(F.when(C("_ret") < 0, 1).otherwise(0)).alias("rn"),
        F.stddev_samp(F.when(C("_ret") < 0, C("_ret"))).alias("rds"), F.min("_ret").alias("rmin"),
        F.avg(k(r)).alias("mr"), F.percentile(k(r), F.array(F.lit(0.5), F.lit(0.05))).alias("pr"), F.min(k(r)).alias("minr"), n(r > 0).alias("rp"),
        F.max(k(wins)).alias("cw"), F.max(k(losses)).alias("cl"), F.avg(hold).alias("ad"), F.max(hold).alias("xd"), F.min(hold).alias("nd"),
        n(long).alias("nl"), n(~long).alias("ns"), n(long & (pips > 0)).alias("wl"), n(~long & (pips > 0)).alias("ws"),
        *[n(C("exit_reason") == e).alias(e) for e in ("closed_sl", "closed_tp", "end_of_data")]).filter(C("n") > 0)
    a = a.join(spacing, ["symbol", "timeframe", "split"])
    c = C
    q = lambda num, den, k=1.0: F.when(den > 0, num / den * k).otherwise(0.0)
    year = F.sqrt(86400.0 / F.greatest(c("bar_secs"), F.lit(60)) * 252)
    wr = q(c("w"), c("n"), 100.0)
    aw, al = q(c("wpip"), c("w")), F.abs(q(c("lpip"), c("l")))
    sharpe = F.when((c("na") >= 2) & (c("rs") > 1e-10), c("rm") / c("rs") * year).otherwise(0.0)
    sortino = (F.when(c("na") < 2, 0.0).when(c("rn") >= 2, F.when(c("rds") > 1e-10, c("rm") / c("rds") * year).otherwise(0.0))
               .when(c("rn") == 1, F.when(F.abs(c("rmin")) > 1e-10, c("rm") / F.abs(c("rmin")) * year).otherwise(0.0))
               .when((c("rm") > 0) & (sharpe > 0), sharpe * 2).otherwise(0.0))
    total = (c("fin") - cfg.initial_capital) / cfg.initial_capital * 100
    expect = F.when(wr > 0, wr / 100 * aw - (1 - wr / 100) * al).otherwise(-al)
    vals = [c("n"), c("w"), c("l"), c("n") - c("w") - c("l"), rnd(wr, 2), rnd("pnl", 2), rnd(total, 2), rnd("wp", 2), rnd("lp", 2),
            rnd(F.least(F.when(c("lp") > 0, c("wp") / c("lp")).otherwise(99.0), F.lit(99.0)), 2), rnd(aw, 2), rnd(al, 2), rnd(q(c("pips"), c("n")), 2),
            rnd(q(c("wp"), c("w")), 2), rnd(q(c("lp"), c("l")), 2), rnd(q(c("pnl"), c("n")), 2), rnd("mdd", 2), rnd(expect, 2), rnd(sharpe, 2),
            rnd(sortino, 2), rnd(q(total, c("mdd")), 2), rnd("mr", 3), rnd(c("pr")[0], 3), rnd(q(c("rp"), c("n"), 100.0), 2),
            rnd(F.when(c("n") >= 20, c("pr")[1]).otherwise(c("minr")), 3), c("cw"), c("cl"), rnd("ad", 1), c("xd"), c("nd"), c("nl"), c("ns"),
            rnd(q(c("wl"), c("nl"), 100.0), 2), rnd(q(c("ws"), c("ns"), 100.0), 2), rnd("fin", 2)]
    reasons = F.map_filter(F.create_map(*[z for e in ("closed_sl", "closed_tp", "end_of_data") for z in (F.lit(e), c(e))]), lambda k, v: v > 0)
    return a.select(*LEDGER, *[v.alias(nm) for v, nm in zip(vals, FULL)], reasons.alias("exit_reasons"))


def with_empty(metrics: DataFrame, expected: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Rules that never traded get the empty result row."""
    x = expected.join(metrics, list(LEDGER), "left")
    zero = {m: F.coalesce(C(m), F.lit(cfg.initial_capital if m == "final_equity" else 0)) for m in FULL}
    return x.withColumns(zero)


def equity_curve(trades: DataFrame) -> DataFrame:
    return trades.select(*LEDGER, "trade_no", "exit_bar", rnd("equity_after", 2).alias("equity"), rnd("drawdown_pct", 4).alias("drawdown_pct"))


def totals(trades: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """Open count, unrealised and realised sums per symbol."""
    real = trades.groupBy("symbol").agg(F.count(F.lit(1)).alias("closed"), rnd(F.sum("pnl_dollars"), 2).alias("realised"),
                                        F.sum(F.when(C("exit_reason") == "end_of_data", 1).otherwise(0)).alias("open_at_end"))
    if marks is None:
        return real
    return real.join(marks.groupBy("symbol").agg(rnd(F.sum("unrealised_dollars"), 2).alias("unrealised")), "symbol", "left")
