"""Signals of any set of rules over any number of series, as one long table."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

import barloom.strategies.intervals  # noqa: F401  (registers the rules)
import barloom.strategies.machines  # noqa: F401
import barloom.strategies.rules  # noqa: F401
from barloom.functions.indicators import Frame, lookback, recursive_needs
from barloom.operators.chunk_scan import chunk_scan
from barloom.series import KEYS, number_bars, own_rows
from barloom.session import cut_lineage
from barloom.strategies.base import Strategy, get, names, param_hash, to_signal

Variant = tuple[str, dict]


def _plan(variants: Sequence[Variant | str] | None) -> list[tuple[Strategy, dict, str]]:
    plan = []
    for v in variants if variants is not None else names():
        name, override = (v, {}) if isinstance(v, str) else v
        s = get(name)
        p = s.params(**override)
        plan.append((s, p, param_hash(p)))
    return plan


def _context(plan) -> int:
    digits = [int(v) for _, p, _ in plan for v in p.values() if isinstance(v, int) and not isinstance(v, bool)]
    return lookback([]) + 6 * max(digits, default=0)


def signal_columns(bars: DataFrame, variants: Sequence[Variant | str] | None = None, extra: Sequence[str] = (),
                   chunk_rows: int | None = None) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """Bars with one signal column per rule variant, plus ``extra`` feature columns; computed on full history."""
    plan = _plan(variants)
    numbered = bars if "bar_no" in bars.columns else number_bars(bars, KEYS, chunk_rows)
    rec = recursive_needs([r for s, p, _ in plan for r in (*s.recursive(p), *s.inputs(p))] + list(extra))
    f = Frame.of(numbered, rec, lookback=_context(plan), chunk_rows=chunk_rows)
    for e in extra:
        f.need(e)
    base = [c for c in ("symbol", "timeframe", "ts", "bar_no", "series_rows", "open", "high", "low", "close", "volume")
            if f.has(c)]
    meta, window_cols, machines, tables = [], [], [], []
    for i, (s, p, h) in enumerate(plan):
        col = f"sig_{i}"
        meta.append((col, s.name, h))
        if s.rule is not None:
            scoped = _Scoped(f, i)
            sig = to_signal(*s.rule(scoped, p))
            warm = s.warmup(p)
            if warm:
                sig = F.when((F.col("bar_no") < warm) & (F.col("series_rows") > warm), 0).otherwise(sig).cast("int")
            f.put(**{col: sig})
            window_cols.append(col)
        elif s.events is not None:
            tables.append((col, *s.events(_Scoped(f, i), p)))
        else:
            for n in s.inputs(p):
                f.need(n)
            machines.append((col, s.kernel(p), tuple(s.inputs(p))))
    keep = base + list(dict.fromkeys(extra)) + window_cols
    events = _event_tables(f, tables)
    if not machines:
        return _with_events(own_rows(f.df).select(*[f"`{c}`" for c in keep]), events), meta
    inputs = sorted({n for _, _, ins in machines for n in ins} - set(keep))
    slim = f.df.select(*[f"`{c}`" for c in keep], *[f"`{c}`" for c in inputs], "_chunk", "_own")

    def step(p: pd.DataFrame, first: int, last: int, state):
        outs, after = {}, []
        for j, (col, run, _) in enumerate(machines):
            out, st = run(p, first, last, state[j] if state else None)
            outs[col] = out["signal"].to_numpy()
            after.append(st)
        return pd.DataFrame(outs, index=range(last - first)).astype("int32"), after

    fields = [T.StructField(col, T.IntegerType()) for col, _, _ in machines]
    return _with_events(chunk_scan(slim, step, fields, keep, KEYS), events), meta


def _event_tables(f: Frame, tables) -> list[tuple[str, DataFrame]]:
    """Signals of the rules that are tables, over bars written once."""
    if not tables:
        return []
    cols = dict.fromkeys([*KEYS, "bar_no", "open", "high", "low", "close", *(c for _, used, _ in tables for c in used)])
    bars = cut_lineage(own_rows(f.df).select(*[f"`{c}`" for c in cols]))
    return [(col, run(bars)) for col, _, run in tables]


def _with_events(bars: DataFrame, events: list[tuple[str, DataFrame]]) -> DataFrame:
    for col, found in events:
        met = bars.join(found.select(*KEYS, "bar_no", F.col("signal").alias(col)), [*KEYS, "bar_no"], "left")
        bars = met.withColumn(col, F.coalesce(F.col(col), F.lit(0)).cast("int"))
    return bars


class _Scoped:
    """Gives each rule variant private helper columns while features stay shared."""

    def __init__(self, frame: Frame, i: int):
        self._f, self._i = frame, i

    def own_name(self, name: str) -> str:
        return f"_{name}_v{self._i}"

    def __getattr__(self, name):
        return getattr(self._f, name)


def signals(bars: DataFrame, variants: Sequence[Variant | str] | None = None, active_only: bool = False,
            chunk_rows: int | None = None) -> DataFrame:
    """Long table (symbol, timeframe, ts, bar_no, strategy_name, param_hash, signal)."""
    wide, meta = signal_columns(bars, variants, chunk_rows=chunk_rows)
    rows = F.array(*[F.struct(F.lit(n).alias("strategy_name"), F.lit(h).alias("param_hash"), F.col(c).alias("signal"))
                     for c, n, h in meta])
    if active_only:
        rows = F.filter(rows, lambda r: r["signal"] != 0)
    return wide.select("symbol", "timeframe", "ts", "bar_no", F.explode(rows).alias("r")).select(
        "symbol", "timeframe", "ts", "bar_no", "r.*")
