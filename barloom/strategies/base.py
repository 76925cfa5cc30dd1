"""Strategy records, the registry and the signal contract."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

TREND, REVERSION, BREAKOUT = "trend_following", "mean_reversion", "breakout_momentum"

# The stop and target multiples every rule is tuned over.
SL_GRID = [1.5, 2.0, 2.5, 3.0]
TP_GRID = [1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 5.5, 6.0]

# Retired names and the rule that replaces them.
RETIRED = {
    "VWAPDeviationReversionStrategy": "ZScoreVWAPReversionStrategy",
    "VWAPDeviationReversalStrategy": "ZScoreVWAPReversionStrategy",
}


@dataclass(frozen=True)
class Strategy:
    """A named rule: ``rule(frame, params)`` gives (long, short) conditions, ``kernel`` a stateful pass,
    or ``events(frame, params)`` the columns it needs and a function from bars to a table of signals (keys, bar_no, signal)."""

    name: str
    category: str
    defaults: dict
    grid: dict
    rule: Callable | None = None
    kernel: Callable | None = None
    events: Callable | None = None
    recursive: Callable[[dict], Sequence[str]] = lambda p: ()
    inputs: Callable[[dict], Sequence[str]] = lambda p: ()
    warmup: Callable[[dict], int] = lambda p: 0

    def params(self, **override) -> dict:
        return {**self.defaults, **override}

    def full_grid(self) -> dict:
        return {**self.grid, "sl_atr_mult": SL_GRID, "tp_atr_mult": TP_GRID}


_REGISTRY: dict[str, Strategy] = {}


def register(strategy: Strategy) -> Strategy:
    """Add a rule, built in or user supplied, under its name."""
    _REGISTRY[strategy.name] = strategy
    return strategy


def get(name: str) -> Strategy:
    name = name if name in _REGISTRY else RETIRED.get(name, name)
    if name not in _REGISTRY:
        raise ValueError(f"unknown strategy: {name}")
    return _REGISTRY[name]


def names(category: str | None = None) -> list[str]:
    return [n for n, s in _REGISTRY.items() if category is None or s.category == category]


def count() -> int:
    return len(_REGISTRY)


def params_json(params: dict) -> str:
    return json.dumps(params, sort_keys=True, default=str)


def param_hash(params: dict) -> str:
    return hashlib.sha256(params_json(params).encode()).hexdigest()[:16]


def yes(cond: Column) -> Column:
    """A condition on missing values is false."""
    return F.coalesce(cond, F.lit(False))


def to_signal(long: Column, short: Column) -> Column:
    """-1, 0 or 1; the short side wins when both fire."""
    return F.when(yes(short), -1).when(yes(long), 1).otherwise(0).cast("int")


def clean_signal(raw: Column) -> Column:
    """Signal contract for outside input: missing or unreadable is flat, the rest is clipped and truncated."""
    value = F.coalesce(raw.try_cast("double"), F.lit(0.0))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.nanvl(value, F.lit(0.0)))).cast("int")


def crosses_up(f, a: str, b: str) -> Column:
    return (f.need(a) > f.need(b)) & (f.lag(a) <= f.lag(b))


def crosses_down(f, a: str, b: str) -> Column:
    return (f.need(a) < f.need(b)) & (f.lag(a) >= f.lag(b))


def rises_over(f, a: str, level) -> Column:
    return (f.need(a) > level) & (f.lag(a) <= level)


def falls_under(f, a: str, level) -> Column:
    return (f.need(a) < level) & (f.lag(a) >= level)
