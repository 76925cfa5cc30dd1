"""Scores over metric columns.  Every function takes a mapping of metric name to Column and returns a Column."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions.rounding import rnd

M = Mapping[str, Column]


@dataclass(frozen=True)
class Config:
    """Default capital, cost, split, criteria and scoring settings."""

    initial_capital: float = 10000.0
    position_size_pct: float = 1.0
    slippage_pips: float = 0.5
    use_spread: bool = True
    use_commission: bool = True
    use_slippage: bool = True
    min_trades: int = 25
    min_robustness: float = 0.20
    min_win_rate: float = 40.0
    min_profit_factor: float = 1.1
    min_sharpe: float = 0.5
    max_drawdown: float = 18.0
    opt_min_trades: int = 15
    val_min_trades: int = 15
    val_max_drawdown: float = 18.0
    val_sharpe_override: float = 0.3
    selection_top_k: int = 5
    opt_top_k: int = 5
    gap_penalty: float = 0.70
    robustness_boost: float = 0.15
    min_robustness_ratio: float = 0.80
    regime_min_train_trades: int = 25
    regime_min_val_trades: int = 15
    regime_top_k: int = 3
    max_param_combos: int = 150
    min_val_profit_factor: float = 1.05
    min_val_return_pct: float = 5.0
    min_val_return_dd: float = 1.0
    validation_top_k: int = 5
    train_min_profit_factor: float = 0.75
    train_min_return_pct: float = -20.0
    train_max_drawdown: float = 25.0
    exceptional_val_profit_factor: float = 1.50
    exceptional_val_return_pct: float = 10.0
    use_sortino_blend: bool = True
    use_continuous_dd: bool = True
    use_tail_risk: bool = True
    use_consistency: bool = True
    use_trade_frequency: bool = True


DEFAULT = Config()
# Weights of the composite score.
WEIGHTS = {"sharpe": 0.25, "profit_factor": 0.20, "win_rate": 0.15, "total_return": 0.15, "max_drawdown": 0.15,
           "trade_count": 0.10}


def clip(x: Column, lo, hi) -> Column:
    return F.least(F.lit(float(hi)), F.greatest(F.lit(float(lo)), x))


def finite(x: Column, fallback: float) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), fallback).otherwise(x)


def return_dd(ret: Column, dd: Column, eps: float = 0.5) -> Column:
    """Return over drawdown with a floor on the drawdown; ``eps=0`` is the plain ratio (0 without drawdown)."""
    if eps == 0:
        return F.when(dd > 0, ret / dd).otherwise(0.0)
    return ret / F.greatest(dd, F.lit(float(eps)))


def rho(train_pf: Column, val_pf: Column, train_ret: Column, val_ret: Column, cap: float | None = None) -> Column:
    """Robustness: profit-factor ratio shrunk by the train/validation return gap."""
    x = val_pf / (train_pf + 0.1) * (1 / (1 + 0.05 * F.abs(train_ret - val_ret)))
    return x if cap is None else clip(x, 0, cap)


def normalise(score: Column) -> Column:
    """Score to 0..1."""
    return 1 / (1 + F.exp(-(score - 45) / 30))


def composite(m: M, cfg: Config = DEFAULT) -> Column:
    parts = {
        "sharpe": clip(m["sharpe_ratio"] / 2.0 * 100, 0, 100),
        "profit_factor": clip((m["profit_factor"] - 1.0) / 2.0 * 100, 0, 100),
        "win_rate": clip((m["win_rate"] - 40) / 30 * 100, 0, 100),
        "total_return": clip(m["total_return_pct"], 0, 100),
        "max_drawdown": F.greatest(F.lit(0.0), 100 - m["max_drawdown_pct"] / 30 * 100),
        "trade_count": clip((m["total_trades"] - 20) / 80 * 100, 0, 100),
    }
    total = sum((parts[k] * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return F.when(m["total_trades"] < cfg.min_trades, 0.0).otherwise(rnd(total, 2))


def _risk_adjusted(m: M, cfg: Config) -> Column:
    sharpe = clip(m["sharpe_ratio"], -2, 5)
    return 0.6 * sharpe + 0.4 * clip(m["sortino_ratio"], -2, 5) if cfg.use_sortino_blend else sharpe


def selection(m: M, cfg: Config = DEFAULT) -> Column:
    ret, dd = m["total_return_pct"], m["max_drawdown_pct"]
    eff = clip(F.when(dd > 0, ret / dd).otherwise(ret), -5, 20)
    s = ((_risk_adjusted(m, cfg) + 2.0) / 7.0 * 25.0 + clip(m["profit_factor"], 0, 10) / 10.0 * 20.0
         + m["win_rate"] / 100.0 * 15.0 + (eff + 5.0) / 25.0 * 25.0
         + F.least(m["expectancy_pips"] / 10.0, F.lit(1.0)) * 15.0)
    if cfg.use_continuous_dd:
        s = s * F.exp(-0.03 * dd)
    else:
        s = s * F.when(dd > 30, 0.6).when(dd > 25, 0.75).when(dd > 20, 0.9).otherwise(1.0)
    if cfg.use_tail_risk:
        tail = m["worst_5pct_r"]
        s = s * F.when(tail < -3.0, F.greatest(F.lit(0.70), 1.0 + 0.05 * tail)).otherwise(1.0)
    if cfg.use_consistency:
        run = m["max_consecutive_losses"]
        s = s * F.when(run > 8, F.greatest(F.lit(0.75), 1.0 - 0.03 * (run - 8))).otherwise(1.0)
    if cfg.use_trade_frequency:
        n = m["total_trades"]
        s = s * F.when(n > 30, 1.0 + F.least(F.lit(0.08), 0.03 * F.log(n / 30.0))).otherwise(1.0)
    return s


def optimisation(m: M, cfg: Config = DEFAULT) -> Column:
    dd = m["max_drawdown_pct"]
    base = (_risk_adjusted(m, cfg) * 30.0 + F.least(m["total_return_pct"], F.lit(500.0)) * 0.1
            + clip(m["profit_factor"], 0, 5) * 2.0 + m["win_rate"] / 100.0 * 5.0)
    if cfg.use_continuous_dd:
        return base * F.exp(-0.03 * dd)
    return base * F.when(dd < 15, 1.0).when(dd < 25, 0.8).otherwise(0.5)


def score(m: M, mode: str = "calibrated", purpose: str = "selection", cfg: Config = DEFAULT) -> Column:
    if mode != "calibrated":
        return composite(m, cfg)
    return optimisation(m, cfg) if purpose == "opt" else selection(m, cfg)


def ratio(train: Column, val: Column, eps: float = 1e-9) -> Column:
    """Validation score over train score, clipped to [0, 2]."""
    return clip(val / F.when(F.abs(train) > eps, train).otherwise(eps), 0, 2)


def generalise(t: Column, v: Column, cfg: Config = DEFAULT, t_sel: Column | None = None, v_sel: Column | None = None) -> Column:
    """Validation score less the train gap, times the robustness boost; ``*_sel`` are selection scores if others are given."""
    rr = clip(ratio(t if t_sel is None else t_sel, v if v_sel is None else v_sel), 0, 1.25)
    b = cfg.robustness_boost
    return (v - cfg.gap_penalty * F.greatest(F.lit(0.0), t - v)) * ((1 - b) + b * rr)


def generalisation(train: M, val: M, purpose: str = "selection", cfg: Config = DEFAULT) -> Column:
    t, v = score(train, purpose=purpose, cfg=cfg), score(val, purpose=purpose, cfg=cfg)
    if purpose == "selection":
        return generalise(t, v, cfg)
    return generalise(t, v, cfg, score(train, cfg=cfg), score(val, cfg=cfg))


def sharpe_robustness(train_sharpe: Column, val_sharpe: Column) -> Column:
    return F.when(train_sharpe <= 0, 0.0).otherwise(rnd(F.least(val_sharpe / train_sharpe, F.lit(2.0)), 3))


def minimum_criteria(m: M, cfg: Config = DEFAULT) -> Column:
    """First criterion that fails, or OK."""
    return (F.when(m["total_trades"] < cfg.min_trades, "few_trades")
            .when(m["win_rate"] < cfg.min_win_rate, "Low win rate")
            .when(m["profit_factor"] < cfg.min_profit_factor, "Low profit factor")
            .when(m["sharpe_ratio"] < cfg.min_sharpe, "Low Sharpe ratio")
            .when(m["max_drawdown_pct"] > cfg.max_drawdown, "deep_drawdown").otherwise("OK"))


def training_eligibility(m: M, cfg: Config = DEFAULT) -> Column:
    """First catastrophic training result, or null."""
    return (F.when(m["profit_factor"] < cfg.train_min_profit_factor, "train PF")
            .when(m["total_return_pct"] < cfg.train_min_return_pct, "train return")
            .when(m["max_drawdown_pct"] > cfg.train_max_drawdown, "train DD"))


def bucket_to_full(prefix: str = "") -> dict[str, Column]:
    """Bucket metric columns as full-metric names; an absent bucket counts as drawdown 100 and zero elsewhere."""
    c = lambda n, d=0.0: F.coalesce(F.col(f"{prefix}{n}"), F.lit(d))
    wr = c("win_rate")
    return {
        "total_trades": c("total_trades"), "win_rate": wr, "profit_factor": c("profit_factor"),
        "total_return_pct": c("total_return_pct"), "sharpe_ratio": c("sharpe_approx"),
        "max_drawdown_pct": c("max_drawdown_pct", 100.0), "gross_profit": c("gross_profit"),
        "gross_loss": c("gross_loss"), "total_pnl": c("total_pnl"),
        "expectancy_pips": c("avg_win") * wr / 100 - c("avg_loss") * (1 - wr / 100),
        "sortino_ratio": c("sortino_approx"), "calmar_ratio": c("calmar_ratio"), "mean_r": c("mean_r"),
        "worst_5pct_r": c("worst_5pct_r"), "max_consecutive_losses": c("max_consecutive_losses"),
    }


def stability(train_trades: Column, val_trades: Column, cfg: Config = DEFAULT) -> Column:
    part = lambda n, need: F.least(F.lit(1.0), F.log1p(n.cast("double")) / math.log1p(need * 2))
    s = 0.3 * part(train_trades, cfg.regime_min_train_trades) + 0.7 * part(val_trades, cfg.regime_min_val_trades)
    return 0.7 + 0.3 * s


def regime_score(t: Column, v: Column, train_trades: Column, val_trades: Column, cfg: Config = DEFAULT) -> Column:
    """Preset-independent quality of a candidate in one regime, from its selection scores and trade counts."""
    stable = stability(train_trades, val_trades, cfg)
    return F.when(val_trades >= cfg.regime_min_val_trades, generalise(t, v, cfg) * stable).otherwise(t * 0.7 * stable)


def regime_score_legacy(train: M, val: M, cfg: Config = DEFAULT) -> Column:
    enough = val["total_trades"] >= cfg.regime_min_val_trades
    pick = lambda k: F.when(enough, val[k]).otherwise(train[k])
    robust = F.when(enough, F.when(train["profit_factor"] > 0,
                                   F.least(F.lit(1.0), val["profit_factor"] / (train["profit_factor"] + 0.1))).otherwise(0.5)
                    ).otherwise(0.7)
    s = (F.least(pick("profit_factor"), F.lit(5.0)) * 20 + pick("win_rate") / 100 * 30
         + clip(pick("sharpe_ratio"), -2, 3) * 15 + F.least(pick("total_pnl") / 50, F.lit(20.0)) + robust * 20)
    return F.when(pick("total_trades") == 0, float("-inf")).otherwise(
        s * stability(train["total_trades"], val["total_trades"], cfg))
