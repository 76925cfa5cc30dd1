"""Registered queries over the sales ledger: evidence, gates, winners and preset comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import stats
from barloom.functions.rounding import rnd
from barloom.operators import analysis as an
from barloom.operators import buckets as bk
from barloom.operators import gates as gt
from barloom.plans import evidence as ev
from barloom.sources.adapters import sales_ledger

C = F.col
OTHERS = [p for p in gt.PRESETS if p != "all_gates"]


def _scores6(df):
    return df.withColumns({c: rnd(C(c), 6) for c in ("train_score", "val_score", "quality_score") if c in df.columns})


def _led(s, d):
    return ev.sales_rejections(s, d)


def _gate_check(s, d):
    x = gt.check_gates(gt.rank_candidates(ev.sales_candidates(s, d), None), gt.all_presets(True))
    return x.select("preset", *gt.SLOT, "strategy_name", "rank", F.array_join("failed_gates", ",").alias("failed"), "passed")


def _rejections(s, d):
    return _led(s, d).select("preset", *gt.SLOT, "candidate_count", "candidates_considered", F.size("rejections").alias("rejections"),
                             F.array_join("binding_gates", ",").alias("binding_gates"), "outcome", "reason",
                             C("winner.rank").alias("winner_rank"))


BLOCKED = ("acceptance_pct", "median_rho", "far_pct")


def _blocks(s, d):
    return stats.dense_blocks(an.symbol_aggregates(_led(s, d)), "symbol", "preset", BLOCKED, list(gt.PRESETS))


def _blocked_wilcoxon(s, d):
    x = stats.blocked_wilcoxon(_blocks(s, d), "symbol", "preset", "all_gates", p_values=False)
    return x.withColumns({c: rnd(C(c), 9) for c in ("p_value", "bonferroni_p")})


QUERIES = {
    "symbol_blocked_friedman": lambda s, d: stats.blocked_friedman(_blocks(s, d), "symbol", "preset", False).drop("note"),
    "symbol_blocked_wilcoxon": _blocked_wilcoxon,
    "sales_ledger": lambda s, d: sales_ledger(s, d).drop("ts", "l_suppkey"),
    "bucket_metrics": lambda s, d: bk.bucket_metrics(bk.split_trades(sales_ledger(s, d)), [*bk.CAND, "regime", "split"]),
    "candidate_evidence": lambda s, d: _scores6(ev.sales_candidates(s, d)),
    "gate_check": _gate_check,
    "rejection_ledger": _rejections,
    "winners": lambda s, d: _scores6(gt.winners(_led(s, d))),
    "fill_totals": lambda s, d: gt.fill_totals(_led(s, d)),
    "fill_rates": lambda s, d: an.fill_rates(_led(s, d)),
    "convergence": lambda s, d: an.convergence(gt.winners(_led(s, d))),
    "binding_gates": lambda s, d: an.binding_gates(_led(s, d)),
    "quality_by_regime": lambda s, d: an.quality_by_regime(gt.winners(_led(s, d))),
    "headline": lambda s, d: an.headline(_led(s, d)),
    "symbol_aggregates": lambda s, d: an.symbol_aggregates(_led(s, d)),
    "far_sensitivity": lambda s, d: an.far_sensitivity(gt.winners(_led(s, d))),
    "gate_overlap": lambda s, d: an.gate_overlap(_led(s, d), "all_gates", "G2", "G5"),
    "mcnemar": lambda s, d: stats.mcnemar(_led(s, d), "all_gates", OTHERS, list(gt.SLOT)),
    "cohens_d": lambda s, d: stats.cohens_d(_led(s, d), "all_gates", OTHERS, list(gt.SLOT)),
}
