"""Registered queries over scores, validation, selection, sweeps and replicated studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import scoring as sc
from barloom.functions import stats
from barloom.functions.rounding import rnd
from barloom.operators import buckets as bk
from barloom.operators import gates as gt
from barloom.operators import ledger as lg
from barloom.operators import regime as rg
from barloom.operators import selection as sel
from barloom.plans import evidence as ev
from barloom.plans.ledger_queries import TIGHT, VARIANTS, event_specs
from barloom.series import number_bars
from barloom.session import cut_lineage
from barloom.sources.adapters import event_bars, sales_ledger

C = F.col
OTHERS = [p for p in gt.PRESETS if p != "all_gates"]
RULE = ("symbol", "timeframe", "strategy_name", "param_hash")
# Looser criteria that fit the small sales ledger; the defaults are for years of bars.
SMALL = sc.Config(regime_min_train_trades=8, regime_min_val_trades=3, min_trades=15, val_min_trades=8, opt_min_trades=10, val_max_drawdown=40.0,
                  min_val_profit_factor=0.9, min_val_return_pct=-5.0, min_val_return_dd=-0.2, min_win_rate=30.0, min_profit_factor=0.8,
                  min_sharpe=-1.0, max_drawdown=60.0, train_min_profit_factor=0.9, train_min_return_pct=-5.0, train_max_drawdown=30.0)


def rule_metrics(s, d, ledger=None):
    return bk.bucket_metrics(bk.split_trades(sales_ledger(s, d) if ledger is None else ledger), [*RULE, "split"])


def regime_metrics(s, d, ledger=None):
    return bk.bucket_metrics(bk.split_trades(sales_ledger(s, d) if ledger is None else ledger), [*RULE, "regime", "split"])


def rule_pairs(s, d, ledger=None):
    x = sel.sides(rule_metrics(s, d, ledger), RULE)
    return sel.pair_scores(x.filter(C("train_total_trades") > 0), SMALL)


def regime_pairs(s, d, ledger=None):
    x = sel.sides(regime_metrics(s, d, ledger), [*RULE, "regime"])
    return sel.pair_scores(x.filter(C("train_total_trades") > 0), SMALL)


def _r6(df, *cols):
    return df.withColumns({c: rnd(C(c), 6) for c in cols})


def _score_table(s, d):
    x = sel.score_columns(rule_metrics(s, d), SMALL)
    return _r6(x.select("symbol", "timeframe", "strategy_name", "split", "composite", "selection", "optimisation", "criteria", "ineligible",
                        sc.normalise(C("selection")).alias("normalised")), "composite", "selection", "optimisation", "normalised")


def _pair_table(s, d):
    cols = ["score_ratio", "general", "general_opt", "sharpe_ratio", "legacy_score", "regime_score", "blended"]
    x = rule_pairs(s, d)
    x = sel.stage_validator(x, SMALL).withColumn("blended", sel.blended(x, SMALL))
    return _r6(x.select("symbol", "timeframe", "strategy_name", *cols, "stage_fx", "stage_legacy"), *cols)


def _rho(s, d):
    x = rule_pairs(s, d)
    v = sc.rho(C("train_profit_factor"), C("val_profit_factor"), C("train_total_return_pct"), C("val_total_return_pct"))
    eff = {f"return_dd_{str(e).replace('.', 'p')}": sc.return_dd(C("val_total_return_pct"), C("val_max_drawdown_pct"), e) for e in (0.5, 0.01, 0)}
    x = x.select("symbol", "timeframe", "strategy_name", v.alias("rho"), *[c.alias(n) for n, c in eff.items()])
    return _r6(x.withColumn("far", C("rho") < 0.5), "rho", *eff)


def _chain(s, d):
    x = regime_pairs(s, d).withColumns({"dropped": sel.gate_chain(SMALL), "invalid": sel.winner_validation(SMALL)})
    return x.select("symbol", "timeframe", "regime", "strategy_name", "dropped", "invalid")


def _descent(s, d):
    x = sel.descend(regime_pairs(s, d), SMALL)
    x = x.withColumn("live_ok", sel.live_quality(x, 0.9, -5.0, 40.0, -0.2))
    return _r6(x.select("symbol", "timeframe", "regime", "strategy_name", "rank", "regime_score", "why", "is_validated", "tried", "quality", "live_ok"),
               "regime_score", "quality")


def _default_config(s, d):
    x = sel.default_config(sel.descend(regime_pairs(s, d), SMALL))
    return _r6(x.select("symbol", "quality"), "quality")


def _top(s, d):
    x = sel.top_per_regime(regime_pairs(s, d), 3, SMALL)
    return _r6(x.select("symbol", "timeframe", "regime", "strategy_name", "rank", "regime_score"), "regime_score")


def _best(purpose):
    def run(s, d):
        x = sel.select_best(rule_pairs(s, d), ("symbol",), purpose, SMALL)
        return _r6(x.drop("param_hash"), "train_rank_score", "final_score")
    return run


def _legacy(s, d):
    return _r6(sel.select_legacy(rule_pairs(s, d), ("symbol",), SMALL), "combined")


def _collect(s, d):
    """Eligible screened rules together with tuned ones (here the sales rules of the tuning slots)."""
    # both metric tables read the ledger: number it once
    ledger = cut_lineage(sales_ledger(s, d).select(*RULE, "regime", "entry_bar", "slot_trades", "pnl_dollars", "r_multiple"))
    x = rule_pairs(s, d, ledger)
    ok = x.filter(sc.training_eligibility(sc.bucket_to_full("train_"), SMALL).isNull())
    tuned = sel.top_per_regime(regime_pairs(s, d, ledger), 1, SMALL).select("symbol", "timeframe", "strategy_name").distinct()
    base = ok.select("symbol", "timeframe", "strategy_name", F.lit(False).alias("is_tuned"))
    return base.unionByName(tuned.withColumn("is_tuned", F.lit(True)))


def _early(s, d):
    """Rejection outcome of each rule as a member of a sweep ranked by rule hash."""
    from pyspark.sql import Window
    w = Window.partitionBy("symbol", "timeframe")
    x = rule_pairs(s, d).withColumns({"k": F.row_number().over(w.orderBy("param_hash")) - 1, "n": F.count(F.lit(1)).over(w)})
    x = x.withColumn("outcome", sel.early_rejection(x, C("k"), C("n"), sc.Config(regime_min_train_trades=60, val_max_drawdown=8.0)))
    return sel.sweep_outcomes(x)


def sweep(s, d, strategy="DonchianBreakoutStrategy"):
    """Parameter sweep on event bars: ledger of every set of the grid, bucketed by regime, best set per slot.

    Stops and targets are a quarter of the grid's, as in ``TIGHT``.
    """
    variants = [(n, {**p, **{k: p[k] / 4 for k in TIGHT}}) for n, p in sel.grid_params(s, strategy)]
    bars = event_bars(s, d)
    t = lg.ledger(bars, variants, event_specs(bars))
    b = bk.bucket_by_regime(t, rg.regimes(bars))
    m = bk.bucket_metrics(b, [*RULE, "regime", "split"])
    pairs = sel.pair_scores(sel.sides(m, [*RULE, "regime"]).filter(C("train_total_trades") > 0), SMALL)
    return sel.best_per_regime(pairs, cfg=SMALL, min_trades=3)


def _sweep(s, d):
    return _r6(sweep(s, d).drop("timeframe"), "score")


def _default_params(s, d):
    """Rules without a sweep get their default set evaluated."""
    bars = event_bars(s, d)
    t = lg.ledger(bars, [n for n, _ in VARIANTS], event_specs(bars))
    return lg.full_metrics(t, lg.bar_seconds(number_bars(bars))).select("symbol", "split", "strategy_name", *lg.FULL)


def _grid(s, d):
    """Every legal parameter set of a rule met with the rules of the sales ledger: how many sets each brand would sweep."""
    p = sel.repair_params(sel.param_table(s, "EMACrossoverStrategy"), {"slow_period": [20, 26, 30, 40, 50]})
    g = p.agg(F.count(F.lit(1)).alias("sets"), F.count_distinct("params_json").alias("distinct_sets"),
              F.sum((C("slow_period") > C("fast_period")).cast("int")).alias("legal"))
    brands = s.read.parquet(f"{d}/part.parquet").groupBy(C("p_brand").alias("strategy_name")).agg(F.count(F.lit(1)).alias("parts"))
    return brands.join(F.broadcast(g))  # one row


def _constraints(s, d):
    """Repair of illegal period pairs; the pairs come from part sizes."""
    x = s.read.parquet(f"{d}/part.parquet").select("p_partkey", C("p_size").alias("fast_period"), F.lit(26).alias("slow_period"),
                                                   (C("p_size") % 30 + 1).alias("signal_period"), F.lit(14).alias("k_period"), C("p_size").alias("d_period"))
    return sel.repair_params(x, {"slow_period": [20, 26, 30, 40, 50], "signal_period": [3, 7, 9, 12]})


#: Windows with fewer trades say nothing about a period.
WALK = sc.Config(min_trades=3)


def _window_scores(s, d):
    bars = event_bars(s, d)
    return _r6(sel.walk_scores(bars, ("EMACrossoverStrategy", TIGHT), event_specs(bars)).drop("timeframe"), "score")


def _walk(s, d):
    """Retrain period per symbol from the scores of its test windows."""
    bars = event_bars(s, d)
    scores = sel.walk_scores(bars, ("EMACrossoverStrategy", TIGHT), event_specs(bars)).filter(C("total_trades") >= WALK.min_trades)
    best = sel.choose_period(scores)
    return bars.select("symbol").distinct().join(best.drop("timeframe"), "symbol", "left").select(
        "symbol", F.coalesce("period_days", F.lit(30)).alias("period_days"), rnd("consistency", 4).alias("consistency"), "windows")


def _configs(s, d):
    """Stored configuration per supplier, made from its account balance and key."""
    sup = s.read.parquet(f"{d}/supplier.parquet")
    until = F.date_add(F.lit("2024-01-01").cast("date"), (C("s_suppkey") % 60).cast("int")).cast("timestamp")
    return sup.filter(C("s_suppkey") % 7 != 0).select(
        C("s_name").alias("symbol"), (C("s_acctbal") > 2000).alias("is_validated"),
        F.when(C("s_suppkey") % 11 != 0, until).alias("valid_until"), F.when(C("s_nationkey") % 2 == 0, "v1").otherwise("v0").alias("stored_version"))




def _now():
    return F.lit("2024-01-31").cast("timestamp")


def _symbols(s, d):
    return s.read.parquet(f"{d}/supplier.parquet").select(C("s_name").alias("symbol"))


def _status(s, d):
    v = _symbols(s, d).withColumn("regime_version", F.lit("v1"))
    return sel.run_status(_symbols(s, d), _configs(s, d), _now(), v)


def _rows(s, d, m=0):
    sup = s.read.parquet(f"{d}/supplier.parquet")
    x = sup.filter(C("s_suppkey") % 5 != m)
    return x.select(C("s_name").alias("symbol"), (C("s_acctbal") > 1000 * (1 - m)).alias("success"), (C("s_acctbal") > 5000).alias("is_validated"),
                    (C("s_suppkey") % 4 + m).alias("regime_winners"))


def _repair(s, d):
    return sel.repair_symbols(_symbols(s, d), _rows(s, d), _configs(s, d))


def _merge(s, d):
    return sel.merge_rows(_symbols(s, d), _rows(s, d), _rows(s, d, 1).join(_repair(s, d), "symbol", "left_semi"))


def _version(s, d):
    series = event_bars(s, d).select("symbol").distinct().select("symbol", F.explode(F.array(F.lit("H1"), F.lit("H4"))).alias("timeframe"))
    over = s.createDataFrame([("view", "H1", 4, 0.2, 6)], "symbol string, timeframe string, k_confirm int, gap_min double, k_hold int")
    a, b = rg.params_version(series), rg.params_version(series, over).withColumnRenamed("regime_version", "now")
    return a.join(b, "symbol").select("symbol", (C("now") != C("regime_version")).alias("changed"))


# ---- replicated studies ----------------------------------------------------------------------------------------------
SUM_COLS = ("mean_robustness", "median_robustness", "robustness_q25", "robustness_q75", "robustness_min", "robustness_max", "median_val_return_pct",
            "median_val_drawdown_pct", "median_val_pf", "median_val_return_dd", "acceptance_rate_pct", "false_acceptance_rate_pct")
TEST_METRICS = ("acceptance_rate_pct", "median_robustness", "false_acceptance_rate_pct", "median_val_return_pct", "median_val_return_dd")


def summary(s, d, profile="historical"):
    return gt.ablation_summary(ev.sales_pool(s, d), gt.all_presets(), profile)


def _summary(profile):
    return lambda s, d: summary(s, d, profile).withColumns({c: rnd(C(c), 4) for c in SUM_COLS})


def _pool(s, d):
    x = ev.sales_pool(s, d)
    return x.withColumns({c: rnd(C(c), 6) for c in ("val_return_dd_ratio", "robustness_ratio")})


def _distribution(s, d):
    return gt.distribution(summary(s, d), ["preset"], [*TEST_METRICS, "accepted", "G2_rejections", "G5_first"])


def _heatmap(s, d):
    """Rejections of the reference replication, gates across."""
    return summary(s, d).filter(C("replication_id") == 0).select("preset", *[f"{g}_rejections" for g in gt.GATES], *[f"{g}_first" for g in gt.GATES])


def _long(s, d):
    x = summary(s, d)
    stack = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), C(m).cast("double").alias("v")) for m in TEST_METRICS]))
    return x.select("replication_id", "preset", stack.alias("_m")).select("replication_id", "preset", "_m.*")


def _pairwise(form, p_values):
    def run(s, d):
        j = stats.pairs(_long(s, d), "all_gates", OTHERS, ["metric", "replication_id"], C("v"))
        j = j.withColumn("d", F.round(C("a") - C("b"), 9))
        return stats.wilcoxon(j, ["metric", "preset_b"], form, p_values)
    return run


def _bonferroni(s, d):
    return stats.bonferroni(_pairwise("simulation", True)(s, d), ["metric"]).drop("z")


def _friedman(tie, p_values=False):
    def run(s, d):
        x = _long(s, d).filter(C("metric").isin("median_robustness", "false_acceptance_rate_pct")).withColumn("v", F.round("v", 9))
        return stats.friedman(x, "replication_id", "preset", "v", ["metric"], tie, p_values)
    return run


def _compare(s, d):
    """The summary against a copy with one column nudged for some presets."""
    from barloom.operators.analysis import compare_tables
    a = gt.fill_totals(ev.sales_rejections(s, d)).select("preset", "filled_slots", (C("filled_slots") / C("total_slots")).alias("share"))
    b = a.filter(C("preset") != "minimal").withColumn("share", F.when(C("preset") == "no_gates", C("share") + 0.5).otherwise(C("share")))
    out = compare_tables(a, b, ["preset"])
    return out.select("preset", F.array_join("mismatched", ",").alias("mismatched"), "ok")


QUERIES = {
    "score_table": _score_table,
    "pair_scores": _pair_table,
    "robustness_and_efficiency": _rho,
    "winner_gate_chain": _chain,
    "winner_descent": _descent,
    "default_config": _default_config,
    "top_rules_per_regime": _top,
    "select_best_rule": _best("selection"),
    "select_best_params": _best("opt"),
    "select_legacy": _legacy,
    "collect_candidates": _collect,
    "early_rejection": _early,
    "parameter_sweep": _sweep,
    "default_parameters": _default_params,
    "parameter_grid": _grid,
    "parameter_constraints": _constraints,
    "walk_forward_period": _walk, "walk_window_scores": _window_scores,
    "run_status": _status,
    "ledger_stats": lambda s, d: sel.ledger_stats(_configs(s, d), _now()),
    "repair_symbols": _repair,
    "repair_merge": _merge,
    "run_summary": lambda s, d: sel.run_summary(_rows(s, d)),
    "successful_configs": lambda s, d: sel.keep_successful(_configs(s, d), _rows(s, d)).select("symbol", "is_validated"),
    "regime_version_change": _version,
    "candidate_pool": _pool,
    "ablation_summary": _summary("historical"),
    "ablation_summary_production": _summary("production"),
    "ablation_distribution": _distribution,
    "rejection_heatmap": _heatmap,
    "wilcoxon_simulation": _pairwise("simulation", False),
    "wilcoxon_library": _pairwise("library", False),
    "bonferroni": _bonferroni,
    "friedman_simulation": _friedman(False),
    "friedman_library": _friedman(True),
    "friedman_p_values": _friedman(False, True),
    "result_comparison": _compare,
}
