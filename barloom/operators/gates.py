"""Validation gates, presets and winner selection."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.rounding import rnd

from barloom.operators.buckets import REGIMES

GATES = ("G1", "G2", "G3", "G4", "G5", "G6", "G7")
# Long names, presets and default thresholds.
GATE_NAMES = {"G1": "G1_min_trades", "G2": "G2_max_drawdown", "G3": "G3_train_profitability", "G4": "G4_val_return",
              "G5": "G5_return_dd_ratio", "G6": "G6_val_profit_factor", "G7": "G7_robustness_gap"}
THRESHOLDS = {
    "historical": {"G1": 5, "G2": 20.0, "G3": 0.0, "G4": 5.0, "G5": 1.0, "G6": 1.0, "G7": 0.75},
    "production": {"G1": 15, "G2": 18.0, "G3": 0.0, "G4": 5.0, "G5": 1.0, "G6": 1.05, "G7": 0.80, "train_pf": 1.0,
                   "exceptional_pf": 1.15, "exceptional_return": 8.0, "sharpe_override": 0.30},
}
PRESETS = {
    "all_gates": GATES, "no_gates": (), "drawdown_only": ("G2",), "profitability_only": ("G3", "G6"),
    "minimal": ("G1", "G2"), "quality_focused": ("G2", "G5", "G6"), "robustness_focused": ("G1", "G5", "G7"),
}
DESCRIPTIONS = {
    "all_gates": "every gate on, the yardstick of all comparisons",
    "no_gates": "every gate off, the lower end of all comparisons",
    "drawdown_only": "depth of loss alone",
    "profitability_only": "profit alone, in training and in validation",
    "minimal": "enough trades and a bounded loss",
    "quality_focused": "bounded loss, return earned per loss, profit factor",
    "robustness_focused": "enough trades, return earned per loss, score kept out of sample",
}
SINGLE = {f"single_{g.lower()}": (g,) for g in GATES}
TOP = 20
SLOT = ("symbol", "timeframe", "regime")


@dataclass(frozen=True)
class Preset:
    name: str
    gates: tuple[str, ...]
    thresholds: Mapping[str, float] = field(default_factory=dict)

    def threshold(self, gate: str, profile: str = "historical") -> float:
        return self.thresholds.get(gate, THRESHOLDS[profile].get(gate, 0.0))


def preset(name: str) -> Preset:
    known = {**PRESETS, **SINGLE}
    if name not in known:
        raise ValueError(f"unknown gate configuration: {name}")
    return Preset(name, tuple(known[name]))


def all_presets(single: bool = False) -> list[Preset]:
    return [preset(n) for n in (*PRESETS, *(SINGLE if single else ()))]


def preset_table(spark: SparkSession, presets: Sequence[Preset], profile: str = "historical") -> DataFrame:
    """One row per preset: flags, thresholds, active ids, names and summary text."""
    rows = [(p.name, DESCRIPTIONS.get(p.name, ", ".join(p.gates)), *[g in p.gates for g in GATES],
             *[float(p.threshold(g, profile)) for g in GATES], list(p.gates), [GATE_NAMES.get(g, g) for g in p.gates],
             len(p.gates), ", ".join(p.gates) or "none") for p in presets]
    schema = ("preset string, description string, " + ", ".join(f"{g.lower()} boolean" for g in GATES) + ", "
              + ", ".join(f"{g.lower()}_threshold double" for g in GATES)
              + ", gates_applied array<string>, gate_names array<string>, gate_count int, active_gates string")
    return spark.createDataFrame(rows, schema)


# A gate is a predicate that is true when the candidate fails: (columns, threshold) -> Column.
Gate = Callable[[Mapping[str, Column], Column], Column]

# Column names of candidate evidence and of replicated pools.
EVIDENCE = {k: k for k in ("val_trades", "val_dd", "train_dd", "train_return", "train_pf", "val_return", "val_pf",
                           "val_sharpe", "val_win_rate")}
POOL = {"val_trades": "val_trades", "val_dd": "val_drawdown_pct", "train_dd": "train_drawdown_pct",
        "train_return": "train_return_pct", "train_pf": "train_profit_factor", "val_return": "val_return_pct",
        "val_pf": "val_profit_factor", "val_sharpe": "val_sharpe", "val_win_rate": "val_win_rate"}


def _evidence_ratio(m: Mapping[str, Column]) -> Column:
    return m["val_return"] / F.greatest(m["val_dd"], F.lit(0.01))


def _score_ratio(m: Mapping[str, Column]) -> Column:
    return F.when(m["train_score"] > 0.001, m["val_score"] / m["train_score"]).otherwise(0.0)


_GATES: dict[str, Gate] = {
    "G1": lambda m, t: m["val_trades"] < t,
    "G2": lambda m, t: m["val_dd"] >= t,
    "G3": lambda m, t: m["train_return"] < t,
    "G4": lambda m, t: m["val_return"] < t,
    "G5": lambda m, t: m["return_dd"] < t,
    "G6": lambda m, t: m["val_pf"] < t,
    "G7": lambda m, t: m["robustness"] < t,
}


def register_gate(gate_id: str, fails: Gate) -> None:
    """Add a user gate; presets name it like the built-in ones."""
    _GATES[gate_id] = fails


def evidence_columns() -> dict[str, Column]:
    m = {k: F.col(v) for k, v in EVIDENCE.items()}
    m |= {"train_score": F.col("train_score"), "val_score": F.col("val_score")}
    return m | {"return_dd": _evidence_ratio(m), "robustness": _score_ratio(m)}


def pool_columns() -> dict[str, Column]:
    m = {k: F.col(v) for k, v in POOL.items()}
    return m | {"return_dd": F.col("val_return_dd_ratio"), "robustness": F.col("robustness_ratio")}


def fails(gate: str, m: Mapping[str, Column], threshold: Column) -> Column:
    """A missing metric does not fail a gate."""
    return F.coalesce(_GATES[gate](m, threshold), F.lit(False))


def failed_gates(p: Preset, m: Mapping[str, Column], profile: str = "historical") -> Column:
    hits = [F.when(fails(g, m, F.lit(p.threshold(g, profile))), g) for g in p.gates]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def failed_production(p: Preset, m: Mapping[str, Column]) -> Column:
    """Production profile: drawdown can count twice, weak training may be excused, Sharpe can override G7."""
    t = {**THRESHOLDS["production"], **p.thresholds}
    on = lambda g, cond: F.when(F.coalesce(cond, F.lit(False)), g) if g in p.gates else F.lit(None).cast("string")
    weak = (m["train_pf"] < t["train_pf"]) | (m["train_return"] < t["G3"])
    excused = ((m["val_pf"] >= t["exceptional_pf"]) & (m["val_return"] >= t["exceptional_return"])
               & (m["val_trades"] >= t["G1"] * 2) & (m["val_dd"] < t["G2"] * 0.75) & (m["val_win_rate"] > 50.0)
               & (m["return_dd"] >= t["G5"]))
    return F.array_compact(F.array(
        on("G1", m["val_trades"] < t["G1"]), on("G2", m["val_dd"] > t["G2"]), on("G2", m["train_dd"] > t["G2"] * 1.25),
        on("G3", weak & ~excused), on("G4", m["val_return"] < t["G4"]), on("G5", m["return_dd"] < t["G5"]),
        on("G6", m["val_pf"] < t["G6"]),
        on("G7", (m["robustness"] < t["G7"]) & (m["val_sharpe"] <= t["sharpe_override"])),
    ))


_TEXT = {
    "G1": lambda m, t: F.format_string("G1: val_trades %d < %d", m["val_trades"].cast("long"), F.lit(int(t))),
    "G2": lambda m, t: F.format_string("G2: val_dd %.1f%% >= %.1f%%", m["val_dd"], F.lit(t)),
    "G3": lambda m, t: F.format_string("G3: train_return %.2f%% < %.1f%%", m["train_return"], F.lit(t)),
    "G4": lambda m, t: F.format_string("G4: val_return %.2f%% < %.1f%%", m["val_return"], F.lit(t)),
    "G5": lambda m, t: F.format_string("G5: ret/dd %.2f < %.1f", m["return_dd"], F.lit(t)),
    "G6": lambda m, t: F.format_string("G6: val_pf %.2f < %.2f", m["val_pf"], F.lit(t)),
    "G7": lambda m, t: F.format_string("G7: robustness %.2f < %.2f", m["robustness"], F.lit(t)),
}


def per_preset(df: DataFrame, presets: Sequence[Preset], build: Callable[[Preset], dict[str, Column]]) -> DataFrame:
    """One row per input row and preset.  The presets are literals in the plan: no join, no shuffle."""
    structs = [F.struct(F.lit(p.name).alias("preset"), *[c.alias(n) for n, c in build(p).items()]) for p in presets]
    return df.withColumn("_p", F.explode(F.array(*structs))).select("*", "_p.*").drop("_p")


def check_gates(candidates: DataFrame, presets: Sequence[Preset], reason: bool = False, profile: str = "historical") -> DataFrame:
    """Failed gates of every candidate under every preset.

    Each (gate, threshold) is tested once per candidate; a preset then only picks the tests it has switched on.
    """
    m = evidence_columns()
    tests = sorted({(g, float(p.threshold(g, profile))) for p in presets for g in p.gates})
    slot = {t: i for i, t in enumerate(tests)}
    note = lambda g, t: (_TEXT[g](m, t) if g in _TEXT else F.lit(g)) if reason else F.lit("")
    hits = [F.when(fails(g, m, F.lit(t)), F.struct(F.lit(slot[g, t]).alias("k"), F.lit(g).alias("id"), note(g, t).alias("text")))
            for g, t in tests]
    x = candidates.withColumn("_hits", F.array_compact(F.array(*hits)) if hits else F.array().cast(
        "array<struct<k:int,id:string,text:string>>"))
    x = per_preset(x, presets, lambda p: {"_on": F.array(*[F.lit(slot[g, float(p.threshold(g, profile))]) for g in p.gates])
                                          .cast("array<int>")})
    mine = F.filter("_hits", lambda h: F.array_contains("_on", h["k"]))
    x = x.withColumn("_mine", mine).withColumn("failed_gates", F.transform("_mine", lambda h: h["id"]))
    if reason:
        text = F.array_join(F.transform("_mine", lambda h: h["text"]), "; ")
        x = x.withColumn("reason", F.when(F.size("_mine") == 0, "PASS").otherwise(text))
    return x.withColumn("passed", F.size("failed_gates") == 0).drop("_hits", "_on", "_mine")


def rank_candidates(candidates: DataFrame, top: int | None = TOP) -> DataFrame:
    """Candidates with training trades in the total order of the slot; the first ``top`` of each, or all (None).

    With a limit, each task passes on at most ``top`` rows of a slot (the planner's window group limit).
    """
    order = Window.partitionBy(*SLOT).orderBy(F.col("quality_score").desc(), "strategy_name", "param_hash")
    x = candidates.filter(F.col("train_trades") > 0).withColumn("rank", F.row_number().over(order))
    return x if top is None else x.filter(F.col("rank") <= top)


def _ranked(candidates: DataFrame, top: int) -> DataFrame:
    """Top candidates beside slot counts, which are summed before the shuffle; a slot without usable candidates keeps one row."""
    counts = candidates.groupBy(*SLOT).agg(F.count(F.lit(1)).alias("candidate_count"), F.count(F.when(F.col("train_trades") > 0, 1)).alias("usable"))
    return counts.join(rank_candidates(candidates, top), [*SLOT], "left").withColumn("_usable", F.col("rank").isNotNull())


WINNER_FIELDS = ("strategy_name", "param_hash", "quality_score", "rank", "val_trades", "val_pf", "val_return", "val_dd",
                 "val_sharpe", "val_win_rate", "train_trades", "train_pf", "train_return")


def materialise(candidates: DataFrame, presets: Sequence[Preset], slots: DataFrame | None = None, top: int = TOP) -> DataFrame:
    """Rejection ledger of every preset: one row per preset and slot with the winner or none.

    One pass: candidates are ranked once per slot, only the top ones meet the presets, and the regrouping keeps the
    slot partitioning.  ``slots`` may add slots with a ``slot_reason`` that have no usable evidence.
    """
    extra = [c for c in ("is_tuned", "params_json") if c in candidates.columns]
    tested = check_gates(_ranked(candidates, top), presets, reason=True)
    passed = F.col("passed") & F.col("_usable")
    entry = F.struct("rank", "strategy_name", "param_hash", "quality_score", "reason", "failed_gates")
    x = tested.groupBy(*SLOT, "preset").agg(
        F.first("candidate_count").alias("candidate_count"), F.first("usable").alias("usable"),
        F.min(F.when(passed, F.col("rank"))).alias("winner_rank"),
        F.min_by(F.struct(*WINNER_FIELDS, *extra), F.when(passed, F.col("rank"))).alias("winner"),
        F.sort_array(F.collect_list(F.when(F.col("_usable") & ~F.col("passed"), entry))).alias("_rej"),
    )
    if slots is not None:
        spine = per_preset(slots, presets, lambda p: {})
        x = spine.join(x, ["preset", *SLOT], "left")
    active = F.coalesce(*[F.when(F.col("preset") == p.name, F.array(*[F.lit(g) for g in p.gates]).cast("array<string>"))
                          for p in presets])
    won = F.col("winner_rank").isNotNull()
    rej = F.coalesce(F.when(won, F.filter("_rej", lambda r: r["rank"] < F.col("winner_rank"))), F.col("_rej"),
                     F.array().cast(REJECTIONS))
    usable = F.coalesce(F.col("usable"), F.lit(0))
    given = F.col("slot_reason") if slots is not None else F.lit(None).cast("string")
    reason = (F.when(given.isNotNull(), given).when(won, "").when(usable == 0, "nobody traded in training")
              .otherwise("every ranked candidate failed"))
    return x.withColumn("rejections", rej).select(
        "preset", *SLOT, F.coalesce(F.col("candidate_count"), F.lit(0)).alias("candidate_count"),
        F.when(won, F.col("winner_rank")).otherwise(F.least(usable, F.lit(top))).cast("int").alias("candidates_considered"),
        F.when(won, F.col("winner")).alias("winner"), "rejections", active.alias("gates_applied"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("rejections", lambda r: r["failed_gates"])))).alias("binding_gates"),
        F.when(won, "FILLED").otherwise("NO_TRADE").alias("outcome"), reason.alias("reason"),
    )


REJECTIONS = ("array<struct<rank:int,strategy_name:string,param_hash:string,quality_score:double,reason:string,"
              "failed_gates:array<string>>>")


def winners(ledger: DataFrame) -> DataFrame:
    return ledger.filter(F.col("outcome") == "FILLED").select("preset", *SLOT, "winner.*")


def fill_totals(ledger: DataFrame) -> DataFrame:
    filled = F.sum(F.when(F.col("outcome") == "FILLED", 1).otherwise(0))
    return ledger.groupBy("preset").agg(F.count(F.lit(1)).alias("total_slots"), filled.alias("filled_slots"),
                                        (F.count(F.lit(1)) - filled).alias("no_trade_slots"))


def slot_spine(index: DataFrame) -> DataFrame:
    """Four regime slots per indexed (symbol, timeframe), with the reason when its evidence is unusable."""
    status, n = F.col("status"), F.col("candidate_count")
    reason = (F.when(status != "complete", F.concat(F.lit("slot is "), status))
              .when(F.coalesce(n, F.lit(0)) == 0, "slot is empty"))
    return index.select("symbol", "timeframe", reason.alias("slot_reason"),
                        F.explode(F.array(*[F.lit(r) for r in REGIMES])).alias("regime"))


def ablation_summary(pool: DataFrame, presets: Sequence[Preset], profile: str = "historical",
                     keys: Sequence[str] = ("replication_id",)) -> DataFrame:
    """Per replication and preset: acceptance, per-gate and first-gate rejections, accepted medians and FAR."""
    m = pool_columns()
    build = (lambda p: {"failed": failed_production(p, m)}) if profile == "production" else (
        lambda p: {"failed": failed_gates(p, m, profile)})
    x = per_preset(pool, presets, build).withColumn("ok", F.size("failed") == 0)
    ok = F.col("ok")
    acc = lambda c: F.when(ok, F.col(c))
    med = lambda c, q=0.5: F.coalesce(F.percentile(acc(c), F.lit(q)), F.lit(0.0))
    hits = lambda g: F.sum(F.size(F.filter("failed", lambda v: v == g)))
    first = lambda g: F.sum(F.when(F.get("failed", F.lit(0)) == g, 1).otherwise(0))
    agg = x.groupBy(*keys, "preset").agg(
        F.count(F.lit(1)).alias("total_candidates"), F.sum(ok.cast("int")).alias("accepted"),
        F.sum((~ok).cast("int")).alias("rejected"),
        F.sum(F.when(ok & (F.col("robustness_ratio") < 0.5), 1).otherwise(0)).alias("false_accepted"),
        med("robustness_ratio").alias("median_robustness"),
        F.coalesce(F.avg(acc("robustness_ratio")), F.lit(0.0)).alias("mean_robustness"),
        med("robustness_ratio", 0.25).alias("robustness_q25"), med("robustness_ratio", 0.75).alias("robustness_q75"),
        F.min(acc("robustness_ratio")).alias("robustness_min"), F.max(acc("robustness_ratio")).alias("robustness_max"),
        med("val_return_pct").alias("median_val_return_pct"), med("val_drawdown_pct").alias("median_val_drawdown_pct"),
        med("val_profit_factor").alias("median_val_pf"), med("val_return_dd_ratio").alias("median_val_return_dd"),
        *[hits(g).alias(f"{g}_rejections") for g in GATES], *[first(g).alias(f"{g}_first") for g in GATES],
    )
    return (agg.withColumn("acceptance_rate_pct", F.col("accepted") / F.col("total_candidates") * 100)
            .withColumn("false_acceptance_rate_pct",
                        F.col("false_accepted") / F.greatest(F.col("accepted"), F.lit(1)) * 100))


def distribution(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean, quartiles, 95 % range and extremes of each metric over replications, long form."""
    stack = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    x = df.select(*keys, stack.alias("s")).select(*keys, "s.*")
    q = x.groupBy(*keys, "metric").agg(
        rnd(F.avg("value"), 4).alias("mean"),
        F.percentile("value", F.array(*[F.lit(v) for v in (0.5, 0.25, 0.75, 0.025, 0.975)])).alias("q"),
        rnd(F.min("value"), 4).alias("min"), rnd(F.max("value"), 4).alias("max"))
    cut = lambda i, n: rnd(F.col("q")[i], 4).alias(n)
    return q.select(*keys, "metric", "mean", cut(0, "median"), cut(1, "q25"), cut(2, "q75"), cut(3, "ci95_low"),
                    cut(4, "ci95_high"), "min", "max")
