"""Preset comparison tables over the rejection ledger and the winners."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.rounding import rnd

from barloom.functions.scoring import return_dd, rho
from barloom.operators.buckets import REGIMES
from barloom.operators.gates import GATES, PRESETS, SLOT

C = F.col


def _filled() -> Column:
    return F.when(C("outcome") == "FILLED", 1).otherwise(0)


def _share(part: Column, total: Column, digits: int = 1) -> Column:
    return rnd(100 * part / F.greatest(total, F.lit(1)), digits)


def fill_rates(ledger: DataFrame) -> DataFrame:
    """Fill rate per preset, overall and by regime, in one pass over the ledger."""
    in_r = {r: C("regime") == r for r in REGIMES}
    agg = ledger.groupBy("preset").agg(
        F.count(F.lit(1)).alias("total_slots"), F.sum(_filled()).alias("filled_slots"),
        *[F.sum(F.when(c, _filled()).otherwise(0)).alias(f"{r}_filled") for r, c in in_r.items()],
        *[F.sum(c.cast("int")).alias(f"{r}_total") for r, c in in_r.items()])
    return agg.select(
        "preset", "total_slots", "filled_slots", (C("total_slots") - C("filled_slots")).alias("no_trade_slots"),
        _share(C("filled_slots"), C("total_slots")).alias("fill_rate_pct"),
        *[c for r in REGIMES for c in (C(f"{r}_filled"), C(f"{r}_total"),
                                       _share(C(f"{r}_filled"), C(f"{r}_total")).alias(f"{r}_fill_pct"))])


def convergence(winners: DataFrame, presets: Sequence[str] = tuple(PRESETS)) -> DataFrame:
    """Pairwise Jaccard similarity of winner sets.

    Each distinct winner carries the set of presets that chose it; pair counts are sums over those sets, so no
    pair of winner rows is ever formed.
    """
    marks = winners.groupBy(*SLOT, "strategy_name", "param_hash").agg(
        *[F.max((C("preset") == p).cast("int")).alias(p) for p in presets])
    sums = marks.agg(*[F.sum(C(a) * C(b)).alias(f"{a}|{b}") for i, a in enumerate(presets) for b in presets[i:]])
    both = lambda a, b: F.coalesce(C(f"`{a}|{b}`") if presets.index(a) <= presets.index(b) else C(f"`{b}|{a}`"), F.lit(0))
    rows = [F.struct(F.lit(a).alias("preset"), *[
        rnd(both(a, b) / F.greatest(both(a, a) + both(b, b) - both(a, b), F.lit(1)), 4).alias(b) for b in presets])
        for a in presets]
    return sums.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def binding_gates(ledger: DataFrame) -> DataFrame:
    won = C("outcome") == "FILLED"
    return ledger.groupBy("preset").agg(
        F.sum(_filled()).alias("filled"), F.sum(1 - _filled()).alias("no_trade"),
        F.sum(F.when(won & (C("winner.rank") > 1), 1).otherwise(0)).alias("slots_with_top1_rejected"),
        rnd(F.coalesce(F.avg(F.when(won, C("winner.rank"))), F.lit(0.0)), 2).alias("avg_winner_rank"),
        *[F.sum(F.array_contains("binding_gates", g).cast("int")).alias(f"{g}_binding_slots") for g in GATES])


def quality_by_regime(winners: DataFrame) -> DataFrame:
    zero = lambda c: rnd(F.coalesce(c, F.lit(0.0)), 4)
    in_r = {r: F.when(C("regime") == r, C("quality_score")) for r in REGIMES}
    return winners.groupBy("preset").agg(
        zero(F.avg("quality_score")).alias("overall_mean_quality"),
        zero(F.percentile("quality_score", F.lit(0.5))).alias("overall_median_quality"),
        F.count(F.lit(1)).alias("winner_count"),
        *[e for r, c in in_r.items() for e in (zero(F.avg(c)).alias(f"{r}_mean_quality"), F.count(c).alias(f"{r}_count"))],
        *[zero(F.avg(m)).alias(f"mean_{m}") for m in ("val_pf", "val_return", "val_dd")])


def with_robustness(winners: DataFrame) -> DataFrame:
    num = {c: F.coalesce(C(c).cast("double"), F.lit(0.0)) for c in ("val_pf", "train_pf", "val_return", "train_return", "val_dd")}
    x = winners.withColumns(num)
    x = x.withColumn("robustness", rho(C("train_pf"), C("val_pf"), C("train_return"), C("val_return")))
    return x.withColumn("far_flag", C("robustness") < 0.5).withColumn("val_return_dd", return_dd(C("val_return"), C("val_dd")))


def _medians(digits: dict[str, int]) -> list[Column]:
    med = lambda c: F.coalesce(F.percentile(c, F.lit(0.5)), F.lit(0.0))
    far = F.coalesce(F.avg(C("far_flag").cast("double")), F.lit(0.0)) * 100
    d = digits
    return [rnd(med("robustness"), d["rho"]).alias("median_rho"), rnd(far, d["far"]).alias("far_pct"),
            rnd(med("val_return"), d["ret"]).alias("median_val_return"), rnd(med("val_dd"), d["ret"]).alias("median_val_dd"),
            rnd(med("val_pf"), d["rho"]).alias("median_pf"), rnd(med("val_return_dd"), d["rho"]).alias("median_return_dd")]


MEDIANS = ("median_rho", "far_pct", "median_val_return", "median_val_dd", "median_pf", "median_return_dd")


def _with_winner(ledger: DataFrame) -> DataFrame:
    """Ledger rows with the winner's metrics beside them; unfilled slots keep nulls, which no aggregate counts."""
    need = ("val_pf", "train_pf", "val_return", "train_return", "val_dd")
    x = ledger.select("*", *[C(f"winner.{n}").cast("double").alias(n) for n in need])
    x = x.withColumn("robustness", rho(C("train_pf"), C("val_pf"), C("train_return"), C("val_return")))
    return x.withColumn("far_flag", C("robustness") < 0.5).withColumn(
        "val_return_dd", F.when(C("val_dd").isNotNull(), return_dd(C("val_return"), C("val_dd"))))


def headline(ledger: DataFrame) -> DataFrame:
    """Acceptance, median robustness, FAR and accepted medians per preset, in one aggregate."""
    t = _with_winner(ledger).groupBy("preset").agg(
        F.max(F.array_join("gates_applied", ", ")).alias("_g"), F.max(F.size("gates_applied")).alias("gate_count"),
        F.sum(_filled()).alias("accepted_slots"), F.count(F.lit(1)).alias("_n"), *_medians({"rho": 3, "far": 2, "ret": 2}))
    return t.select("preset", F.when(C("_g") == "", "none").otherwise(C("_g")).alias("active_gates"), "gate_count",
                    "accepted_slots", _share(C("accepted_slots"), C("_n")).alias("acceptance_pct"), *MEDIANS)


def symbol_aggregates(ledger: DataFrame) -> DataFrame:
    t = _with_winner(ledger).groupBy("preset", "symbol").agg(
        F.count(F.lit(1)).alias("total_slots"), F.sum(_filled()).alias("filled_slots"), *_medians({"rho": 6, "far": 6, "ret": 6}))
    return t.select("preset", "symbol", "total_slots", "filled_slots",
                    _share(C("filled_slots"), C("total_slots"), 4).alias("acceptance_pct"), *MEDIANS)


def far_sensitivity(winners: DataFrame, presets: Sequence[str] = tuple(PRESETS),
                    thresholds: Sequence[float] = (0.4, 0.5, 0.6)) -> DataFrame:
    """FAR at each threshold with the preset ranking and whether all rankings agree."""
    names = [f"far_pct_rho_lt_{str(t).replace('.', '_')}" for t in thresholds]
    far = with_robustness(winners).groupBy("preset").agg(*[
        rnd(F.avg((C("robustness") < t).cast("double")) * 100, 2).alias(n) for t, n in zip(thresholds, names)])
    spark = winners.sparkSession
    base = spark.createDataFrame([(p,) for p in presets], "preset string")
    rows = base.join(far, "preset", "left").fillna(0.0, names)
    # one row per preset: the whole table is at most as long as the preset list
    ranked = rows.withColumns({f"rank_{n[-3:]}": F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(n, "preset"))
                               for n in names})
    first = C(f"rank_{names[0][-3:]}")
    agree = F.min(F.when(sum((F.abs(C(f"rank_{n[-3:]}") - first) for n in names[1:]), F.lit(0)) == 0, 1).otherwise(0))
    return ranked.withColumn("ranking_stable", agree.over(Window.partitionBy(F.lit(1))) == 1)


def gate_overlap(ledger: DataFrame, preset: str, a: str, b: str) -> DataFrame:
    """2x2 overlap of two gates among rejected candidates and among slots, with Jaccard, phi and conditionals."""
    x = ledger.filter(C("preset") == preset)
    has = lambda arr, g: F.array_contains(arr, g)
    slot = x.select(F.lit("slot").alias("level"), C("binding_gates").alias("g"))
    cand = x.select(F.explode("rejections").alias("r")).select(F.lit("candidate").alias("level"), C("r.failed_gates").alias("g"))
    s = slot.unionByName(cand).select("level", has("g", a).alias("ha"), has("g", b).alias("hb"))
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    t = s.groupBy("level").agg(n(C("ha") & C("hb")).alias("both_failed"), n(C("ha") & ~C("hb")).alias("a_only"),
                               n(~C("ha") & C("hb")).alias("b_only"), n(~C("ha") & ~C("hb")).alias("neither"))
    bo, ao, bn, ne = C("both_failed"), C("a_only"), C("b_only"), C("neither")
    den = F.sqrt((bo + ao).cast("double") * (bo + bn) * (ao + ne) * (bn + ne))
    union = bo + ao + bn
    return t.select(
        F.lit(preset).alias("preset"), F.lit(a).alias("gate_a"), F.lit(b).alias("gate_b"), "level", "both_failed", "a_only",
        "b_only", "neither", F.when(union > 0, rnd(bo / union, 4)).otherwise(0.0).alias("jaccard"),
        F.when(den > 0, rnd((bo * ne - ao * bn) / den, 4)).otherwise(0.0).alias("phi"),
        _share(bo, bo + ao, 2).alias("p_b_given_a_pct"), _share(bo, bo + bn, 2).alias("p_a_given_b_pct"))


def compare_tables(actual: DataFrame, expected: DataFrame, keys: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Cell-by-cell comparison: exact for text, within ``tolerance`` for numbers, plus rows missing on a side."""
    cols = [c for c in expected.columns if c not in keys]
    j = actual.alias("a").join(expected.alias("e"), list(keys), "full_outer")
    kind = dict(expected.dtypes)

    def same(c: str) -> Column:
        a, e = C(f"a.{c}"), C(f"e.{c}")
        if kind[c] in ("double", "float"):
            return F.coalesce(F.abs(a - e) <= tolerance, a.isNull() & e.isNull())
        return a.eqNullSafe(e)

    bad = F.array_compact(F.array(*[F.when(~same(c), c) for c in cols]))
    return j.select(*keys, bad.alias("mismatched")).withColumn("ok", F.size("mismatched") == 0)
