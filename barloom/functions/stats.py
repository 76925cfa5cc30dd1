"""Paired tests over presets: McNemar, Cohen's d, Wilcoxon and Friedman in column arithmetic.

The tables these run on hold one row per preset and slot, symbol or replication, so a rank window per test is small.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.rounding import rnd

C = F.col


@F.pandas_udf(T.DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    """Complementary error function of a handful of test statistics."""
    return x.map(math.erfc, na_action="ignore")


def significant10(x: Column) -> Column:
    """Ten significant digits, as the result tables print p values."""
    return F.format_string("%.9e", x).try_cast("double")


def chi2_survival(x: Column, df: Column) -> Column:
    """Wilson-Hilferty upper tail."""
    k = 2.0 / (9.0 * df)
    z = (F.pow(x / df, F.lit(1.0 / 3.0)) - (1.0 - k)) / F.sqrt(k)
    return F.when(x <= 0, 1.0).otherwise(0.5 * erfc(z / math.sqrt(2.0)))


def pairs(df: DataFrame, baseline: str, others: Sequence[str], keys: Sequence[str], value: Column,
          missing: Column | None = None) -> DataFrame:
    """Rows (keys, preset_b, a, b): the baseline value beside every other preset's.

    One aggregate per key and a literal expansion over the preset names; no self join.
    """
    per = df.groupBy(*keys).agg(*[F.max(F.when(C("preset") == p, value)).alias(p) for p in (baseline, *others)])
    get = lambda p: F.coalesce(C(p), missing) if missing is not None else C(p)
    rows = F.array(*[F.struct(F.lit(p).alias("preset_b"), get(baseline).alias("a"), get(p).alias("b")) for p in others])
    return per.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")


def mcnemar(ledger: DataFrame, baseline: str, others: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Fill/no-fill 2x2 against the baseline with continuity correction; a slot missing on a side is unfilled."""
    j = pairs(ledger, baseline, others, keys, C("outcome") == "FILLED", F.lit(False))
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    t = j.groupBy("preset_b").agg(n(C("a") & C("b")).alias("n11"), n(C("a") & ~C("b")).alias("n10"),
                                  n(~C("a") & C("b")).alias("n01"), n(~C("a") & ~C("b")).alias("n00"))
    d = C("n10") + C("n01")
    chi = F.when(d > 0, rnd(F.pow(F.abs(C("n10") - C("n01")) - 1, F.lit(2)) / d, 4)).otherwise(0.0)
    return t.select(F.lit(baseline).alias("preset_a"), "preset_b", "n11", "n10", "n01", "n00",
                    chi.alias("chi2_approx"), d.alias("discordant_pairs"))


def cohens_d(ledger: DataFrame, baseline: str, others: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Paired quality of slots filled in both presets."""
    j = pairs(ledger, baseline, others, keys, C("winner.quality_score")).withColumn("d", C("a") - C("b"))
    t = j.groupBy("preset_b").agg(F.count("d").alias("common_filled_slots"), F.avg("d").alias("m"), F.stddev_samp("d").alias("s"))
    return t.filter(C("common_filled_slots") > 0).select(
        F.lit(baseline).alias("preset_a"), "preset_b", "common_filled_slots",
        rnd(F.when(C("s") > 0, C("m") / C("s")).otherwise(0.0), 4).alias("cohens_d"))


def _ranked(diffs: DataFrame, group: Sequence[str], eps: float) -> DataFrame:
    """Signed rank sums of non-zero differences with average ranks."""
    x = diffs.filter(F.abs("d") > eps).withColumn("_ad", F.round(F.abs("d"), 12))
    w = Window.partitionBy(*group).orderBy("_ad")
    ties = Window.partitionBy(*group, "_ad")
    x = x.withColumn("_t", F.count(F.lit(1)).over(ties)).withColumn("_r", F.rank().over(w) + (C("_t") - 1) / 2)
    return x.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(C("d") > 0, C("_r")).otherwise(0.0)).alias("w_plus"),
        F.sum(F.when(C("d") < 0, C("_r")).otherwise(0.0)).alias("w_minus"),
        F.sum((C("_t") * C("_t") - 1).cast("double")).alias("tie_term"))


def wilcoxon(diffs: DataFrame, group: Sequence[str], form: str = "simulation", p_values: bool = True) -> DataFrame:
    """Signed-rank test of ``d`` per group.

    ``simulation``: drops differences up to 1e-12, no tie correction, at least ten pairs.
    ``library``: drops exact zeros, tie-corrected normal approximation (small exact tables are left out and noted).
    """
    total = diffs.groupBy(*group).agg(F.count(F.lit(1)).alias("pairs"))
    t = total.join(_ranked(diffs, group, 1e-12 if form == "simulation" else 0.0), list(group), "left").fillna(0, ["n"])
    n = C("n").cast("double")
    stat = F.least("w_plus", "w_minus")
    var = n * (n + 1) * (2 * n + 1) / 24.0
    if form == "library":
        var = var - C("tie_term") / 48.0
    z = F.when(var < 1e-24, 0.0).otherwise((stat - n * (n + 1) / 4.0) / F.sqrt(var))
    if form == "simulation":
        ok = (C("pairs") >= 10) & (C("n") >= 10)
        note = (F.when(C("pairs") < 10, "fewer than ten pairs")
                .when(C("n") < 10, "fewer than ten differences"))
    else:
        ok = C("n") > 0
        note = F.when(C("n") == 0, "no non-zero difference").when(C("n") <= 50, "normal approximation")
    out = t.select(*group, F.when(ok, rnd(stat, 4)).alias("W"), F.when(ok, z).alias("_z"),
                   F.when(C("pairs") < 10, C("pairs")).otherwise(C("n")).alias("n") if form == "simulation" else C("n"),
                   note.alias("note"))
    if p_values:
        out = out.withColumn("p_value", significant10(erfc(F.abs("_z") / math.sqrt(2.0))))
    return out.withColumn("z", rnd("_z", 4)).drop("_z")


def bonferroni(tests: DataFrame, family: Sequence[str], factor: int | None = None) -> DataFrame:
    """Corrected p: times the number of valid tests of the family, or a fixed factor."""
    k = F.lit(factor) if factor else F.count("p_value").over(Window.partitionBy(*family))
    p = F.least(F.lit(1.0), C("p_value") * k)
    return tests.withColumn("bonferroni_p", p).withColumn("significant_at_005", p < 0.05).withColumn(
        "significant_at_001", p < 0.01)


def friedman(df: DataFrame, block: str, treatment: str, value: str, group: Sequence[str] = (), tie_corrected: bool = False,
             p_values: bool = True) -> DataFrame:
    """Friedman rank test; ``tie_corrected`` is the library form, the plain one matches the simulation tables."""
    g = list(group)
    x = df.withColumn("_v", F.round(C(value), 12))
    w = Window.partitionBy(*g, block)
    ties = Window.partitionBy(*g, block, "_v")
    x = (x.withColumn("_t", F.count(F.lit(1)).over(ties)).withColumn("_r", F.rank().over(w.orderBy("_v")) + (C("_t") - 1) / 2))
    sums = x.groupBy(*g, treatment).agg(F.sum("_r").alias("_rs"), F.count(F.lit(1)).alias("_nb"),
                                        F.sum((C("_t") * C("_t") - 1).cast("double")).alias("_tie"))
    t = sums.groupBy(*g).agg(F.max("_nb").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("_tie").alias("_tie"),
                             F.sum(C("_rs") * C("_rs")).alias("ss"), F.sum("_rs").alias("s"))
    n, k = C("n").cast("double"), C("k").cast("double")
    spread = C("ss") - C("s") * C("s") / k
    chi = 12.0 * spread / (n * k * (k + 1))
    if tie_corrected:
        chi = chi / (1 - C("_tie") / (n * k * (k * k - 1)))
        ok = C("k") >= 3
    else:
        ok = (C("k") >= 3) & (C("n") >= 10)
    note = F.when(C("k") < 3, "fewer than three treatments").when(~ok, "fewer than ten blocks")
    out = t.select(*g, F.when(ok, chi).alias("_chi"), F.when(ok, (C("k") - 1).cast("int")).alias("df"), "n", "k",
                   note.alias("note"))
    if p_values:
        out = out.withColumn("p_value", significant10(chi2_survival(C("_chi"), C("df"))))
    return out.withColumn("chi2", rnd("_chi", 4)).drop("_chi")


# ---- tests over blocks -----------------------------------------------------------------------------------------------
#: Most pairs for which the signed-rank test is exact.
EXACT_PAIRS = 50


def signed_rank_counts(n: Column) -> Column:
    """How many of the 2^n sign choices give each rank sum 0, 1, ..., n(n+1)/2: each rank either stays out or shifts the sums by itself."""
    def with_rank(counts: Column, k: Column) -> Column:
        pad = F.array_repeat(F.lit(0.0), k)
        return F.zip_with(F.concat(counts, pad), F.concat(pad, counts), lambda out, shifted: out + shifted)

    return F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.array(F.lit(1.0)).cast("array<double>"), with_rank)


def wilcoxon_exact_p(w: Column, n: Column) -> Column:
    """Two-sided p of a signed-rank statistic (the lesser rank sum) of n pairs without ties; null for n below 1 or above ``EXACT_PAIRS``."""
    upto = F.slice(signed_rank_counts(n), 1, F.floor(w).cast("int") + 1)
    p = F.aggregate(upto, F.lit(0.0), lambda a, x: a + x) * 2 / F.pow(F.lit(2.0), n)
    return F.when(n.between(1, EXACT_PAIRS), F.least(F.lit(1.0), p))


def dense_blocks(df: DataFrame, block: str, treatment: str, values: Sequence[str], treatments: Sequence[str]) -> DataFrame:
    """(block, treatment, metric, v) for every block and each of the named treatments; one that is absent or null counts 0.0."""
    full = df.select(block).distinct().select(block, F.explode(F.array(*[F.lit(t) for t in treatments])).alias(treatment))
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias("v")) for m in values])
    return full.join(df.select(block, treatment, *values), [block, treatment], "left").select(block, treatment, F.explode(cells).alias("c")).select(
        block, treatment, "c.*")


def blocked_friedman(dense: DataFrame, block: str, treatment: str, p_values: bool = True) -> DataFrame:
    """Tie-corrected Friedman test of each metric over complete blocks."""
    return friedman(dense, block, treatment, "v", ["metric"], tie_corrected=True, p_values=p_values)


def blocked_wilcoxon(dense: DataFrame, block: str, treatment: str, baseline: str, factor: int = 6, p_values: bool = True) -> DataFrame:
    """Baseline less each other treatment, paired by block: W, n, median difference, exact p where there are neither zeros nor ties, and p times ``factor``.

    Elsewhere p comes from ``z`` of the tie-corrected normal approximation, or is null without ``p_values``.
    """
    base = dense.filter(C(treatment) == baseline).select(block, "metric", C("v").alias("_a"))
    x = dense.filter(C(treatment) != baseline).join(base, [block, "metric"]).withColumn("d", C("_a") - C("v"))
    g = ["metric", treatment]
    t = x.groupBy(*g).agg(F.count(F.lit(1)).alias("pairs"), F.percentile("d", F.lit(0.5)).alias("_md"))
    t = t.join(_ranked(x, g, 0.0), g, "left").fillna(0, ["n"])
    n = C("n").cast("double")
    w = F.least("w_plus", "w_minus")
    var = n * (n + 1) * (2 * n + 1) / 24.0 - C("tie_term") / 48.0
    p = F.when((C("n") == C("pairs")) & (C("tie_term") == 0), wilcoxon_exact_p(w, C("n")))
    note = F.when(C("n") == 0, "no non-zero difference").when(p.isNull(), "normal approximation").otherwise("exact")
    z = F.when(var > 1e-24, (w - n * (n + 1) / 4.0) / F.sqrt(var))
    out = t.select("metric", C(treatment).alias("preset_b"), "n", rnd(w, 4).alias("W"), rnd("_md", 4).alias("median_delta"), p.alias("p_value"), z.alias("_z"), note.alias("note"))
    if p_values:
        out = out.withColumn("p_value", F.coalesce("p_value", significant10(erfc(F.abs("_z") / math.sqrt(2.0)))))
    return out.withColumn("z", rnd("_z", 4)).drop("_z").withColumn("bonferroni_p", F.when(C("p_value").isNotNull(), F.least(F.lit(1.0), C("p_value") * factor)))
