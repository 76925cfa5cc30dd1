"""Signed-rank and block tests against enumeration and plain formulas."""

import math
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from barloom.functions import stats


def test_exact_signed_rank_equals_enumeration(spark):
    rows = []
    for n in range(1, 13):
        sums = [sum(k for k, s in enumerate(signs, 1) if s) for signs in product((0, 1), repeat=n)]
        rows += [(n, float(w), min(1.0, 2 * sum(x <= w for x in sums) / 2**n)) for w in range(n * (n + 1) // 4 + 1)]
    df = spark.createDataFrame(rows, "n long, w double, p double")
    got = df.select("p", stats.wilcoxon_exact_p(F.col("w"), F.col("n")).alias("q")).collect()
    assert all(abs(x.p - x.q) < 1e-12 for x in got) and len(got) == len(rows)
    big = spark.createDataFrame([(50, 0.0), (51, 0.0), (0, 0.0)], "n long, w double").select(stats.wilcoxon_exact_p(F.col("w"), F.col("n")).alias("p")).collect()
    assert abs(big[0].p - 2.0**-49) < 1e-30 and big[1].p is None and big[2].p is None


def test_blocks_are_dense_and_absent_presets_count_zero(spark):
    r = np.random.default_rng(2)
    rows = [(f"s{i}", t, float(r.integers(0, 9)), float(r.normal())) for i in range(14) for t in "abc" if (i, t) != (3, "b")]
    rows[5] = (*rows[5][:3], None)
    df = spark.createDataFrame(rows, "symbol string, preset string, x double, y double")
    dense = stats.dense_blocks(df, "symbol", "preset", ["x", "y"], ["a", "b", "c"])
    pdf = dense.toPandas()
    assert len(pdf) == 14 * 3 * 2 and pdf[(pdf.symbol == "s3") & (pdf.preset == "b")].v.eq(0).all()
    chi = {x.metric: x.chi2 for x in stats.blocked_friedman(dense, "symbol", "preset", False).collect()}
    for metric, g in pdf.groupby("metric"):
        m = g.pivot(index="symbol", columns="preset", values="v")
        ranks = m.rank(axis=1)
        ties = sum((c**3 - c) for row in m.to_numpy() for c in np.unique(row, return_counts=True)[1])
        n, k = m.shape
        want = (12 / (n * k * (k + 1)) * (ranks.sum() ** 2).sum() - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1)))
        assert abs(chi[metric] - want) < 1e-4
    out = {(x.metric, x.preset_b): x for x in stats.blocked_wilcoxon(dense, "symbol", "preset", "a").collect()}
    m = pdf[pdf.metric == "y"].pivot(index="symbol", columns="preset", values="v")
    d = (m["a"] - m["c"]).to_numpy()
    ranks = np.abs(d).argsort().argsort() + 1
    w = min(ranks[d > 0].sum(), ranks[d < 0].sum())
    sums = [sum(k for k, s in enumerate(signs, 1) if s) for signs in product((0, 1), repeat=14)]
    x = out["y", "c"]
    assert x.W == w and x.note == "exact" and abs(x.p_value - min(1, 2 * sum(s <= w for s in sums) / 2**14)) < 1e-12
    assert abs(x.median_delta - np.median(d)) < 1e-4 and abs(x.bonferroni_p - min(1, 6 * x.p_value)) < 1e-12
    x = out["x", "b"]
    assert x.note == "normal approximation" and abs(x.p_value - math.erfc(abs(x.z) / math.sqrt(2))) < 1e-3 and abs(x.bonferroni_p - min(1, 6 * x.p_value)) < 1e-9
