"""Numbering, chunking, running totals and indicators do not depend on how the series is cut."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barloom.sources.adapters import sales_ledger
from barloom.functions.indicators import ALL_FEATURES, Frame, features
from barloom.functions.recursive import FAMILIES, family, memory
from barloom.operators.buckets import bucket_metrics, equity_path
from barloom.series import KEYS, cumulate, number_bars, number_rows

EXTRA = ["TRIX_12_9", "TRIXSIG_12_9", "KAMA_10_2_30", "FISHER_10", "BULL_13_3", "WADX_14", "SADX_14", "VIP_14", "AROONU_25", "VWAPZ_50_50",
         "STOCHRSIK_14_14_3_3", "SENKOUA_9_26_52", "PCTRANK_ROC_10_100", "PIVOTH_5", "PIVOTL_5"]


def _sorted(df):
    return df.toPandas().sort_values(["symbol", "bar_no"], ignore_index=True)


def test_positions_agree_in_every_bucket_size(bars):
    whole = _sorted(number_rows(bars, KEYS, ["ts"], F.lit(0)))
    cut = _sorted(number_bars(bars, chunk_rows=16))
    assert (whole["bar_no"] == cut["bar_no"]).all() and (cut["series_rows"] == 320).all()
    assert (cut.sort_values(["symbol", "ts"])["bar_no"].to_numpy() == np.tile(np.arange(320), 2)).all()


def test_features_do_not_depend_on_chunk_size(bars):
    names = [*ALL_FEATURES, *EXTRA]
    whole, cut = _sorted(features(bars, names)), _sorted(features(bars, names, chunk_rows=37))
    for n in names:
        a, b = whole[n].astype(float), cut[n].astype(float)
        assert (a.isna() == b.isna()).all(), n
        assert np.nanmax(np.abs(a - b)) < 1e-9, n


def test_halo_covers_the_memory_of_every_recursive_family():
    for name in ("EMA_200", "RSI_21", "MACD_12_26_9", "WADX_14", "SADX_14", "TRIX_12_9", "KAMA_10_2_30", "FISHER_10", "BULL_13_3"):
        fam, args = family(name)
        assert fam in FAMILIES and memory(name) > max(args)
    assert (1 - 2 / 201) ** memory("EMA_200") < 1e-18


def test_past_does_not_change_when_the_future_is_cut(spark, bars_pdf):
    names = ["ATR_14", "EMA_20", "RSI_14", "CCI", "HULL_MA", "PIVOTH_5", "PCTRANK_ROC_10_100"]
    part = bars_pdf[bars_pdf.ts < bars_pdf.ts.min() + pd.Timedelta(hours=200)]
    a = _sorted(features(spark.createDataFrame(bars_pdf), names))
    b = _sorted(features(spark.createDataFrame(part), names))
    a = a[a.bar_no < 200].reset_index(drop=True)
    for n in names:
        assert np.allclose(a[n].astype(float), b[n].astype(float), equal_nan=True), n


def test_recursions_against_plain_loops(bars, bars_pdf):
    got = _sorted(features(bars, ["EMA_10", "RSI_14", "KAMA_10_2_30", "FISHER_10", "MACD_HIST"]))
    for sym, g in bars_pdf.groupby("symbol"):
        c, h, lo = (g[k].to_numpy() for k in ("close", "high", "low"))
        out = got[got.symbol == sym].reset_index(drop=True)
        ema = lambda x, n: np.array([y := x[0]] + [y := y + 2 / (n + 1) * (v - y) for v in x[1:]])
        assert np.allclose(out["EMA_10"], ema(c, 10))
        line = ema(c, 12) - ema(c, 26)
        assert np.allclose(out["MACD_HIST"], line - ema(line, 9))
        d = np.r_[0, np.diff(c)]
        wil = lambda x: np.array([y := x[0]] + [y := y + (v - y) / 14 for v in x[1:]])
        r = 100 - 100 / (1 + wil(np.maximum(d, 0)) / (wil(np.maximum(-d, 0)) + 1e-10))
        assert np.allclose(out["RSI_14"][13:], r[13:]) and out["RSI_14"][:13].isna().all()
        k, y = [], c[10]
        for i in range(11, len(c)):
            vol = np.abs(np.diff(c[i - 10:i + 1])).sum()
            sc = ((abs(c[i] - c[i - 10]) / vol if vol else 0) * (2 / 3 - 2 / 31) + 2 / 31) ** 2
            y = y + sc * (c[i] - y)
            k.append(y)
        assert np.allclose(out["KAMA_10_2_30"][11:], k)
        f, x = 0.0, None
        for i in range(9, len(c)):
            top, bot = h[i - 9:i + 1].max(), lo[i - 9:i + 1].min()
            v = 2 * (((h[i] + lo[i]) / 2 - bot) / (top - bot + 1e-10)) - 1
            x = v if x is None else 0.5 * v + 0.5 * x
            z = min(max(x, -0.999), 0.999)
            f = 0.25 * np.log((1 + z) / (1 - z)) + 0.5 * f
            assert abs(out["FISHER_10"][i] - f) < 1e-9


def test_last_pivot_is_found_beyond_the_halo(bars, bars_pdf):
    rare = bars.withColumn("flag", F.when(F.col("close") == F.lit(bars_pdf.close.iloc[5]), F.col("close")))
    f = Frame.of(number_bars(rare, chunk_rows=20), lookback=3, chunk_rows=20)
    f.ffill("seen", "flag")
    got = f.own().toPandas().sort_values(["symbol", "bar_no"], ignore_index=True)
    for sym, g in got.groupby("symbol"):
        src = bars_pdf[bars_pdf.symbol == sym].reset_index(drop=True)
        want = src.close.where(src.close == bars_pdf.close.iloc[5]).ffill()
        assert np.allclose(g["seen"].astype(float).to_numpy(), want.to_numpy(), equal_nan=True)


def test_running_totals_in_blocks(bars):
    x = number_bars(bars).withColumn("blk", F.expr("bar_no div 13"))
    out = cumulate(x, KEYS, "blk", ["bar_no"], {
        "s": ("sum", F.col("volume")), "m": ("max", F.col("high")), "l": ("last", F.when(F.col("volume") > 50, F.col("close")))})
    for _, g in out.toPandas().sort_values("bar_no").groupby("symbol"):
        assert np.allclose(g["s"], g["volume"].cumsum()) and np.allclose(g["m"], g["high"].cummax())
        assert np.allclose(g["l"].astype(float), g["close"].where(g["volume"] > 50).ffill(), equal_nan=True)


def test_equity_path_in_blocks_equals_one_window(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], 400, p=[0.8, 0.2]), "entry_bar": np.arange(400), "pnl_dollars": np.round(rng.normal(0, 300, 400), 2),
                        "r_multiple": np.round(rng.normal(0, 1, 400), 3)})
    df = spark.createDataFrame(pdf)
    cols = ["equity", "peak", "losing_streak"]
    a = equity_path(df, ["k"], block_rows=10**6).toPandas().sort_values("entry_bar", ignore_index=True)
    b = equity_path(df, ["k"], block_rows=7).toPandas().sort_values("entry_bar", ignore_index=True)
    assert np.allclose(a[cols].astype(float), b[cols].astype(float))
    m = bucket_metrics(df, ["k"], block_rows=7).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        eq = 10000 + g.pnl_dollars.cumsum()
        dd = ((np.maximum(eq.cummax(), 10000) - eq) / np.maximum(eq.cummax(), 10000) * 100).max()
        run = best = 0
        for v in g.pnl_dollars:
            run = run + 1 if v < 0 else 0
            best = max(best, run)
        assert abs(m.loc[k, "max_drawdown_pct"] - dd) < 0.01 and m.loc[k, "max_consecutive_losses"] == best
        assert m.loc[k, "total_trades"] == len(g) and abs(m.loc[k, "worst_5pct_r"] - np.percentile(g.r_multiple, 5)) < 1e-3


def test_daily_bars_do_not_overflow_the_bucket(spark, bars_pdf):
    daily = bars_pdf.assign(timeframe="D1", ts=pd.date_range("1990-01-01", periods=len(bars_pdf), freq="D"))
    out = number_bars(spark.createDataFrame(daily)).toPandas()
    assert out.groupby("symbol").bar_no.max().tolist() == [319, 319]


def test_sales_lines_alike_in_day_order_and_number_keep_the_order_of_their_files(spark, tmp_path):
    """The larger file comes second by name, though Spark reads it first."""
    line = "SELECT 7L AS l_orderkey, CAST(id % 5 AS LONG) AS l_partkey, 0L AS l_suppkey, 1 AS l_linenumber, id + {0}D AS l_extendedprice, 0.06D AS l_discount, 0.0D AS l_tax, " \
           "'A' AS l_returnflag, 'F' AS l_linestatus, TIMESTAMP_NTZ'2024-01-01' AS l_shipdate FROM range({1})"
    for name, first, n in (("a", 1000, 10), ("b", 2000, 4000)):
        (tmp_path / "lineitem.parquet").mkdir(exist_ok=True)
        spark.sql(line.format(first, n)).toPandas().to_parquet(tmp_path / "lineitem.parquet" / f"{name}.parquet", coerce_timestamps="us")
    spark.sql("SELECT 0L AS s_suppkey, 0 AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.sql("SELECT 0 AS n_nationkey, 'N' AS n_name").write.parquet(f"{tmp_path}/nation.parquet")
    spark.sql("SELECT id AS p_partkey, 'B' AS p_brand FROM range(5)").write.parquet(f"{tmp_path}/part.parquet")
    got = [r["pnl_dollars"] for r in sales_ledger(spark, str(tmp_path)).orderBy("entry_bar").collect()]
    assert len(got) == 4010 and got == sorted(got)


def test_bucket_metrics_read_the_trades_once(spark):
    df = spark.range(90).select(F.lit("a").alias("k"), F.col("id").alias("entry_bar"), (F.col("id") % 7 - 3.0).alias("pnl_dollars"), F.lit(1.0).alias("r_multiple"))
    plan = bucket_metrics(df, ["k"], block_rows=7)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1 and "LogicalRDD" not in plan


def test_equal_and_missing_profits_in_blocks(spark):
    rows = [("same", i, 0.1, None) for i in range(40)] + [("gaps", i, None if i % 3 == 1 else -2.0 if i < 20 else 5.0, 0.5) for i in range(30)]
    m = bucket_metrics(spark.createDataFrame(rows, "k string, entry_bar long, pnl_dollars double, r_multiple double"), ["k"], block_rows=7).toPandas().set_index("k")
    assert m.loc["same", "sharpe_approx"] == 0.0 and m.loc["same", "max_drawdown_pct"] == 0.0 and np.isnan(m.loc["same", "mean_r"])
    g = m.loc["gaps"]  # the last loss is the 19th row; rows without a profit break no streak
    assert (g.total_trades, g.max_consecutive_losses, g.total_pnl, g.worst_5pct_r) == (30, 19, -26 + 35.0, 0.5)


def test_collected_candidates_number_the_ledger_once(spark, monkeypatch):
    from barloom.plans import selection_queries as sq
    calls = []
    monkeypatch.setattr(sq, "sales_ledger", lambda s, d: calls.append(d) or sales_ledger(s, d))
    assert sq.QUERIES["collect_candidates"](spark, "/root/testdata/sf0.001").columns == ["symbol", "timeframe", "strategy_name", "is_tuned"] and len(calls) == 1
