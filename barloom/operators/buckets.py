"""Trades to per-regime metrics and candidate evidence."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.rounding import rnd

from barloom.functions import scoring as sc
from barloom.operators.resample import split_bounds
from barloom.series import chunk_length
from barloom.session import cut_lineage

REGIMES = ("TREND", "RANGE", "BREAKOUT", "CHOP")
CAND = ("symbol", "timeframe", "strategy_name", "param_hash")
METRICS = ("total_trades", "win_rate", "profit_factor", "total_pnl", "gross_profit", "gross_loss", "avg_win", "avg_loss",
           "sharpe_approx", "max_drawdown_pct", "total_return_pct", "max_consecutive_losses", "calmar_ratio", "mean_r",
           "worst_5pct_r", "sortino_approx")


def bucket_by_regime(trades: DataFrame, regimes: DataFrame) -> DataFrame:
    """Attach the regime known at the entry bar; trades without one leave."""
    live = regimes.select("symbol", "timeframe", F.col("bar_no").alias("entry_bar"), F.col("regime_live").alias("regime"))
    return trades.join(live.filter(F.col("regime").isin(*REGIMES)), ["symbol", "timeframe", "entry_bar"])


def split_trades(trades: DataFrame) -> DataFrame:
    """Train/validation rows of a positioned ledger; the overlap appears in both."""
    end, start = split_bounds(F.col("slot_trades"))
    tags = F.array_compact(F.array(F.when(F.col("entry_bar") < end, F.lit("train")),
                                   F.when(F.col("entry_bar") >= start, F.lit("val"))))
    return trades.withColumn("split", F.explode(tags))


def ratio0(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def equity_path(trades: DataFrame, keys: Sequence[str], capital: float = 10000.0, order: Sequence[str] = ("entry_bar",),
                block_rows: int | None = None) -> DataFrame:
    """Running equity, its peak and the current losing streak of each key, in ``order``.

    Built in blocks of positions so that a key of any size spreads over many tasks: windows inside a block, and one
    carry row per block with its sum, highest prefix, length and last non-losing position.
    """
    keys = list(keys)
    pnl, c = F.col("pnl_dollars"), F.col
    block_rows = chunk_length(trades, block_rows)
    wb = Window.partitionBy(*keys, "_blk").orderBy(*order)
    run = wb.rowsBetween(Window.unboundedPreceding, 0)
    # both the rows and the block summaries read the ledger: write it once instead of building it twice
    x = cut_lineage(trades).withColumn("_blk", F.expr(f"{order[0]} div {block_rows}"))
    x = x.withColumns({"_cum": F.sum(pnl).over(run), "_pos": F.row_number().over(wb)})
    held = F.when(pnl >= 0, c("_pos"))
    blocks = x.groupBy(*keys, "_blk").agg(F.sum(pnl).alias("s"), F.max("_cum").alias("m"), F.max("_pos").alias("n"),
                                          F.max(held).alias("o"))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns({"_s": F.coalesce(F.sum("s").over(before), F.lit(0.0)),
                                 "_n": F.coalesce(F.sum("n").over(before), F.lit(0))})
    blocks = blocks.select(*keys, "_blk", "_s", "_n", F.max(c("_s") + c("m")).over(before).alias("_m"),
                           F.max(c("_n") + c("o")).over(before).alias("_o"))
    x = x.withColumns({"_top": F.max("_cum").over(run), "_held": F.max(held).over(run)}).join(blocks, [*keys, "_blk"])
    last_held = F.coalesce(c("_n") + c("_held"), c("_o"), F.lit(0))
    return x.withColumns({
        "equity": capital + c("_s") + c("_cum"),
        "peak": F.greatest(F.lit(capital), capital + c("_m"), capital + c("_s") + c("_top")),
        "losing_streak": F.when(pnl < 0, c("_n") + c("_pos") - last_held).otherwise(0),
    }).drop("_blk", "_cum", "_pos", "_top", "_held", "_s", "_n", "_m", "_o")


# What a block of trades tells of itself, whatever was earned before it.
BLOCK = ("n long, wins long, losses long, known long, s double, gp double, gl double, mean double, m2 double, lmean double, lm2 double, m double, "
         "o long, lead long, inner long, dips array<struct<top:double,low:double>>, rs array<struct<r:double,c:long>>")
#: Cells of the padded tables in which the blocks of a batch are worked on.
CELLS = 1 << 20


def _moments(x: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sum of squared deviations per row over the cells of ``ok``; exact for equal cells."""
    n = ok.sum(1)
    ref = np.where(ok, x, -np.inf).max(1)
    ref[n == 0] = 0.0
    mean = ref + np.where(ok, x - ref[:, None], 0.0).sum(1) / np.maximum(n, 1)
    return mean, np.where(ok, (x - mean[:, None]) ** 2, 0.0).sum(1)


def _dips(cum: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, top, low) of every dip deeper than all before it in its row, the lowest under each top.

    A dip that is no deeper than one under a lower top is the lesser drawdown whatever the block starts from.
    """
    top = np.maximum(np.maximum.accumulate(cum, 1), 0.0)
    deep = np.maximum.accumulate(top - cum, 1)
    new = np.diff(deep, axis=1, prepend=0.0) > 0
    row, at = np.nonzero(new)
    top, low = top[row, at], cum[row, at]
    last = np.append((row[1:] != row[:-1]) | (top[1:] != top[:-1]), True)[:len(row)]
    return row[last], top[last], low[last]


def _lists(count: np.ndarray, **values: np.ndarray) -> pa.Array:
    offsets = np.r_[0, np.cumsum(count)].astype("int32")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(v) for v in values.values()], list(values)))


def _summaries(pnl: np.ndarray, r: np.ndarray, at: np.ndarray, size: np.ndarray) -> list[pa.Array]:
    """The ``BLOCK`` columns of blocks of ``size`` trades; ``at`` orders the trades within their blocks."""
    k = len(size)
    seg = np.repeat(np.arange(k), size)
    sort = np.lexsort((at, seg))
    pnl, start = pnl[sort], np.cumsum(size) - size
    num = {c: np.zeros(k, t) for c, t in (("wins", "i8"), ("losses", "i8"), ("known", "i8"), ("s", "f8"), ("gp", "f8"), ("gl", "f8"), ("mean", "f8"), ("m2", "f8"),
                                          ("lmean", "f8"), ("lm2", "f8"), ("m", "f8"), ("o", "i8"), ("lead", "i8"), ("inner", "i8"))}
    dips = []
    for width in np.unique(np.ceil(np.log2(size)).astype(int)):  # blocks of like size share a padded table
        like = np.flatnonzero(np.ceil(np.log2(size)).astype(int) == width)
        step = max(1, CELLS >> int(width))
        for part in (like[i:i + step] for i in range(0, len(like), step)):
            cols = np.arange(size[part].max())
            inside = cols < size[part][:, None]
            x = np.full(inside.shape, np.nan)
            x[inside] = pnl[(start[part][:, None] + cols)[inside]]
            ok, win, loss, held = ~np.isnan(x), x > 0, x < 0, x >= 0
            v = np.where(ok, x, 0.0)
            cum = np.cumsum(v, 1)
            kept = np.maximum.accumulate(np.where(held, cols + 1, 0), 1)
            run = np.where(loss, cols + 1 - kept, 0)
            num["wins"][part], num["losses"][part], num["known"][part] = win.sum(1), loss.sum(1), ok.sum(1)
            num["s"][part], num["m"][part], num["o"][part] = cum[:, -1], cum.max(1), kept[:, -1]
            num["gp"][part], num["gl"][part] = np.where(win, v, 0.0).sum(1), np.where(loss, v, 0.0).sum(1)
            num["mean"][part], num["m2"][part] = _moments(v, ok)
            num["lmean"][part], num["lm2"][part] = _moments(v, loss)
            num["lead"][part], num["inner"][part] = np.where(kept == 0, run, 0).max(1), np.where(kept > 0, run, 0).max(1)
            row, top, low = _dips(cum)
            dips.append((part[row], top, low))
    row, top, low = (np.concatenate([d[i] for d in dips]) if dips else np.zeros(0) for i in range(3))
    sort = np.argsort(row, kind="stable")
    depth = _lists(np.bincount(row.astype(int), minlength=k), top=top[sort], low=low[sort])
    have = ~np.isnan(r)
    r, of = r[have], seg[have]
    sort = np.lexsort((r, of))
    r, of = r[sort], of[sort]
    first = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (of[1:] != of[:-1]))[:len(r)])
    shares = _lists(np.bincount(of[first], minlength=k), r=r[first], c=np.diff(np.append(first, len(r))).astype("int64"))
    return [pa.array(size.astype("int64")), *[pa.array(v) for v in num.values()], depth, shares]


def block_summaries(trades: DataFrame, keys: Sequence[str], order: str, block_rows: int) -> DataFrame:
    """One ``BLOCK`` row per key and block of ``block_rows`` positions: the trades are shuffled once and do not move again."""
    x = trades.withColumn("_blk", F.expr(f"{order} div {block_rows}")).groupBy(*keys, "_blk").agg(F.collect_list(F.struct(
        F.col(order).cast("long").alias("at"), F.col("pnl_dollars").cast("double").alias("pnl"), F.col("r_multiple").cast("double").alias("r"))).alias("_t"))
    names = [f.split()[0] for f in BLOCK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b["_t"].value_lengths().to_numpy(zero_copy_only=False)
            at, pnl, r = (f.to_numpy(zero_copy_only=False).astype(t) for f, t in zip(b["_t"].flatten().flatten(), ("i8", "f8", "f8")))
            cols = [c for c in b.schema.names if c != "_t"]
            yield pa.RecordBatch.from_arrays([*[b[c] for c in cols], *_summaries(pnl, r, at, size)], [*cols, *names])

    kinds = dict(x.dtypes)
    return x.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in (*keys, "_blk")], BLOCK]))


def bucket_metrics(trades: DataFrame, keys: Sequence[str], capital: float = 10000.0,
                   order: Sequence[str] = ("entry_bar",), block_rows: int | None = None) -> DataFrame:
    """Metrics of each trade bucket, from summaries of its blocks and what the blocks before each have earned."""
    keys, c = list(keys), F.col
    x = block_summaries(trades, keys, order[0], chunk_length(trades, block_rows))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumns({"_s": F.coalesce(F.sum("s").over(before), F.lit(0.0)), "_n": F.coalesce(F.sum("n").over(before), F.lit(0)),
                       "_mean": F.min(F.when(c("known") > 0, c("mean"))).over(whole), "_lmean": F.min(F.when(c("losses") > 0, c("lmean"))).over(whole)})
    # means around one of the blocks': equal trades stay without spread
    x = x.withColumns({"_m": F.max(c("_s") + c("m")).over(before), "_o": F.max(F.when(c("o") > 0, c("_n") + c("o"))).over(before),
                       "_mean": c("_mean") + F.sum(c("known") * (c("mean") - c("_mean"))).over(whole) / F.sum("known").over(whole),
                       "_lmean": c("_lmean") + F.sum(c("losses") * (c("lmean") - c("_lmean"))).over(whole) / F.sum("losses").over(whole)})
    start = capital + c("_s")
    drop = lambda d: (lambda peak: F.when(peak > 0, (peak - (start + d["low"])) / peak * 100))(F.greatest(F.lit(capital), capital + c("_m"), start + d["top"]))
    x = x.withColumns({"_dd": F.array_max(F.transform("dips", drop)), "_run": F.greatest(c("inner"), F.when(c("lead") > 0, c("_n") - F.coalesce("_o", F.lit(0)) + c("lead"))),
                       "_m2": c("m2") + c("known") * F.pow(c("mean") - c("_mean"), F.lit(2)), "_lm2": c("lm2") + c("losses") * F.pow(c("lmean") - c("_lmean"), F.lit(2))})
    sums = ("n", "wins", "losses", "known", "s", "gp", "gl", "_m2", "_lm2")
    # a block's sums stay with its first entry of r multiples
    x = x.select(*keys, "_mean", "_dd", "_run", *sums, F.posexplode_outer("rs").alias("_i", "_r"))
    first = F.coalesce(c("_i"), F.lit(0)) == 0
    agg = x.groupBy(*keys).agg(
        *[F.sum(F.when(first, c(v))).alias(v) for v in sums], F.max("_mean").alias("mean"), F.greatest(F.max("_dd"), F.lit(0.0)).alias("mdd"), F.max("_run").alias("streak"),
        (F.sum(c("_r.r") * c("_r.c")) / F.sum("_r.c")).alias("mr"), F.min("_r.r").alias("minr"),
        F.percentile("_r.r", F.lit(0.05), F.coalesce("_r.c", F.lit(0))).alias("p5r"))
    agg = agg.withColumns({"pnl": F.when(c("known") > 0, c("s")), "gl": F.abs("gl"), "sd": F.when(c("known") > 1, F.sqrt(c("_m2") / (c("known") - 1))),
                           "dsd": F.when(c("losses") > 1, F.sqrt(c("_lm2") / (c("losses") - 1)))})
    root = math.sqrt(252)
    pf = F.when(c("gl") > 0, c("gp") / c("gl")).when(c("gp") > 0, 10.0).otherwise(0.0)
    sharpe = F.when(c("sd") > 0, c("mean") / c("sd") * root).otherwise(0.0)
    sortino = (F.when(c("n") < 2, 0.0)
               .when(c("losses") >= 2, F.when(c("dsd") > 1e-10, c("mean") / c("dsd") * root).otherwise(0.0))
               .when(c("mean") > 0, sharpe * 1.5).otherwise(0.0))
    ret = c("pnl") / capital * 100
    return agg.select(
        *keys, c("n").alias("total_trades"), rnd(c("wins") / c("n") * 100, 2).alias("win_rate"),
        rnd(pf, 3).alias("profit_factor"), rnd("pnl", 2).alias("total_pnl"),
        rnd("gp", 2).alias("gross_profit"), rnd("gl", 2).alias("gross_loss"),
        rnd(ratio0(c("gp"), c("wins")), 2).alias("avg_win"), rnd(ratio0(c("gl"), c("losses")), 2).alias("avg_loss"),
        rnd(sharpe, 3).alias("sharpe_approx"), rnd("mdd", 2).alias("max_drawdown_pct"),
        rnd(ret, 2).alias("total_return_pct"), c("streak").cast("long").alias("max_consecutive_losses"),
        rnd(F.when(c("mdd") > 0, ret / c("mdd")).otherwise(0.0), 2).alias("calmar_ratio"),
        rnd("mr", 3).alias("mean_r"),
        rnd(F.when(c("n") >= 20, c("p5r")).otherwise(c("minr")), 3).alias("worst_5pct_r"),
        rnd(sortino, 3).alias("sortino_approx"),
    )


def candidate_regimes(bucketed: DataFrame, cand: Sequence[str] = CAND, cfg: sc.Config = sc.DEFAULT,
                      carry: Sequence[str] = ()) -> DataFrame:
    """Evidence: one row per candidate and regime with train and validation metrics side by side and scores.

    ``bucketed`` holds bucket metrics per candidate, regime and split.  A candidate has all four regimes; an absent
    bucket has zero trades.
    """
    cand = list(cand)
    part = {s: F.max(F.when(F.col("split") == s, F.struct(*METRICS))) for s in ("train", "val")}
    sides = bucketed.groupBy(*cand, *carry, "regime").agg(*[c.alias(f"_{s}") for s, c in part.items()])
    both = F.struct("_train", "_val")
    wide = sides.groupBy(*cand, *carry).agg(
        F.max(F.col("_train").isNotNull()).alias("_any"), *[F.max(F.when(F.col("regime") == r, both)).alias(r) for r in REGIMES])
    # a candidate has a train trade somewhere and then a row for every regime
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("regime"), F.col(f"{r}._train").alias("t"),
                                        F.col(f"{r}._val").alias("v")) for r in REGIMES]))
    x = wide.filter("_any").select(*cand, *carry, rows.alias("_r")).select(
        *cand, *carry, "_r.regime", *[F.col(f"_r.{s[0]}.{m}").alias(f"{s}_{m}") for s in ("train", "val") for m in METRICS])
    t, v = sc.bucket_to_full("train_"), sc.bucket_to_full("val_")
    short = {"trades": "total_trades", "pf": "profit_factor", "return": "total_return_pct", "dd": "max_drawdown_pct",
             "sharpe": "sharpe_approx", "win_rate": "win_rate"}
    flat = [F.coalesce(F.col(f"{s}_{m}"), F.lit(0)).alias(f"{s}_{k}") for s in ("train", "val") for k, m in short.items()]
    x = x.select(*cand, *carry, "regime", *flat, sc.selection(t, cfg).alias("_t"), sc.selection(v, cfg).alias("_v"))
    quality = sc.regime_score(F.col("_t"), F.col("_v"), F.col("train_trades"), F.col("val_trades"), cfg)
    return x.select(
        *[c for c in x.columns if c not in ("_t", "_v")], sc.finite(F.col("_t"), 0.0).alias("train_score"),
        sc.finite(F.col("_v"), 0.0).alias("val_score"), sc.finite(quality, -999.0).alias("quality_score"))


def to_wide(candidates: DataFrame, cand: Sequence[str] = CAND) -> DataFrame:
    """One row per candidate with regime-prefixed columns, the export layout."""
    values = [c for c in candidates.columns if c not in (*cand, "regime")]
    wide = candidates.groupBy(*cand).pivot("regime", list(REGIMES)).agg(*[F.first(v).alias(v) for v in values])
    return wide
