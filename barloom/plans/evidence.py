"""End-to-end plans: sales ledger to candidate evidence, rejection ledger and replicated pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import scoring as sc
from barloom.operators import buckets as bk
from barloom.operators import gates as gt
from barloom.session import cut_lineage
from barloom.sources.adapters import sales_ledger


def sales_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate evidence of the sales ledger."""
    trades = bk.split_trades(sales_ledger(spark, sf_dir))
    bucketed = bk.bucket_metrics(trades, [*bk.CAND, "regime", "split"])
    return bk.candidate_regimes(bucketed)


def sales_slot_index(candidates: DataFrame) -> DataFrame:
    """Slot index over every symbol and three timeframes; slots without evidence are pending."""
    have = candidates.groupBy("symbol", "timeframe").agg(
        F.count_distinct("strategy_name", "param_hash").alias("candidate_count"))
    symbols = candidates.select("symbol").distinct()
    grid = symbols.withColumn("timeframe", F.explode(F.array(*[F.lit(t) for t in ("H1", "H4", "D1")])))
    return grid.join(have, ["symbol", "timeframe"], "left").select(
        "symbol", "timeframe", F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"),
        F.when(F.col("candidate_count").isNull(), "pending").otherwise("complete").alias("status"))


def sales_rejections(spark: SparkSession, sf_dir: str, single: bool = False, with_index: bool = False) -> DataFrame:
    cand = sales_candidates(spark, sf_dir)
    if with_index:
        cand = cut_lineage(cand)  # evidence is a stage table: the index and the selection both read it
    slots = gt.slot_spine(sales_slot_index(cand)) if with_index else None
    return gt.materialise(cand, gt.all_presets(single), slots)


def sales_pool(spark: SparkSession, sf_dir: str, replications: int = 20) -> DataFrame:
    """Replicated candidate pool: the ledger cut into replications by supplier, one candidate per slot and strategy."""
    trades = bk.split_trades(sales_ledger(spark, sf_dir))
    trades = trades.withColumn("replication_id", F.pmod(F.col("l_suppkey"), F.lit(replications)).cast("int"))
    keys = ["replication_id", "symbol", "timeframe", "regime", "strategy_name"]
    b = bk.bucket_metrics(trades, [*keys, "split"])
    pick = lambda half, name: F.max(F.when(F.col("split") == half, F.col(name)))
    x = b.groupBy(*keys).agg(
        pick("train", "total_return_pct").alias("train_return_pct"), pick("train", "profit_factor").alias("train_profit_factor"),
        pick("train", "max_drawdown_pct").alias("train_drawdown_pct"), pick("val", "total_trades").alias("val_trades"),
        pick("val", "total_return_pct").alias("val_return_pct"), pick("val", "max_drawdown_pct").alias("val_drawdown_pct"),
        pick("val", "profit_factor").alias("val_profit_factor"), pick("val", "sharpe_approx").alias("val_sharpe"),
        pick("val", "win_rate").alias("val_win_rate"),
    ).filter(F.col("train_return_pct").isNotNull() & F.col("val_trades").isNotNull())
    c = F.col
    return x.withColumn("val_return_dd_ratio", sc.return_dd(c("val_return_pct"), c("val_drawdown_pct"), 0)).withColumn(
        "robustness_ratio", sc.rho(c("train_profit_factor"), c("val_profit_factor"), c("train_return_pct"),
                                   c("val_return_pct"), cap=2.0))
