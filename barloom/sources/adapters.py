"""Turn generic event and sales tables into bars and trade ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.rounding import rnd

from barloom.series import KEYS, TF_SECONDS, number_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks_to_bars(
    ticks: DataFrame, symbol: str, price: str, ts: str, tie: str, timeframe: str, volume: Column | None = None
) -> DataFrame:
    """OHLCV bars of one timeframe; partial aggregation runs before the shuffle on (symbol, window)."""
    width = f"{TF_SECONDS[timeframe]} seconds"
    at = F.struct(F.col(ts), F.col(tie))
    return (
        ticks.groupBy(F.col(symbol).alias("symbol"), F.window(ts, width).alias("_w"))
        .agg(
            F.min_by(price, at).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, at).alias("close"),
            (volume if volume is not None else F.count(F.lit(1)).cast("double")).alias("volume"),
        )
        .select("symbol", F.lit(timeframe).alias("timeframe"), F.col("_w.start").alias("ts"),
                "open", "high", "low", "close", "volume")
    )


def event_bars(spark: SparkSession, sf_dir: str, timeframe: str = "H1") -> DataFrame:
    """Bars of ``events``: symbol = event type, price = value."""
    return ticks_to_bars(table(spark, sf_dir, "events"), "event_type", "value", "ts", "event_id", timeframe)


def order_bars(spark: SparkSession, sf_dir: str, timeframe: str = "D1") -> DataFrame:
    """Daily bars of ``orders``: symbol = priority, price = total price."""
    return ticks_to_bars(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", "o_orderdate", "o_orderkey", timeframe)


def sales_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade ledger stand-in: one closed trade per sales line.

    symbol = supplier nation, timeframe from line status, regime from tax and return flag,
    strategy = brand, profit from price and discount.  ``entry_bar`` is the position within the slot; lines alike in day,
    order and number keep their order in the file.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nat = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    part = table(spark, sf_dir, "part").select(
        "p_partkey", "p_brand", F.substring(F.sha2(F.col("p_brand"), 256), 1, 16).alias("param_hash"))
    rows = (
        li.join(sup, li.l_suppkey == sup.s_suppkey)
        .join(nat, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(part, li.l_partkey == part.p_partkey)
        .select(
            F.col("n_name").alias("symbol"),
            F.when(F.col("l_linestatus") == "F", "H4").otherwise("D1").alias("timeframe"),
            F.when(F.col("l_tax") >= 0.07, "CHOP").when(F.col("l_returnflag") == "A", "TREND")
            .when(F.col("l_returnflag") == "N", "RANGE").otherwise("BREAKOUT").alias("regime"),
            F.col("p_brand").alias("strategy_name"),
            "param_hash",
            F.col("l_shipdate").alias("ts"),
            "l_orderkey", "l_linenumber", "l_suppkey", "_file", "_row",
            rnd(F.col("l_extendedprice") * (F.col("l_discount") - 0.05) / 10, 2).alias("pnl_dollars"),
            rnd((F.col("l_discount") - 0.05) * 100, 3).alias("r_multiple"),
        )
    )
    return number_rows(rows, KEYS, ["ts", "l_orderkey", "l_linenumber", "_file", "_row"], F.col("ts"),  # one sort per slot and day
                       name="entry_bar", total="slot_trades").drop("_file", "_row")
