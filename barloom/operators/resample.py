"""Resampling, split and alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.series import KEYS, TF_SECONDS, number_bars

# Bars needed per timeframe before a series is used; M5 series are exempt by default.
MIN_BARS = {"M5": 50000, "M15": 20000, "M30": 10000, "H1": 5000, "H4": 2000, "D1": 500}
SPLITS = ("train", "val")


def bin_start(ts: Column, timeframe: str) -> Column:
    """Start of the bin a bar belongs to; weekly bins are labelled with the Sunday that closes them."""
    if timeframe == "W1":
        day = F.to_date(ts)
        return F.date_add(day, F.pmod(F.lit(8) - F.dayofweek(day), F.lit(7)).cast("int")).cast("timestamp")
    secs = TF_SECONDS[timeframe]
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / secs) * secs)


def resample(bars: DataFrame, timeframe: str) -> DataFrame:
    """Bars of one symbol set to one higher timeframe: first, max, min, last, sum (and mean spread)."""
    return resample_all(bars, [timeframe])


def resample_all(bars: DataFrame, timeframes: list[str]) -> DataFrame:
    """All target timeframes in one scan and one shuffle on (symbol, timeframe, bin)."""
    if not timeframes:
        raise ValueError("no timeframe given")
    unknown = [t for t in timeframes if t not in TF_SECONDS]
    if unknown:
        raise ValueError(f"unknown timeframe: {unknown}")
    spread = "spread" in bars.columns
    bins = F.explode(F.array(*[
        F.struct(F.lit(t).alias("timeframe"), bin_start(F.col("ts"), t).alias("bin")) for t in timeframes
    ])).alias("b")
    cols = ["symbol", "ts", "open", "high", "low", "close", "volume"] + (["spread"] if spread else [])
    x = bars.select(*cols, bins)
    aggs = [
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"),
    ] + ([F.avg("spread").alias("spread")] if spread else [])
    kind = bars.schema["ts"].dataType
    out = x.groupBy("symbol", F.col("b.timeframe").alias("timeframe"), F.col("b.bin").cast(kind).alias("ts")).agg(*aggs)
    return out.dropna(subset=["open", "high", "low", "close"])


def bars_for(bars: DataFrame, timeframe: str, min_bars: dict | None = None, exempt: tuple = ("M5",)) -> DataFrame:
    """Resampled bars of the series that reach the minimum length."""
    need = (MIN_BARS if min_bars is None else min_bars).get(timeframe, 0)
    out = resample(bars, timeframe)
    if timeframe in exempt or need == 0:
        return out
    enough = out.groupBy(*KEYS).count().filter(F.col("count") >= need).select(*KEYS)
    return out.join(enough, list(KEYS), "left_semi")


def split_bounds(n: Column, train_pct: float = 80.0, overlap_pct: float = 10.0) -> tuple[Column, Column]:
    """(end of train, start of validation) for a series of n rows; both truncated towards zero."""
    return (n * F.lit(train_pct / 100.0)).cast("long"), (n * F.lit((train_pct - overlap_pct) / 100.0)).cast("long")


def assign_splits(numbered: DataFrame, train_pct: float = 80.0, overlap_pct: float = 10.0) -> DataFrame:
    """One row per split a bar belongs to; rows of the overlap appear twice.  ``split_bar`` restarts per split."""
    end, start = split_bounds(F.col("series_rows"), train_pct, overlap_pct)
    pos = F.col("bar_no")
    tags = F.array_compact(F.array(F.when(pos < end, F.lit("train")), F.when(pos >= start, F.lit("val"))))
    return (
        numbered.withColumn("split", F.explode(tags))
        .withColumn("split_bar", F.when(F.col("split") == "val", pos - start).otherwise(pos))
    )


def live_shift(f, name: str, out: str):
    """Value known at decision time: the previous bar's."""
    return f.put(**{out: f.lag(name)})


def timing_audit(trades: DataFrame) -> DataFrame:
    """Every trade, not a sample: entry exactly one bar after the signal and strictly later in time."""
    delay = F.coalesce(F.col("entry_bar") == F.col("signal_bar") + 1, F.lit(False))
    later = F.coalesce(F.col("entry_time") > F.col("signal_time"), F.lit(True))
    return trades.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("trades"),
        F.sum(F.when(delay, 0).otherwise(1)).alias("bad_delay"),
        F.sum(F.when(later, 0).otherwise(1)).alias("bad_order"),
        F.min((delay & later)).alias("ok"),
    )


def numbered(bars: DataFrame) -> DataFrame:
    return number_bars(bars)
