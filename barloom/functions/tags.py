"""Identifiers: magic numbers, short codes, seeds, hashes and trade tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def magic(symbol: Column, timeframe: Column, regime: Column) -> Column:
    return F.crc32(F.concat_ws("|", symbol, timeframe, regime)).bitwiseAND(2147483647)


def strategy_code(name: Column) -> Column:
    """Last five base-36 digits of the CRC, left padded with zeros."""
    return F.lpad(F.right(F.lower(F.conv(F.crc32(name).cast("string"), 10, 36)), F.lit(5)), 5, "0")


def slot_seed(dataset: Column, symbol: Column, timeframe: Column, strategy: Column, version: int = 1) -> Column:
    text = F.concat_ws("|", dataset, symbol, timeframe, strategy, F.lit(str(version)))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long").bitwiseAND(2147483647)


def hash16(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *parts), 256)


def direction_code(direction: Column) -> Column:
    return F.substring(F.upper(direction), 1, 1)


def encode_tag(symbol: Column, timeframe: Column, strategy: Column, direction: Column, risk_pct: Column, tier: Column) -> Column:
    """Newest form with a risk, the middle form with risk and tier, the plain form without."""
    tenths = F.rint(risk_pct * 10.0).cast("long").cast("string")
    code = strategy_code(strategy)
    return (F.when(risk_pct.isNotNull() & tier.isNotNull(),
                   F.concat_ws(":", F.lit("PM2"), symbol, timeframe, code, direction_code(direction), tier.cast("string"), tenths))
            .when(risk_pct.isNotNull(), F.concat_ws(":", F.lit("PM3"), symbol, timeframe, code, direction_code(direction), tenths))
            .otherwise(F.concat_ws(":", F.lit("PM"), symbol, timeframe, strategy, F.upper(direction))))


def normal_direction(raw: Column) -> Column:
    d = F.upper(F.trim(raw))
    return (F.when(d.isin("L", "LONG", "BUY", "1"), "LONG").when(d.isin("S", "SHORT", "SELL", "-1"), "SHORT")
            .when(d != "", d))


def decode_tag(comment: Column) -> Column:
    """Struct of what a tag carries; null when it is not a tag."""
    p = F.split(comment, ":", -1)
    n = F.size(p)
    at = lambda i: F.get(p, F.lit(i))
    compact = p[0].isin("PM2", "PM3") & (n >= 4)
    plain = (p[0] == "PM") & (n >= 5)
    old = comment.startswith("PM_") & (F.trim(F.substring(comment, 4, 10000)) != "")
    third = p[0] == "PM3"
    risk = F.when(n >= 7, at(6)).when((n == 6) & third, at(5))
    tier = F.when(n >= 7, at(5)).when((n == 6) & ~third, at(5))
    pct = F.when(risk.contains("."), risk.try_cast("double")).otherwise(risk.try_cast("int").cast("double") / 10.0)
    return F.when(compact, F.struct(
        at(1).alias("symbol"), at(2).alias("timeframe"), at(3).alias("strategy_code"), F.lit(None).cast("string").alias("strategy_name"),
        F.lit(None).cast("string").alias("strategy_tag"), F.when(n >= 5, normal_direction(at(4))).alias("direction"),
        tier.try_cast("int").alias("tier"), pct.alias("risk_pct"),
    )).when(plain, F.struct(
        at(1).alias("symbol"), at(2).alias("timeframe"), F.lit(None).cast("string").alias("strategy_code"), at(3).alias("strategy_name"),
        F.lit(None).cast("string").alias("strategy_tag"), F.coalesce(normal_direction(at(4)), at(4)).alias("direction"),
        F.lit(None).cast("int").alias("tier"), F.lit(None).cast("double").alias("risk_pct"),
    )).when(old, F.struct(
        F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("string").alias("timeframe"),
        F.lit(None).cast("string").alias("strategy_code"), F.lit(None).cast("string").alias("strategy_name"),
        F.trim(F.substring(comment, 4, 10000)).alias("strategy_tag"), F.lit(None).cast("string").alias("direction"),
        F.lit(None).cast("int").alias("tier"), F.lit(None).cast("double").alias("risk_pct"),
    ))
