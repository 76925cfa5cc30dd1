"""Instrument specifications, price and size arithmetic as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col
FIELDS = {
    "pip_position": "int", "pip_value": "double", "spread_avg": "double", "min_lot": "double", "max_lot": "double",
    "commission_per_lot": "double", "swap_long": "double", "swap_short": "double", "tick_size": "double", "tick_value": "double",
    "contract_size": "double", "volume_step": "double", "stops_level": "int", "point": "double", "digits": "int",
}
# Field defaults, and the generic specification of an unknown symbol.
DEFAULT_FIELDS = {"pip_position": 4, "pip_value": 10.0, "spread_avg": 1.0, "min_lot": 0.01, "max_lot": 100.0,
                  "commission_per_lot": 7.0, "swap_long": 0.0, "swap_short": 0.0, "tick_size": 0.0, "tick_value": 0.0,
                  "contract_size": 100000.0, "volume_step": 0.01, "stops_level": 0, "point": 0.0, "digits": 5}
GENERIC = {**DEFAULT_FIELDS, "spread_avg": 2.0}
# Built-in instruments (symbol, pip position, pip value, spread, commission, swap long, swap short).
BUILT_IN = """
EURUSD 4 10 1.0 7 -6.5 1.2
GBPUSD 4 10 1.2 7 -5 0.8
AUDUSD 4 10 1.2 7 -4 0.5
NZDUSD 4 10 1.5 7 -3.5 0.3
USDJPY 2 9 1.0 7 8.5 -15
USDCAD 4 7.5 1.5 7 2.5 -8
USDCHF 4 11 1.5 7 5 -10
AUDNZD 4 6 2.5 8 -2 -1.5
EURGBP 4 12.5 1.5 7 -4 0.5
EURJPY 2 9 1.5 7 3 -10
GBPJPY 2 9 2 7 5 -12
USDBRL 4 2 50 15 15 -40
USDMXN 4 0.55 30 12 20 -45
USDPLN 4 2.5 25 10 3 -12
USDNOK 4 0.95 30 10 2 -10
USDSEK 4 0.95 30 10 2 -10
USDSGD 4 7.5 2 8 1.5 -6
USDTRY 4 0.035 100 20 50 -150
USDZAR 4 0.55 50 15 12 -35
EURZAR 4 0.55 70 15 10 -30
GBPZAR 4 0.55 80 15 12 -35
USDCNH 4 1.4 20 10 2 -10
EURCNH 4 1.4 10 10 2 -10
EURPLN 4 2.5 25 10 3 -12
EURNOK 4 0.95 30 10 2 -10
EURSEK 4 0.95 30 10 2 -10
GBPNOK 4 0.95 35 10 2 -12
GBPSEK 4 0.95 35 10 2 -12
EURTRY 4 0.035 120 20 45 -130
PLATINUM 2 1 8 5 -5 -3
PALLADIUM 2 1 8 5 -6 -4
EURMXN 4 0.55 140 12 20 -45
NOKJPY 2 9 2 8 -1 -2
XAUUSD 2 1 3 5 -8 -5
XAGUSD 3 5 2 5 -3 -2
XAUEUR 2 1 3 5 -8 -5
XAUGBP 2 1 3 5 -8 -5
XAUAUD 2 1 3 5 -8 -5
XAGEUR 3 5 2 5 -3 -2
XRX 3 1 5 5 0 0
XTIUSD 2 1 3 5 0 0
XBRUSD 2 1 3 5 0 0
XNGUSD 3 1 4 5 0 0
AUDJPY 2 9 2 7 -4 1
EURAUD 4 7 2 7 -4 0.5
EURCHF 4 11 2 7 -3 0.5
EURCAD 4 7.5 2 7 -4 0.5
EURNZD 4 6 3 7 -4 0.5
GBPAUD 4 7 2.5 7 -5 0.8
GBPCAD 4 7.5 2.5 7 -5 0.8
GBPCHF 4 11 2.5 7 -5 0.8
CADJPY 2 9 2 7 -2 0.5
NZDJPY 2 9 2 7 -2 0.5
AUDCAD 4 7.5 1.5 7 2.5 -8
AUDCHF 4 11 2 7 -3 0.5
CADCHF 4 11 2 7 -3 0.5
CHFJPY 2 9 1 7 8.5 -15
NZDCAD 4 7.5 1.5 7 2.5 -8
NZDCHF 4 11 2 7 -3 0.5
GBPNZD 4 6 3 7 -4 0.5
BTCUSD 2 1 20 0 0 0
ETHUSD 2 1 8 0 0 0
LTCUSD 2 1 15 0 0 0
SOLUSD 2 1 15 0 0 0
BCHUSD 2 1 20 0 0 0
DOGUSD 4 1 20 0 0 0
TRXUSD 4 1 15 0 0 0
XRPUSD 4 1 12 0 0 0
TONUSD 3 1 12 0 0 0
BTCETH 2 1 8 0 0 0
BTCXAU 2 1 10 0 0 0
US100 0 1 2 0 0 0
US30 0 1 3 0 0 0
DE30 0 1 2 0 0 0
EU50 0 1 2 0 0 0
UK100 0 1 2 0 0 0
JP225 0 1 8 0 0 0
US500 0 1 2 0 0 0
FR40 0 1 2 0 0 0
ES35 0 1 2 0 0 0
HK50 0 1 8 0 0 0
AU200 0 1 2 0 0 0
""".strip()


def normal_symbol(symbol: Column) -> Column:
    return F.upper(F.split(F.coalesce(symbol, F.lit("")), "[.#]")[0])


def built_in_specs(spark: SparkSession) -> DataFrame:
    rows = []
    for line in BUILT_IN.splitlines():
        name, pip, value, spread, fee, sl, ss = line.split()
        spec = {**DEFAULT_FIELDS, "pip_position": int(pip), "pip_value": float(value), "spread_avg": float(spread),
                "commission_per_lot": float(fee), "swap_long": float(sl), "swap_short": float(ss)}
        rows.append((name, *[spec[f] for f in FIELDS]))
    return spark.createDataFrame(rows, "key string, " + ", ".join(f"{f} {t}" for f, t in FIELDS.items()))


def broker_specs(raw: DataFrame) -> DataFrame:
    """Sanitise broker rows: zero or missing point, tick and pip fields fall back step by step."""
    pos = lambda c: F.when(C(c).cast("double") > 0, C(c).cast("double"))
    digits = F.coalesce(C("digits").cast("int"), F.lit(5))
    fine = digits.isin(3, 5)
    x = raw.select(
        C("symbol").alias("key"), digits.alias("digits"),
        F.coalesce(pos("point"), F.when(digits > 0, F.pow(F.lit(10.0), -digits)).otherwise(0.0001)).alias("point"),
        F.when(fine, digits - 1).otherwise(digits).alias("pip_position"),
        *[C(c).cast("double").alias(f"r_{c}") for c in ("pip_size", "tick_size", "tick_value", "pip_value", "spread", "contract_size",
                                                        "volume_min", "volume_max", "volume_step", "stops_level")])
    give = lambda c, d: F.coalesce(F.nullif(C(f"r_{c}"), F.lit(0.0)), F.lit(d))
    up = lambda c: F.when(C(f"r_{c}") > 0, C(f"r_{c}"))
    x = x.withColumn("pip_size", F.coalesce(up("pip_size"), F.when(C("digits").isin(3, 5), C("point") * 10).otherwise(C("point"))))
    x = x.withColumn("tick_size", F.coalesce(up("tick_size"), C("point"))).withColumn("tick_value", give("tick_value", 0.0))
    inferred = F.when((C("tick_size") > 0) & (C("tick_value") > 0), C("pip_size") / C("tick_size") * C("tick_value")).otherwise(10.0)
    return x.select(
        "key", "pip_position", F.coalesce(up("pip_value"), inferred).alias("pip_value"),
        (give("spread", 2.0) * C("point") / C("pip_size")).alias("spread_avg"), give("volume_min", 0.01).alias("min_lot"),
        give("volume_max", 100.0).alias("max_lot"), F.lit(7.0).alias("commission_per_lot"), F.lit(0.0).alias("swap_long"),
        F.lit(0.0).alias("swap_short"), "tick_size", "tick_value", give("contract_size", 0.0).alias("contract_size"),
        give("volume_step", 0.01).alias("volume_step"), give("stops_level", 0.0).cast("int").alias("stops_level"), "point", "digits")


def derive(specs: DataFrame) -> DataFrame:
    """Point, tick size and tick value that were left at zero."""
    point = F.when(C("point") == 0, F.when(C("digits") > 0, F.pow(F.lit(10.0), -C("digits"))).otherwise(
        F.pow(F.lit(10.0), -C("pip_position")))).otherwise(C("point"))
    x = specs.withColumn("point", point)
    x = x.withColumn("tick_size", F.when(C("tick_size") == 0, C("point")).otherwise(C("tick_size")))
    return x.withColumn("tick_value", F.when(
        C("tick_value") == 0, C("pip_value") * (C("tick_size") / pip_size(C("pip_position")))).otherwise(C("tick_value")))


def config_specs(config: DataFrame, parents: DataFrame, defaults: Mapping[str, float] = {}) -> DataFrame:
    """Configured rows (null = not given): own value, then configured default, then the parent's, then the field default.

    Two passes like the source configuration: rows without a parent first, then the rows that inherit from them, a
    broker row or a built-in.
    """
    cfg = config.withColumn("key", normal_symbol(C("symbol"))).withColumn("parent", normal_symbol(C("inherit")))
    dflt = lambda f: [F.lit(defaults[f]).cast(FIELDS[f])] if f in defaults else []
    guess = F.when(C("digits").isNotNull(), F.when(C("digits").isin(3, 5), C("digits") - 1).otherwise(C("digits")))

    def build(x: DataFrame, parent: bool) -> DataFrame:
        def pick(f: str) -> Column:
            own = [C(f).cast(FIELDS[f]), *dflt(f)] + ([C(f"p_{f}")] if parent else [])
            if f == "pip_position":
                own.append(guess.cast("int"))
            return F.coalesce(*own, F.lit(DEFAULT_FIELDS[f]).cast(FIELDS[f])).alias(f)
        return x.select("key", *[pick(f) for f in FIELDS])

    first = derive(build(cfg.filter(C("inherit").isNull()), False))
    # priority of parents: configured, then broker or built-in
    pool = first.select("key", *FIELDS).withColumn("pr", F.lit(0)).unionByName(parents.select("key", *FIELDS).withColumn("pr", F.lit(1)))
    best = pool.groupBy("key").agg(F.min_by(F.struct(*FIELDS), "pr").alias("p"))
    best = best.select(C("key").alias("parent"), *[C(f"p.{f}").alias(f"p_{f}") for f in FIELDS])
    second = derive(build(cfg.filter(C("inherit").isNotNull()).join(best, "parent", "left"), True))
    return first.unionByName(second)


def resolve_specs(symbols: DataFrame, config: DataFrame, broker: DataFrame, built_in: DataFrame,
                  defaults: Mapping[str, float] = {}) -> DataFrame:
    """Specification of each symbol: configured, broker, built-in, generic; configured defaults skip broker rows.

    The three sources are configuration tables of a few hundred rows; Spark broadcasts them below its size limit.
    """
    x = symbols.withColumn("key", normal_symbol(C("symbol")))
    for tag, t in (("c", config), ("b", broker), ("h", built_in)):
        x = x.join(t.select("key", F.struct(*FIELDS).alias(f"_{tag}")), "key", "left")
    source = (F.when(C("_c").isNotNull(), "config").when(C("_b").isNotNull(), "broker").when(C("_h").isNotNull(), "built_in")
              .otherwise("generic"))

    def pick(f: str) -> Column:
        plain = F.coalesce(C(f"_c.{f}"), C(f"_b.{f}"), C(f"_h.{f}"), F.lit(GENERIC[f]).cast(FIELDS[f]))
        return F.when(source == "broker", plain).otherwise(F.lit(defaults[f]).cast(FIELDS[f])).alias(f) if f in defaults else plain.alias(f)

    return derive(x.select("symbol", source.alias("spec_source"), *[pick(f) for f in FIELDS]))


# ---- price and size --------------------------------------------------------------------------------------------------

def pip_size(pip_position: Column) -> Column:
    return F.pow(F.lit(10.0), -pip_position)


def half_spread() -> Column:
    return C("spread_avg") / 2.0 * pip_size(C("pip_position"))


def entry_price(mid: Column, is_long: Column, slippage_pips: float = 0.0) -> Column:
    """Ask for longs, bid for shorts; the position layer adds slippage, the ledger does not."""
    away = half_spread() + slippage_pips * pip_size(C("pip_position"))
    return F.when(is_long, mid + away).otherwise(mid - away)


def exit_price(mid: Column, is_long: Column) -> Column:
    return F.when(is_long, mid - half_spread()).otherwise(mid + half_spread())


def pips(a: Column, b: Column, is_long: Column) -> Column:
    """Profit from a to b in pips."""
    return F.when(is_long, b - a).otherwise(a - b) / pip_size(C("pip_position"))


def tick_profit(entry: Column, exit_: Column, volume: Column, is_long: Column) -> Column:
    by_tick = F.when(is_long, exit_ - entry).otherwise(entry - exit_) / C("tick_size") * C("tick_value") * volume
    return F.when((C("tick_size") > 0) & (C("tick_value") > 0), by_tick).otherwise(
        pips(entry, exit_, is_long) * volume * C("pip_value"))


def loss_at_stop(entry: Column, stop: Column, volume: Column, is_long: Column) -> Column:
    return F.abs(tick_profit(entry, stop, volume, is_long))


def _step() -> Column:
    return F.when(C("volume_step") > 0, C("volume_step")).otherwise(0.01)


def round_volume(volume: Column) -> Column:
    """Floor to the step, then clamp into the lot range."""
    stepped = F.floor(volume / _step()) * _step()
    return F.greatest(C("min_lot"), F.least(C("max_lot"), stepped))


def min_stop_distance() -> Column:
    return F.when((C("stops_level") > 0) & (C("point") > 0), C("stops_level") * C("point")).otherwise(0.0)


def atr_stops(atr: Column, sl_mult: Column | float, tp_mult: Column | float) -> tuple[Column, Column]:
    """Stop and target distances in pips with their floors; null while the ATR is unknown."""
    a = atr / pip_size(C("pip_position"))
    guard = lambda x: F.when(atr.isNotNull(), x)
    return guard(F.greatest(F.lit(5.0), a * sl_mult)), guard(F.greatest(F.lit(10.0), a * tp_mult))


def stop_prices(entry: Column, sl_pips: Column, tp_pips: Column, is_long: Column) -> tuple[Column, Column]:
    size = pip_size(C("pip_position"))
    sl, tp = sl_pips * size, tp_pips * size
    return F.when(is_long, entry - sl).otherwise(entry + sl), F.when(is_long, entry + tp).otherwise(entry - tp)


def position_size(equity: Column, sl_pips: Column, risk_pct: float = 1.0, min_size: float = 0.01, max_size: float = 0.0) -> Column:
    """Risk-based lots; zero, not the least lot, when the risk does not carry the least lot."""
    risk = equity * (risk_pct / 100.0)
    per_lot = sl_pips * pip_size(C("pip_position")) / C("tick_size") * C("tick_value")
    raw = (F.when((C("tick_value") > 0) & (C("tick_size") > 0) & (sl_pips > 0), F.when(per_lot > 0, risk / per_lot).otherwise(min_size))
           .when((C("pip_value") > 0) & (sl_pips > 0), risk / (sl_pips * C("pip_value"))).otherwise(min_size))
    capped = F.least(C("max_lot"), raw)
    if max_size > 0:
        capped = F.least(F.lit(max_size), capped)
    stepped = F.floor(F.greatest(F.lit(min_size), capped) / _step()) * _step()
    return F.when(raw < C("min_lot"), 0.0).when(stepped < C("min_lot"), 0.0).otherwise(stepped)


def close_pnl(entry: Column, exit_: Column, volume: Column, is_long: Column) -> tuple[Column, Column]:
    """Pips and money of a closed position, pip based and without commission."""
    p = pips(entry, exit_, is_long)
    return p, p * volume * C("pip_value")
