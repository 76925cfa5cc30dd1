"""Rules about legs and zones as tables: each leg or zone is an interval row that meets the bars it is live for.

A leg begins at a pivot and lasts until the next one, so the bars of a leg are a group and its pullback is one fold over the few bars that
matter.  A zone lives for at most ``ZONE_LIFE`` bars after its birth, so bars and zones meet in buckets of bar numbers; what ends a zone by itself is a window over
its own bars, and what drops it early is a count of the younger zones that are still listed.  No group holds more than a leg or a zone's life.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.series import KEYS, UNB
from barloom.strategies.base import BREAKOUT, TREND, Strategy, register

C = F.col
# Retracement band of each entry set, and the zone limits.
RETRACE = {"38_50": (0.382, 0.500), "50_618": (0.500, 0.618), "382_618": (0.382, 0.618), "50_only": (0.480, 0.520)}
DEEP_RETRACE = 0.786
ZONE_LIFE, ORIGIN_ZONES = 200, 15
#: Bars of a bucket in which zones and bars meet; a zone falls in two.
BUCKET = 256


def _known(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def _leg(side: int, begin: Column, end: Column, near: float, far: float, deep: bool) -> Column:
    size = end - begin
    stop = end - DEEP_RETRACE * size if deep else begin
    return F.struct(C("bar_no").alias("bar"), F.lit(side).alias("side"), (end - near * size).alias("upper"), (end - far * size).alias("lower"), stop.alias("stop"))


def _pullback(bars: Column, patience: int) -> Column:
    """Bar at which a leg fires, from its bars (bar_no, dead, inside, out, ok) in order."""
    def step(acc: Column, x: Column) -> Column:
        since = F.when(acc["since"] >= 0, acc["since"]).otherwise(x["bar_no"])
        timely = x["bar_no"] - since <= patience
        idle, none = F.lit(-1).cast("long"), F.lit(None).cast("long")

        def to(since_: Column, fired: Column, over: bool) -> Column:
            return F.struct(since_.alias("since"), fired.alias("fired"), F.lit(over).alias("over"))

        inside = F.when(timely & x["ok"], to(idle, x["bar_no"], True)).when(timely, to(since, none, False)).otherwise(to(idle, none, False))
        return (F.when(acc["over"], acc).when(x["dead"], to(idle, none, True)).when(x["inside"], inside)
                .when(x["out"], to(idle, none, False)).otherwise(acc))

    start = F.struct(F.lit(-1).cast("long").alias("since"), F.lit(None).cast("long").alias("fired"), F.lit(False).alias("over"))
    return F.aggregate(bars, start, step)["fired"]


def retracement(f, prm: dict):
    """Impulse leg between confirmed pivots; a pullback into the retracement band that closes back out fires once."""
    order, patience = prm["swing_order"], prm["max_pullback_bars"]
    near, far = RETRACE.get(prm["fib_entry_set"], RETRACE["50_618"])
    deep = prm["invalidation_mode"] == "below_786"
    name = f.own_name
    live = C("bar_no") >= order * 4 + patience + 20
    for n in ("H", "L"):
        f.need(f"PIVOT{n}_{order}")
        f.put(**{name(f"p{n}"): F.when(live, _known(C(f"PIVOT{n}_{order}")))})
        f.ffill(name(f"last{n}"), name(f"p{n}"))
    f.need("ATR_14")
    atr = F.coalesce(_known(C("ATR_14")), F.lit(0.0))
    ph, pl = C(name("pH")), C(name("pL"))
    low_before, high_now = f.lag(name("lastL")), C(name("lastH"))
    least = prm["min_impulse_atr"] * atr
    down = (atr > 0) & (high_now - pl > least)
    up = (atr > 0) & (ph - low_before > least)
    f.put(**{name("fresh"): F.when(down, _leg(-1, high_now, pl, near, far, deep)).when(up, _leg(1, low_before, ph, near, far, deep))})
    f.ffill(name("leg"), name("fresh"))
    cols = [name("leg"), f.own_name("before_high"), f.own_name("before_low")]
    f.put(**{cols[1]: f.lag("high"), cols[2]: f.lag("low")})

    def run(bars: DataFrame) -> DataFrame:
        leg = C(cols[0])
        d = leg["side"]
        x = bars.filter(leg["bar"] < C("bar_no"))
        reach = F.when(d == 1, C("low")).otherwise(C("high"))
        out = d * (C("close") - leg["upper"]) > 0
        ok = out
        if prm["confirmation_mode"] == "engulfing_like":
            ok = F.when(d == 1, (C("close") > C("open")) & (C("close") > C(cols[1]))).otherwise((C("close") < C("open")) & (C("close") < C(cols[2])))
        x = x.select(*KEYS, leg["bar"].alias("leg"), d.alias("side"), F.struct(
            "bar_no", (d * (C("close") - leg["stop"]) < 0).alias("dead"),
            ((d * (reach - leg["upper"]) <= 0) & (d * (C("close") - leg["lower"]) >= 0)).alias("inside"), out.alias("out"), F.coalesce(ok, F.lit(False)).alias("ok")).alias("x"))
        x = x.filter("x.dead OR x.inside OR x.out").groupBy(*KEYS, "leg", "side").agg(F.sort_array(F.collect_list("x")).alias("xs"))
        return x.select(*KEYS, _pullback(C("xs"), patience).alias("bar_no"), C("side").alias("signal")).filter("bar_no IS NOT NULL")

    return cols, run


def _bucket(bar: Column) -> Column:
    return F.floor(bar / BUCKET)


def _lives(zones: DataFrame, bars: DataFrame, width: float, cap: int, strength: float) -> DataFrame:
    """(keys, born, side, bar_no, fires, ends) for each bar at which a zone is live by itself."""
    spread = zones.select(*KEYS, "born", "side", C("low").alias("zl"), C("high").alias("zh"),
                          F.explode(F.sequence(_bucket(C("born")), _bucket(C("born") + ZONE_LIFE))).alias("_b"))
    x = spread.join(bars.withColumn("_b", _bucket(C("bar_no"))), [*KEYS, "_b"]).filter(C("bar_no").between(C("born"), C("born") + ZONE_LIFE))
    up = C("side") == 1
    back = F.when(up, (C("low") <= C("zh")) & (C("close") > C("zl"))).otherwise((C("high") >= C("zl")) & (C("close") < C("zh")))
    at = F.when(up, C("close") - C("low")).otherwise(C("high") - C("close")) / (C("high") - C("low") + 1e-10)
    x = x.withColumns({"back": back, "fires": back & (at >= strength),
                       "broke": F.when(up, C("close") < C("zl") - width * C("atr")).otherwise(C("close") > C("zh") + width * C("atr"))})
    of = Window.partitionBy(*KEYS, "born").orderBy("bar_no").rowsBetween(UNB, -1)
    x = x.withColumns({"before": F.coalesce(F.count_if("back").over(of), F.lit(0)), "over": F.coalesce(F.bool_or(C("fires") | C("broke")).over(of), F.lit(False))})
    ends = C("fires") | C("broke") | (C("before") + C("back").cast("int") >= cap)
    return x.filter((C("before") < cap) & ~C("over")).select(*KEYS, "born", "side", "bar_no", "fires", ends.alias("ends"))


def _dropped(zones: DataFrame) -> DataFrame:
    """(keys, born, dropped): birth that pushed a zone off the list of the youngest ORIGIN_ZONES.

    ``zones``: born, seen (the usable bar before it), death (null: of age).  A zone is listed at a birth if it had not ended before ``seen``.
    """
    y = zones.select(*KEYS, C("born").alias("y"), C("seen").alias("ys"), C("death").alias("yd"))
    y = y.withColumn("_b", F.explode(F.sequence(_bucket(C("y") - ZONE_LIFE - 1), _bucket(C("y")))))
    met = zones.withColumn("_b", _bucket(C("born"))).join(y, [*KEYS, "_b"]).filter((C("y") > C("born")) & (C("ys") <= C("born") + ZONE_LIFE) & (C("death").isNull() | (C("death") >= C("ys"))))
    # as the births after a zone that find it listed, each with the births between that are listed then
    far = zones.select(*KEYS, C("born").alias("w"), C("death").alias("wd")).withColumn("_b", F.explode(F.sequence(_bucket(C("w")), _bucket(C("w") + ZONE_LIFE + 1))))
    between = met.select(*KEYS, "born", "y", "ys", _bucket(C("y")).alias("_b")).join(far, [*KEYS, "_b"]).filter(
        (C("w") > C("born")) & ((C("w") == C("y")) | ((C("w") < C("y")) & (C("ys") <= C("w") + ZONE_LIFE) & (C("wd").isNull() | (C("wd") >= C("ys"))))))
    n = between.groupBy(*KEYS, "born", "y").agg(F.count(F.lit(1)).alias("n")).filter(C("n") >= ORIGIN_ZONES)
    return n.groupBy(*KEYS, "born").agg(F.min("y").alias("dropped"))


def origin_zones(f, prm: dict):
    """The tight base before an impulse bar becomes a zone; a return that closes strongly away from it fires."""
    base, width = prm["base_lookback"], prm["zone_width_atr"]
    name = f.own_name
    f.need("ATR_14")
    usable = (C("bar_no") >= base + 30) & (F.coalesce(_known(C("ATR_14")), F.lit(0.0)) > 0)
    f.need(f"LL_{base}"), f.need(f"HH_{base}")
    cols = [name(n) for n in ("usable", "base_low", "base_high", "seen")]
    f.put(**{cols[0]: F.when(usable, C("bar_no")), cols[1]: f.lag(f"LL_{base}"), cols[2]: f.lag(f"HH_{base}")})
    f.ffill(name("last_usable"), cols[0])
    f.put(**{cols[3]: f.lag(name("last_usable"))})

    def run(bars: DataFrame) -> DataFrame:
        x = bars.filter(C(cols[0]).isNotNull())
        slim = x.select(*KEYS, "bar_no", "high", "low", "close", C("ATR_14").alias("atr"))
        push = C("close") - C("open")
        tight = C(cols[2]) - C(cols[1]) <= width * C("ATR_14") * 3
        zones = x.filter((F.abs(push) > prm["impulse_body_atr"] * C("ATR_14")) & (push != 0) & tight).select(
            *KEYS, C("bar_no").alias("born"), F.coalesce(C(cols[3]), C("bar_no") - 1).alias("seen"), C(cols[1]).alias("low"), C(cols[2]).alias("high"), F.signum(push).cast("int").alias("side"))
        lives = _lives(zones, slim, width, prm["max_zone_touches"], prm["confirmation_close_pos"])
        deaths = lives.filter("ends").groupBy(*KEYS, "born").agg(F.min("bar_no").alias("death"))
        dropped = _dropped(zones.join(deaths, [*KEYS, "born"], "left"))
        fired = lives.filter("fires").join(dropped, [*KEYS, "born"], "left").filter("dropped IS NULL OR bar_no < dropped")
        return fired.groupBy(*KEYS, "bar_no").agg(F.max_by("side", "born").alias("signal"))

    return ["ATR_14", *cols], run


def _rule(name, category, defaults, grid, events):
    register(Strategy(name, category, {**defaults, "sl_atr_mult": 2.0, "tp_atr_mult": 3.0}, grid, events=events))


_rule("FibonacciRetracementPullbackStrategy", TREND,
      {"swing_order": 5, "min_impulse_atr": 1.5, "fib_entry_set": "50_618", "confirmation_mode": "close_back", "max_pullback_bars": 5, "invalidation_mode": "below_786"},
      {"swing_order": [3, 5, 7], "min_impulse_atr": [1.0, 1.5, 2.0], "fib_entry_set": ["38_50", "50_618", "382_618", "50_only"],
       "confirmation_mode": ["close_back", "engulfing_like"], "max_pullback_bars": [3, 5, 8], "invalidation_mode": ["below_786", "below_swing_start"]}, retracement)
_rule("SupplyDemandImpulseRetestStrategy", BREAKOUT,
      {"impulse_body_atr": 1.5, "base_lookback": 5, "zone_width_atr": 0.4, "max_zone_touches": 2, "confirmation_close_pos": 0.65},
      {"impulse_body_atr": [1.0, 1.2, 1.5, 1.8, 2.2], "base_lookback": [3, 5, 8, 12], "zone_width_atr": [0.25, 0.4, 0.6, 0.8],
       "max_zone_touches": [1, 2, 3], "confirmation_close_pos": [0.55, 0.65, 0.75]}, origin_zones)
