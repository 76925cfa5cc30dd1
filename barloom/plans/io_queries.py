"""Registered queries over ingest, resampling, specifications, tags and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import instruments as ins
from barloom.functions import tags
from barloom.functions.rounding import rnd
from barloom.operators import buckets as bk
from barloom.operators import gates as gt
from barloom.operators import ledger as lg
from barloom.operators import resample as rs
from barloom.plans import evidence as ev
from barloom.series import number_bars
from barloom.session import cut_lineage
from barloom.sources import files as fl
from barloom.sources.adapters import event_bars, order_bars, table
from barloom.strategies.base import clean_signal

C = F.col
OHLC = ("open", "high", "low", "close", "volume")


def _raw(s, d) -> DataFrame:
    """Event bars in the shape of a foreign file: odd names, text numbers, some unreadable or contradictory prices."""
    b = event_bars(s, d)
    k = F.unix_timestamp("ts") / 3600
    bad = (k % 17).cast("int")
    return b.select("symbol", "timeframe", C("ts").cast("string").alias("Time"), C("open").cast("string").alias("OPEN"),
                    F.when(bad == 3, "n/a").otherwise(C("high").cast("string")).alias("High"),
                    F.when(bad == 5, (C("high") + 1).cast("string")).otherwise(C("low").cast("string")).alias("low"),
                    F.when(bad == 7, None).otherwise(C("close").cast("string")).alias("Close"),
                    F.when(bad == 9, None).otherwise(C("volume")).alias("Volume"), (C("volume") * 2).alias("tick_volume"))


def _clean(s, d):
    return fl.clean_bars(fl.parse_time(fl.standardise(_raw(s, d)))).select("symbol", "ts", *OHLC)


def _quality(s, d):
    return fl.bar_quality(fl.standardise(_raw(s, d))).drop("timeframe")


def _discover(s, d):
    out = s.createDataFrame([("error",)], "symbol string")
    return fl.discover(event_bars(s, d), out, 10)


def _inventory(s, d):
    return fl.inventory(s, f"{d}/*.parquet").drop("folder")


def _verify(s, d):
    """A manifest with one wrong digest and one file that is gone."""
    now = fl.inventory(s, f"{d}/*.parquet")
    man = now.withColumn("sha256", F.when(C("file").startswith("nation"), "0").otherwise(C("sha256")))
    return fl.verify(man.withColumn("file", F.when(C("file").startswith("region"), "gone.parquet").otherwise(C("file"))), now)


def _min_bars(s, d):
    """Daily bars of the order series that are long enough; the limit lets four of five pass at any scale."""
    x = rs.bars_for(order_bars(s, d), "D1", {"D1": 500})
    return x.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"))


def _resampled(tfs):
    def run(s, d):
        x = rs.resample_all(event_bars(s, d, "M5"), tfs)
        return x.select("symbol", "timeframe", "ts", *OHLC)
    return run


def _splits(s, d):
    x = rs.assign_splits(number_bars(event_bars(s, d)))
    return x.select("symbol", "bar_no", "split", "split_bar")


def _live(s, d):
    from barloom.functions.indicators import Frame
    f = Frame.of(event_bars(s, d))
    return rs.live_shift(f, "close", "close_live").own().select("symbol", "ts", "close_live")


SYMBOLS = ["EURUSD", "usdjpy.x", "XAUUSD", "GBPJPY#m", "ABCXYZ", "US100", "NEWFX", "BTCUSD"]
DEFAULTS = {"commission_per_lot": 6.5}


def quotes(s, d) -> DataFrame:
    """One position idea per order: symbol, mid price, side, stop and target distance, volume and equity."""
    names = F.array(*[F.lit(x) for x in SYMBOLS])
    return table(s, d, "orders").select(
        C("o_orderkey").alias("trade_id"), F.get(names, (C("o_custkey") % len(SYMBOLS)).cast("int")).alias("symbol"),
        (C("o_totalprice") / 100000).alias("mid"), (C("o_orderkey") % 2 == 0).alias("is_long"),
        (5.0 + C("o_custkey") % 50).alias("sl_pips"), (10.0 + C("o_custkey") % 70).alias("tp_pips"),
        (C("o_orderkey") % 12345 / 100.0).alias("volume"), (500 + C("o_totalprice") / 10).alias("equity"))


def _config(s):
    cols = "symbol string, inherit string, " + ", ".join(f"{f} {t}" for f, t in ins.FIELDS.items())
    blank = dict.fromkeys(ins.FIELDS)
    rows = [("NEWFX", None, {"pip_value": 2.5, "spread_avg": 1.7, "digits": 3}), ("GBPJPY", "USDJPY", {"spread_avg": 3.3}), ("CHILD", "NEWFX", {"min_lot": 0.1})]
    return s.createDataFrame([(n, p, *{**blank, **v}.values()) for n, p, v in rows], cols)


def _broker(s):
    raw = s.createDataFrame([("XAUUSD", 2, 0.0, 0.0, 0.0, 1.0, 0.0, 25.0, 100.0, 0.0, 50.0, 0.1, 10.0), ("BTCUSD", 3, 0.001, 0.0, 0.001, 0.0, 0.0, 0.0, 1.0, 0.01, 5.0, 0.01, 0.0)],
                            "symbol string, digits int, point double, pip_size double, tick_size double, tick_value double, pip_value double, spread double, "
                            "contract_size double, volume_min double, volume_max double, volume_step double, stops_level double")
    return ins.broker_specs(raw)


def specs(s, symbols: DataFrame) -> DataFrame:
    base, broker = ins.built_in_specs(s), _broker(s)
    cfg = ins.config_specs(_config(s), broker.unionByName(base.join(broker, "key", "left_anti")), DEFAULTS)
    return ins.resolve_specs(symbols, cfg, broker, ins.derive(base), DEFAULTS)


def priced(s, d) -> DataFrame:
    """Quotes with the specification of their symbol; the specification table has one row per symbol."""
    q = quotes(s, d)
    return q.join(specs(s, q.select("symbol").distinct()), "symbol")


def _specs(s, d):
    x = specs(s, quotes(s, d).select("symbol").distinct())
    return x.select("symbol", "spec_source", *[rnd(f, 8).alias(f) if t == "double" else C(f) for f, t in ins.FIELDS.items()])


def _inherit(s, d):
    """Configured specifications, met with how often their symbol is quoted."""
    base, broker = ins.built_in_specs(s), _broker(s)
    cfg = ins.config_specs(_config(s), broker.unionByName(base.join(broker, "key", "left_anti")), DEFAULTS)
    n = quotes(s, d).groupBy(ins.normal_symbol(C("symbol")).alias("key")).agg(F.count(F.lit(1)).alias("quotes"))
    return cfg.join(n, "key", "left").select("key", "pip_position", "pip_value", "spread_avg", "min_lot", "commission_per_lot", "digits", "quotes")


def _prices(s, d):
    x = priced(s, d)
    e = ins.entry_price(C("mid"), C("is_long"))
    sl, tp = ins.stop_prices(C("entry"), C("sl_pips"), C("tp_pips"), C("is_long"))
    x = x.withColumn("entry", e).withColumns({"stop": sl, "target": tp, "entry_slipped": ins.entry_price(C("mid"), C("is_long"), 0.5),
                                             "exit": ins.exit_price(C("mid") * 1.01, C("is_long"))})
    p, usd = ins.close_pnl(C("entry"), C("exit"), C("volume"), C("is_long"))
    x = x.withColumns({"tick_profit": ins.tick_profit(C("entry"), C("exit"), C("volume"), C("is_long")), "pips": p, "pip_profit": usd,
                       "loss": ins.loss_at_stop(C("entry"), C("stop"), C("volume"), C("is_long")), "min_stop": ins.min_stop_distance()})
    cols = ("entry", "stop", "target", "entry_slipped", "exit", "tick_profit", "pips", "pip_profit", "loss", "min_stop")
    return x.select("trade_id", "symbol", *[rnd(c, 4).alias(c) for c in cols])


def _sizes(s, d):
    x = priced(s, d)
    return x.select("trade_id", rnd(ins.round_volume(C("volume")), 6).alias("rounded"), rnd(ins.position_size(C("equity"), C("sl_pips")), 6).alias("size"))


def _stops(s, d):
    from barloom.functions.indicators import features
    x = features(event_bars(s, d), ["ATR_14"]).withColumn("pip_position", F.lit(1))
    sl, tp = ins.atr_stops(C("ATR_14"), 2.0, 3.0)
    return x.select("symbol", "ts", rnd(sl, 4).alias("sl_pips"), rnd(tp, 4).alias("tp_pips"))


def _marks(s, d):
    """Unrealised profit and best profit so far of a position from every bar, on each bar until it leaves."""
    from barloom.plans.ledger_queries import _positions
    b, p = _positions(s, d)
    out = lg.follow(b, p, ("trade_id",)).join(p.select("symbol", "timeframe", "trade_id", "is_long", C("entry_price").alias("entry")), ["symbol", "timeframe", "trade_id"])
    x = lg.marks(b, out, ("trade_id", "is_long", "entry")).withColumns({"pip_position": F.lit(1), "pip_value": F.lit(2.0)})
    pips, usd = ins.close_pnl(C("entry"), C("close"), F.lit(0.5), C("is_long"))
    w = Window.partitionBy("symbol", "trade_id").orderBy("bar_no").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({"pips": pips, "usd": usd})
    return x.select("symbol", "trade_id", "bar_no", rnd("pips", 2).alias("unrealised_pips"), rnd("usd", 2).alias("unrealised_dollars"),
                    rnd(F.greatest(F.lit(0.0), F.max("pips").over(w)), 2).alias("best_pips"))


def _contract(s, d):
    raw = F.when(C("event_id") % 7 == 0, "x").when(C("event_id") % 11 == 0, None).otherwise((C("value") / 40 - 2).cast("string"))
    return table(s, d, "events").select("event_id", clean_signal(raw).alias("signal"))


def _tagged(s, d) -> DataFrame:
    o = table(s, d, "orders")
    return o.select("o_orderkey", C("o_orderpriority").alias("symbol"), F.when(C("o_orderkey") % 2 == 0, "H1").otherwise("D1").alias("timeframe"),
                    C("o_orderstatus").alias("strategy"), F.when(C("o_custkey") % 2 == 0, "long").otherwise("Short").alias("direction"),
                    F.when(C("o_custkey") % 3 != 0, (C("o_custkey") % 40) / 16).alias("risk_pct"), F.when(C("o_custkey") % 4 == 0, (C("o_custkey") % 5).cast("int")).alias("tier"))


def _encode(s, d):
    x = _tagged(s, d)
    t = tags.encode_tag(C("symbol"), C("timeframe"), C("strategy"), C("direction"), C("risk_pct"), C("tier"))
    return x.select("o_orderkey", t.alias("tag"), tags.magic(C("symbol"), C("timeframe"), C("strategy")).alias("magic"), tags.strategy_code(C("strategy")).alias("code"))


def _decode(s, d):
    """Comments of every known form, and junk."""
    k = C("o_orderkey") % 9
    t = F.concat_ws
    v = C("o_custkey").cast("string")
    comment = (F.when(k == 0, t(":", F.lit("PM"), C("o_orderpriority"), F.lit("H1"), F.lit("EMACrossoverStrategy"), F.lit("LONG")))
               .when(k == 1, t(":", F.lit("PM2"), C("o_orderpriority"), F.lit("H1"), F.lit("v17f2"), F.lit("L"), F.lit("2"), v))
               .when(k == 2, t(":", F.lit("PM3"), C("o_orderpriority"), F.lit("D1"), F.lit("v17f2"), F.lit("sell"), v))
               .when(k == 3, t(":", F.lit("PM3"), C("o_orderpriority"), F.lit("D1"), F.lit("v17f2")))
               .when(k == 4, F.concat(F.lit("PM_"), C("o_orderstatus"))).when(k == 5, "").when(k == 6, F.lit(None))
               .when(k == 7, t(":", F.lit("PM2"), C("o_orderpriority"), F.lit("H4"), F.lit("abc12"), F.lit("S"), F.lit("1"))).otherwise("hello:world"))
    x = table(s, d, "orders").select("o_orderkey", tags.decode_tag(comment).alias("t"))
    return x.select("o_orderkey", C("t").isNotNull().alias("is_tag"), *[C(f"t.{f}") for f in ("symbol", "timeframe", "strategy_code", "strategy_name", "strategy_tag",
                                                                                           "direction", "tier", "risk_pct")])


def _seeds(s, d):
    x = table(s, d, "part")
    text = F.concat(F.lit('{"p_size": '), C("p_size").cast("string"), F.lit("}"))
    return x.select("p_partkey", tags.slot_seed(F.lit("set1"), C("p_brand"), F.lit("H1"), C("p_type")).alias("seed"), tags.hash16(text).alias("param_hash"),
                    tags.cache_key(C("p_brand"), C("p_type"), C("p_name")).alias("cache_key"), ins.normal_symbol(F.concat(C("p_name"), F.lit(".x#1"))).alias("norm"))


def _slot_index(s, d):
    return ev.sales_slot_index(cut_lineage(ev.sales_candidates(s, d)))


def _no_trade(s, d):
    led = ev.sales_rejections(s, d, with_index=True)
    return led.groupBy("preset", "timeframe", "outcome", "reason").agg(F.count(F.lit(1)).alias("slots"), F.sum("candidate_count").alias("candidates"))


def _wide(s, d):
    x = bk.to_wide(ev.sales_candidates(s, d))
    return x.select(*bk.CAND, *[f"{r}_{m}" for r in bk.REGIMES for m in ("train_trades", "val_trades", "val_pf", "val_return")])


def _ledger_json(s, d):
    led = ev.sales_rejections(s, d)
    one = F.to_json(F.struct("outcome", "reason", "gates_applied", "binding_gates", F.transform("rejections", lambda r: r["strategy_name"]).alias("rejected")))
    back = F.from_json(one, "outcome string, reason string, gates_applied array<string>, binding_gates array<string>, rejected array<string>")
    x = led.select("preset", *gt.SLOT, back.alias("j"))
    return x.select("preset", *gt.SLOT, "j.outcome", F.array_join("j.rejected", ",").alias("rejected"), F.size("j.binding_gates").alias("binding"))


def _presets(s, d):
    """The preset table beside the number of slots each meets."""
    t = gt.preset_table(s, gt.all_presets(True))
    led = gt.fill_totals(ev.sales_rejections(s, d, single=True))
    x = t.join(led.select("preset", "total_slots"), "preset")
    return x.select("preset", "gate_count", "active_gates", F.array_join("gate_names", ",").alias("gate_names"), "total_slots")


def _registry(s, d):
    """Rules by category, and how many of their signals a series could carry at most."""
    from barloom.strategies import base as sb
    n = event_bars(s, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"))
    cats = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.lit(len(sb.names(c))).alias("rules")) for c in (sb.TREND, sb.REVERSION, sb.BREAKOUT)])).alias("c")
    return n.select("symbol", cats, "bars").select("symbol", "c.*", (C("bars") * C("c.rules")).alias("most_signals"))


def _plugins(s, d):
    """A user rule and a user gate, registered by name and used like built-in ones."""
    from barloom.strategies import base as sb
    from barloom.strategies.signals import signals
    sb.register(sb.Strategy("UpBarStrategy", sb.TREND, {"least": 5.0, "sl_atr_mult": 2.0, "tp_atr_mult": 3.0}, {},
                            rule=lambda f, p: (f.need("DCLOSE") > p["least"], f.need("DCLOSE") < -p["least"])))
    gt.register_gate("X1", lambda m, t: m["val_win_rate"] < t)
    try:
        sig = signals(event_bars(s, d), ["UpBarStrategy"]).groupBy("symbol").agg(
            F.sum(F.when(C("signal") == 1, 1).otherwise(0)).alias("ups"), F.sum(F.when(C("signal") == -1, 1).otherwise(0)).alias("downs"))
        gates = gt.check_gates(gt.rank_candidates(ev.sales_candidates(s, d), None), [gt.Preset("mine", ("G1", "X1"), {"X1": 50.0})])
        hits = gates.agg(F.sum(F.array_contains("failed_gates", "X1").cast("int")).alias("x1_failed"), F.sum(C("passed").cast("int")).alias("passed"))
        return sig.join(F.broadcast(hits))  # one row
    finally:
        sb._REGISTRY.pop("UpBarStrategy", None)
        gt._GATES.pop("X1", None)


QUERIES = {
    "clean_bars": _clean,
    "bar_quality": _quality,
    "discover_symbols": _discover,
    "series_coverage": lambda s, d: fl.coverage(event_bars(s, d)).drop("timeframe"),
    "file_inventory": _inventory,
    "file_verification": _verify,
    "bars_min_length": _min_bars,
    "resample_six": _resampled(["M5", "M15", "M30", "H1", "H4", "D1"]),
    "resample_weekly": _resampled(["W1"]),
    "train_val_split": _splits,
    "decision_time_shift": _live,
    "spec_resolution": _specs,
    "spec_inheritance": _inherit,
    "price_arithmetic": _prices,
    "volume_and_size": _sizes,
    "atr_stop_distances": _stops,
    "mark_to_market": _marks,
    "signal_contract": _contract,
    "tag_encode": _encode,
    "tag_decode": _decode,
    "seeds_and_hashes": _seeds,
    "slot_index": _slot_index,
    "no_trade_reasons": _no_trade,
    "candidate_wide": _wide,
    "rejection_json": _ledger_json,
    "preset_catalogue": _presets,
    "rule_catalogue": _registry,
    "user_extensions": _plugins,
}
