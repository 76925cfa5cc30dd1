"""Gates, presets, winners and statistics."""

import pytest
from pyspark.sql import functions as F

from barloom.functions import stats
from barloom.operators import analysis as an
from barloom.operators import gates as gt

GOOD = {"train_trades": 30, "train_pf": 1.2, "train_return": 5.0, "train_dd": 5.0, "train_sharpe": 1.0, "train_win_rate": 55.0, "val_trades": 9, "val_pf": 1.5,
        "val_return": 9.0, "val_dd": 4.0, "val_sharpe": 1.0, "val_win_rate": 55.0, "train_score": 50.0, "val_score": 45.0, "quality_score": 40.0}


def _cands(spark, *over):
    rows = [{"symbol": "A", "timeframe": "H1", "regime": "TREND", "strategy_name": "s", "param_hash": f"{i:02d}", **GOOD, **o} for i, o in enumerate(over)]
    return spark.createDataFrame(rows)


def test_boundaries(spark):
    edge = [({"val_trades": 5}, []), ({"val_dd": 20.0, "val_return": 30.0}, ["G2"]), ({"train_return": 0.0}, []), ({"val_return": 5.0}, []), ({"val_return": 8.0, "val_dd": 8.0}, []),
            ({"val_pf": 1.0}, []), ({"train_score": 40.0, "val_score": 30.0}, []), ({"val_trades": 4, "val_pf": 0.9}, ["G1", "G6"]), ({"train_score": 0.001}, ["G7"])]
    out = gt.check_gates(_cands(spark, *[e for e, _ in edge]), [gt.preset("all_gates")], reason=True).orderBy("param_hash").collect()
    assert [r["failed_gates"] for r in out] == [w for _, w in edge]
    assert out[0]["reason"] == "PASS" and out[7]["reason"] == "G1: val_trades 4 < 5; G6: val_pf 0.90 < 1.00"


def test_null_metric_does_not_fail(spark):
    c = _cands(spark, {}).withColumn("val_pf", F.lit(None).cast("double"))
    assert gt.check_gates(c, [gt.preset("all_gates")]).first()["passed"]


def test_only_the_first_twenty_are_considered(spark):
    led = gt.materialise(_cands(spark, *[{"val_dd": 50.0, "quality_score": 90.0 - i} for i in range(21)], {"quality_score": 1.0}), [gt.preset("drawdown_only")]).first()
    assert led["outcome"] == "NO_TRADE" and len(led["rejections"]) == 20 and led["candidates_considered"] == 20 and led["candidate_count"] == 22
    assert led["binding_gates"] == ["G2"] and [r["rank"] for r in led["rejections"]] == list(range(1, 21))


def test_ties_go_to_the_lower_hash(spark):
    led = gt.materialise(_cands(spark, {"quality_score": 7.0}, {"quality_score": 7.0}), [gt.preset("no_gates")]).first()
    assert led["winner"]["param_hash"] == "00" and led["rejections"] == []


def test_slot_without_training_trades(spark):
    led = gt.materialise(_cands(spark, {"train_trades": 0}), [gt.preset("no_gates")]).first()
    assert led["reason"] == "nobody traded in training" and led["candidates_considered"] == 0 and led["candidate_count"] == 1


def test_unusable_slots_get_four_rows(spark):
    idx = spark.createDataFrame([("A", "H1", 1, "complete"), ("B", "H1", 0, "complete"), ("C", "H1", 3, "failed")], "symbol string, timeframe string, candidate_count long, status string")
    rows = gt.materialise(_cands(spark, {}), [gt.preset("no_gates")], gt.slot_spine(idx)).collect()
    assert len(rows) == 12
    why = {(r["symbol"], r["reason"]) for r in rows}
    assert ("B", "slot is empty") in why and ("C", "slot is failed") in why and ("A", "") in why


def test_more_gates_never_fill_more(spark):
    import random
    rng = random.Random(4)
    over = [{"symbol": f"S{i % 6}", "val_dd": rng.uniform(1, 30), "val_return": rng.uniform(-5, 20), "val_trades": rng.randint(1, 12), "val_pf": rng.uniform(.5, 2), "quality_score": rng.random(),
             "train_return": rng.uniform(-3, 9), "val_score": rng.uniform(20, 60)} for i in range(90)]
    led = gt.materialise(_cands(spark, *over), gt.all_presets(True))
    n = {r["preset"]: r["filled_slots"] for r in gt.fill_totals(led).collect()}
    for p in gt.all_presets(True):
        assert n["all_gates"] <= n[p.name] <= n["no_gates"]
    conv = {r["preset"]: r for r in an.convergence(gt.winners(led)).collect()}
    assert conv["no_gates"]["no_gates"] == 1.0 and conv["minimal"]["no_gates"] == conv["no_gates"]["minimal"]


def test_unknown_preset():
    with pytest.raises(ValueError):
        gt.preset("best_gates")


def test_mcnemar_without_overlap(spark):
    rows = [("all_gates", i, "NO_TRADE") for i in range(585)] + [("no_gates", i, "FILLED") for i in range(585)]
    t = stats.mcnemar(spark.createDataFrame(rows, "preset string, k long, outcome string"), "all_gates", ["no_gates"], ["k"]).first()
    assert (t["n10"], t["n01"], t["chi2_approx"]) == (0, 585, 583.0017)


def _w(spark, d, **kw):
    return stats.wilcoxon(spark.createDataFrame([("g", float(x)) for x in d], "g string, d double"), ["g"], **kw).first()


def test_wilcoxon_forms(spark):
    assert _w(spark, [0] * 12)["note"] == "fewer than ten differences"
    assert _w(spark, range(1, 10))["note"] == "fewer than ten pairs"
    r = _w(spark, [1, -2, 3, 4, 5, 6, 7, 8, 9, 10])
    assert r["W"] == 2.0 and r["z"] == pytest.approx(-2.5992, abs=1e-4) and r["p_value"] == pytest.approx(0.009344, abs=1e-5)
    ties = _w(spark, [1, 1, -1, 2, 2, 3, 3, 3, 4, 5])
    assert ties["W"] == 2.0
    lib = _w(spark, [1, 1, -1, 2, 2, 3, 3, 3, 4, 5], form="library")
    assert abs(lib["z"]) > abs(ties["z"])


def test_friedman_forms(spark):
    rows = [(b, t, float(v)) for b in range(12) for t, v in (("a", 1), ("b", 2 if b % 2 else 1), ("c", 3))]
    df = spark.createDataFrame(rows, "block long, t string, v double")
    plain, tie = (stats.friedman(df, "block", "t", "v", (), k).first() for k in (False, True))
    # rank sums 15, 21, 36 -> 12/(12*3*4) * (81 + 9 + 144); ties in six blocks divide by 1 - 36/288
    assert plain["chi2"] == pytest.approx(19.5) and tie["chi2"] == pytest.approx(19.5 / (1 - 36 / 288), abs=1e-3)
    assert 0 < tie["p_value"] < plain["p_value"] < 0.001
