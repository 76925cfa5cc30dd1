"""Ingest, sinks, tags, specifications and streams."""

import gzip
import hashlib
import random
import zlib

import pytest
from conftest import make_bars
from pyspark import TaskContext
from pyspark.sql import functions as F

from barloom.functions import tags
from barloom.operators import gates as gt
from barloom.operators import regime as rg
from barloom.operators.resample import bars_for, resample, resample_all
from barloom.sources import digests
from barloom.sources import files as fl
from barloom.streaming import twins
from barloom.strategies.base import clean_signal
from test_gates import _cands


def test_bar_files(spark, tmp_path):
    (tmp_path / "EURUSD_M5_x.csv").write_text("Time,OPEN,High,low,Close,tick_volume\n2024-01-01 00:00:00,1,2,0.5,1.5,7\n2024-01-01 00:05:00,bad,2,1,1.5,3\n")
    (tmp_path / "AU_200_H1.csv").write_text("Time,OPEN,High,low,Close,tick_volume\n2024-01-01 00:00:00,1,1,2,1.5,\n")
    rows = {r["symbol"]: r for r in fl.read_bar_files(spark, str(tmp_path)).collect()}
    assert set(rows) == {"EURUSD", "AU_200"} and rows["EURUSD"]["timeframe"] == "M5" and rows["EURUSD"]["volume"] == 7.0
    inv = fl.inventory(spark, f"{tmp_path}/*.csv")
    want = {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in tmp_path.glob("*.csv")}
    assert {r["file"]: r["sha256"] for r in inv.collect()} == want
    man = spark.createDataFrame([("AU_200_H1.csv", "x"), ("EURUSD_M5_x.csv", want["EURUSD_M5_x.csv"]), ("no.csv", "y")], "file string, sha256 string")
    assert {r["file"]: r["status"] for r in fl.verify(man, inv).collect()} == {"AU_200_H1.csv": "CHECKSUM_MISMATCH", "EURUSD_M5_x.csv": "OK", "no.csv": "MISSING"}


def test_large_files_are_digested_in_blocks(spark, tmp_path):
    r = random.Random(5)
    texts = {"a b+c%41.bin": r.randbytes(70_000), "end.bin": r.randbytes(40_000) + b"\n", "mark.csv": b"\xef\xbb\xbf" + b"x,\r\n\n" * 9_000 + b"y", "small.bin": b"\n\n",
             "lines.csv": b"\n" * 33_000, "packed.gz": gzip.compress(r.randbytes(30_000)), "even.bin": b"abcdefg\n" * 4096}
    for name, data in texts.items():
        (tmp_path / name).write_bytes(data)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = {x.file: (x.bytes, x.sha256) for x in fl.inventory(spark, f"{tmp_path}/*", 8192).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert got == {name: (len(data), hashlib.sha256(data).hexdigest()) for name, data in texts.items()}


def test_a_task_is_dealt_one_block_of_one_file(spark, tmp_path, monkeypatch):
    r, log, advance = random.Random(7), tmp_path / "log", digests._advance
    log.mkdir()
    (tmp_path / "in").mkdir()
    texts = {f"{i}.bin": r.randbytes(30_000 + 3_000 * i) for i in range(6)}
    for name, data in texts.items():
        (tmp_path / "in" / name).write_bytes(data)

    def noted(states, pieces):
        at = TaskContext.get()
        with open(f"{log}/{at.stageId()}-{at.partitionId()}", "a") as f:
            f.write(f"{pieces['bytes'].map(len).sum()}\n")
        return advance(states, pieces)

    monkeypatch.setattr(digests, "_advance", noted)
    now = fl.inventory(spark, f"{tmp_path}/in/*", 8192)  # splits are longer than blocks, tasks fewer than files
    assert {x.file: x.sha256 for x in now.collect()} == {name: hashlib.sha256(data).hexdigest() for name, data in texts.items()}
    dealt = [sum(int(float(n)) for n in f.read_text().split()) for f in log.iterdir()]
    assert sum(dealt) >= sum(map(len, texts.values())) and max(dealt) < 2 * 8192
    man = now.withColumn("sha256", F.when(F.col("file") == "3.bin", "0").otherwise(F.col("sha256")))
    assert {x.file: x.status for x in fl.verify(man, now).collect()} == {name: "CHECKSUM_MISMATCH" if name == "3.bin" else "OK" for name in texts}


def test_files_of_one_name_are_verified_by_folder(spark, tmp_path):
    r = random.Random(9)
    for name, n in (("a b+c%41.parquet/part-0", 10), ("d.parquet/part-0", 30_000), ("g.parquet/part-0", 20_000), ("e.parquet/part-0", 500), ("f.parquet", 70)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(r.randbytes(n))
    now = fl.inventory(spark, f"{tmp_path}/*.parquet", 8192)
    assert sorted((x.folder, x.file) for x in now.collect()) == [("", "f.parquet"), ("a b+c%41.parquet", "part-0"), ("d.parquet", "part-0"), ("e.parquet", "part-0"), ("g.parquet", "part-0")]
    man = now.withColumn("sha256", F.when(F.col("folder") == "e.parquet", "0").otherwise(F.col("sha256")))
    got = sorted((x.file, x.status) for x in fl.verify(man, now).collect())
    assert got == [("f.parquet", "OK"), ("part-0", "CHECKSUM_MISMATCH"), ("part-0", "OK"), ("part-0", "OK"), ("part-0", "OK")]


def test_quality_counts(spark):
    rows = [("1", "2", "0", "1"), ("x", "2", "0", "1"), ("1", None, "0", "1"), ("1", "0.5", "2", "1")]
    df = spark.createDataFrame([("A", "H1", *r) for r in rows], "symbol string, timeframe string, open string, high string, low string, close string")
    q = fl.bar_quality(df).first()
    assert (q["rows"], q["dropped"], q["invalid"]) == (4, 2, 1)
    assert [r["volume"] for r in fl.clean_bars(df).collect()] == [0.0, 0.0]
    with pytest.raises(ValueError):
        fl.parse_time(df)


def test_sinks_round_trip(spark, tmp_path):
    led = gt.materialise(_cands(spark, {"val_dd": 99.0}, {"quality_score": 1.0}), gt.all_presets())
    fl.write_rejections(led, f"{tmp_path}/led")
    back = fl.read_rejections(spark, f"{tmp_path}/led", led.schema)
    assert sorted(map(str, back.select(led.columns).collect())) == sorted(map(str, led.collect()))
    w = gt.winners(led)
    fl.write_winners(w, str(tmp_path))
    assert spark.read.option("header", True).csv(f"{tmp_path}/winner_table").count() == w.count()
    audit = fl.write_tables({"totals": gt.fill_totals(led)}, str(tmp_path / "an")).first()
    assert audit["name"] == "totals" and audit["rows"] == 7
    fl.write_candidates(_cands(spark, {}).withColumn("is_tuned", F.lit(False)), f"{tmp_path}/cand")
    wide = spark.read.parquet(f"{tmp_path}/cand")
    assert "TREND_val_trades" in wide.columns and wide.count() == 1


def test_identifiers(spark):
    df = spark.createDataFrame([("EURUSD", "H1", "TREND", "EMACrossoverStrategy")], "s string, t string, r string, n string")
    row = df.select(tags.magic(F.col("s"), F.col("t"), F.col("r")).alias("m"), tags.strategy_code(F.col("n")).alias("c"),
                    tags.slot_seed(F.lit("d"), F.col("s"), F.col("t"), F.col("n")).alias("seed")).first()
    n, digits = zlib.crc32(b"EMACrossoverStrategy"), ""
    while n:
        n, k = divmod(n, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[k] + digits
    assert row["m"] == zlib.crc32(b"EURUSD|H1|TREND") & 0x7FFFFFFF and row["c"] == digits[-5:].rjust(5, "0")
    assert row["seed"] == int.from_bytes(hashlib.sha256(b"d|EURUSD|H1|EMACrossoverStrategy|1").digest()[:4], "big") & 0x7FFFFFFF


def test_tags(spark):
    cases = ["PM:EURUSD:H1:EMACrossoverStrategy:LONG", "PM2:EURUSD:H1:v17f2:L:2:15", "PM3:EURUSD:H1:v17f2:S:10", "PM3:EURUSD:H1:v17f2", "PM3:EURUSD:H1:v17f2:S:1.5", "PM_foo", "", None, "junk"]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string").select("i", tags.decode_tag(F.col("c")).alias("t")).orderBy("i").collect()
    t = [r["t"] for r in rows]
    assert t[0]["strategy_name"] == "EMACrossoverStrategy" and t[0]["direction"] == "LONG"
    assert (t[1]["tier"], t[1]["risk_pct"], t[2]["direction"], t[2]["risk_pct"], t[4]["risk_pct"]) == (2, 1.5, "SHORT", 1.0, 1.5)
    assert t[3]["direction"] is None and t[5]["strategy_tag"] == "foo" and t[6] is t[7] is t[8] is None


def test_signal_contract(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["1", "-7", "x", None, "0.9", "NaN"])], "i int, v string")
    assert [r["s"] for r in df.select("i", clean_signal(F.col("v")).alias("s")).orderBy("i").collect()] == [1, -1, 0, 0, 0, 0]


def test_weekly_label_is_the_closing_sunday(spark):
    df = spark.sql("SELECT 'A' AS symbol, 'H1' AS timeframe, CAST(t AS TIMESTAMP_NTZ) AS ts, 1.0D AS open, 2.0D AS high, 0.5D AS low, 1.5D AS close, 1.0D AS volume "
                   "FROM VALUES ('2024-01-07 05:00:00'), ('2024-01-08 00:00:00'), ('2024-01-03 05:10:00') v(t)")
    assert sorted(str(r["ts"]) for r in resample(df, "W1").collect()) == ["2024-01-07 00:00:00", "2024-01-14 00:00:00"]


def test_resample_chain_agrees(spark):
    df = spark.createDataFrame(make_bars(200, ("A",)))
    direct = resample_all(df, ["H4", "D1"]).filter("timeframe = 'D1'")
    step = resample(resample(df, "H4"), "D1")
    assert sorted(direct.drop("timeframe").collect()) == sorted(step.drop("timeframe").collect())
    assert bars_for(df, "D1", {"D1": 9}).count() == 9 and bars_for(df, "D1", {"D1": 10}).count() == 0


def test_streams_replayed_in_many_batches_equal_the_batch_result(spark):
    rows = rg.regimes(spark.createDataFrame(make_bars(300, ("A", "B"), 9)))
    src = rg.resolve_params(rows.select("symbol", "timeframe", "ts", "bar_no", "regime_raw", "regime_gap"))
    folder = twins.checkpoint_folder(spark) + "/ordered"
    for lo in range(0, 300, 100):
        src.filter((F.col("bar_no") >= lo) & (F.col("bar_no") < lo + 100)).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = twins.run_to_table(twins.stream_regimes(stream), spark).select("symbol", "bar_no", "regime").collect()
    assert sorted(got) == sorted(rows.select("symbol", "bar_no", "regime").collect())
