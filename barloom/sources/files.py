"""Bar files in, result files out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.buckets import CAND, to_wide
from barloom.series import KEYS
from barloom.sources.digests import BLOCK, digests

C = F.col
# Accepted names of each column and of the time column, in order of preference.
ALIASES = {"open": ("open",), "high": ("high",), "low": ("low",), "close": ("close",), "volume": ("volume", "tick_volume", "tickvolume"),
           "spread": ("spread",), "real_volume": ("real_volume",)}
TIME_NAMES = ("time", "datetime", "date", "timestamp")


def standardise(raw: DataFrame) -> DataFrame:
    """Lower-case names with aliases merged; several volume columns are coalesced in order of preference."""
    have = {c.lower(): c for c in raw.columns}
    known = {a for names in ALIASES.values() for a in names}
    cols = []
    for name, aliases in ALIASES.items():
        found = [C(f"`{have[a]}`") for a in aliases if a in have]
        if found:
            cols.append((F.coalesce(*found) if len(found) > 1 else found[0]).alias(name))
    rest = [C(f"`{c}`").alias(low) for low, c in have.items() if low not in known]
    return raw.select(*rest, *cols)


def parse_time(df: DataFrame) -> DataFrame:
    """``ts`` (without time zone) from the first time column present."""
    low = {c.lower(): c for c in df.columns}
    name = next((low[n] for n in TIME_NAMES if n in low), None)
    if name is None:
        raise ValueError("no time column found")
    return df.withColumn("ts", F.try_to_timestamp(C(f"`{name}`").cast("string")).cast("timestamp_ntz")).drop(name)


def clean_bars(df: DataFrame) -> DataFrame:
    """Numbers or null, rows without a full price dropped, missing volume zero."""
    missing = [c for c in ("open", "high", "low", "close") if c not in df.columns]
    if missing:
        raise ValueError(f"missing column {missing[0]}")
    num = {c: C(c).try_cast("double") for c in ("open", "high", "low", "close", "volume", "spread") if c in df.columns}
    x = df.withColumns(num)
    x = x.withColumns({c: F.when(~F.isnan(c), C(c)) for c in num})
    if "volume" not in df.columns:
        x = x.withColumn("volume", F.lit(0.0))
    return x.filter(C("open").isNotNull() & C("high").isNotNull() & C("low").isNotNull() & C("close").isNotNull())


def violations() -> Column:
    """Whether the prices of a bar contradict each other; such bars are counted, not dropped."""
    return ((C("high") < C("low")) | (C("high") < C("open")) | (C("high") < C("close")) | (C("low") > C("open")) | (C("low") > C("close")))


def bar_quality(raw: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows, dropped rows and violations per series in one pass over the raw bars."""
    num = {c: C(c).try_cast("double") for c in ("open", "high", "low", "close")}
    x = raw.withColumns(num)
    whole = C("open").isNotNull() & C("high").isNotNull() & C("low").isNotNull() & C("close").isNotNull()
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    return x.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), n(~whole).alias("dropped"), n(whole & violations()).alias("invalid"))


def name_parts(path: Column) -> tuple[Column, Column]:
    """Symbol and timeframe of a file called SYMBOL_TF*.csv."""
    stem = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]+)?$", 1)
    return F.regexp_extract(stem, r"^(.+)_([A-Za-z]+\d+)", 1), F.upper(F.regexp_extract(stem, r"^(.+)_([A-Za-z]+\d+)", 2))


def read_bar_files(spark: SparkSession, path: str) -> DataFrame:
    """All bar files under a path or glob as one long table."""
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    sym, tf = name_parts(F.col("_metadata.file_path"))
    raw = raw.withColumns({"symbol": sym, "timeframe": tf})
    out = clean_bars(parse_time(standardise(raw)))
    return out.select(*[c for c in ("symbol", "timeframe", "ts", "open", "high", "low", "close", "volume", "spread") if c in out.columns])


def discover(bars: DataFrame, excluded: DataFrame | None = None, min_rows: int = 1) -> DataFrame:
    """Symbols with enough rows that are not excluded."""
    x = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows")).filter(C("rows") >= min_rows)
    return x.join(excluded.select("symbol"), "symbol", "left_anti") if excluded is not None else x


def inventory(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """Name, size, SHA-256 and folder of every file; those above ``block`` bytes are digested in rounds, a block in each."""
    return digests(spark, path, block)


def coverage(bars: DataFrame) -> DataFrame:
    """Rows and true date range per series, the other half of a dataset manifest."""
    return bars.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))


def verify(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """OK, MISSING or CHECKSUM_MISMATCH for every file of the manifest; names alike are told apart by folder if both tables have it."""
    keys = [k for k in ("folder", "file") if k in manifest.columns and k in actual.columns]
    j = manifest.select(*keys, "sha256").join(actual.select(*keys, C("sha256").alias("_now")), keys, "left")
    return j.select("file", F.when(C("_now").isNull(), "MISSING").when(C("_now") == C("sha256"), "OK").otherwise("CHECKSUM_MISMATCH").alias("status"))


# ---- sinks -----------------------------------------------------------------------------------------------------------

def write_candidates(candidates: DataFrame, path: str, wide: bool = True) -> None:
    out = to_wide(candidates, [c for c in CAND if c in candidates.columns]) if wide else candidates
    out.repartition("symbol", "timeframe").write.mode("overwrite").partitionBy("symbol", "timeframe").parquet(path)


def write_features(features: DataFrame, path: str) -> None:
    """Feature stage table; long series keep several files per partition."""
    features.write.mode("overwrite").partitionBy("symbol", "timeframe").parquet(path)


def write_winners(winners: DataFrame, path: str) -> None:
    """Nested JSON and a flat CSV without parameters."""
    winners.write.mode("overwrite").partitionBy("preset").json(f"{path}/winners_json")
    flat = [c for c in winners.columns if c not in ("params", "params_json")]
    winners.select(*flat).write.mode("overwrite").option("header", True).csv(f"{path}/winner_table")


def write_rejections(ledger: DataFrame, path: str) -> None:
    ledger.write.mode("overwrite").partitionBy("preset").json(path)


def read_rejections(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_tables(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """One CSV folder per analysis table and an audit row for each."""
    spark = next(iter(tables.values())).sparkSession
    audit = []
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
        audit.append((name, f"{path}/{name}", spark.read.option("header", True).csv(f"{path}/{name}").count()))
    return spark.createDataFrame(audit, "name string, path string, rows long")
