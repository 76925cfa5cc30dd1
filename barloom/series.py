"""Ordered series that never need one task per key.

A series (one symbol and timeframe) may hold a large share of all rows, so nothing here windows over a
whole series.  Rows are numbered with a two-step count, cut into chunks of ``chunk_length`` positions, and
every chunk also receives the ``halo`` rows before it.  A window over (key, chunk) then sees the same
frame as a window over the whole series, and the halo rows are dropped afterwards.
Running totals over the whole series use in-chunk windows plus one small carry row per chunk.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("symbol", "timeframe")
#: Positions of a chunk unless the session sets ``spark.barloom.chunkRows``.
CHUNK_ROWS = 65_536
UNB = Window.unboundedPreceding

# Seconds per bar of each timeframe.
TF_SECONDS = {
    "M1": 60, "M5": 300, "M15": 900, "M30": 1800, "H1": 3600, "H4": 14400, "D1": 86400, "W1": 604800,
}


def chunk_length(df: DataFrame, chunk_rows: int | None = None) -> int:
    """The given length, or the session's; the plan is the same for every length and every size of table."""
    return chunk_rows or int(df.sparkSession.conf.get("spark.barloom.chunkRows", str(CHUNK_ROWS)))


def tf_seconds(timeframe: Column) -> Column:
    expr = F.lit(60).cast("long")
    for name, secs in TF_SECONDS.items():
        expr = F.when(timeframe == name, F.lit(secs)).otherwise(expr)
    return expr


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    bucket: Column,
    name: str = "bar_no",
    total: str | None = "series_rows",
) -> DataFrame:
    """0-based position of each row within its key, in ``order``.

    ``bucket`` must be monotone in ``order`` and bound the rows of one (key, bucket); the largest sort is
    then one bucket, and only one counter row per bucket crosses to the per-key prefix sum.
    """
    df = df.withColumn("_bkt", bucket)
    counts = df.groupBy(*keys, "_bkt").agg(F.count(F.lit(1)).alias("_n"))
    per_key = Window.partitionBy(*keys)
    offsets = counts.select(
        *keys,
        "_bkt",
        F.coalesce(F.sum("_n").over(per_key.orderBy("_bkt").rowsBetween(UNB, -1)), F.lit(0)).alias("_off"),
        F.sum("_n").over(per_key).alias("_tot"),
    )
    w = Window.partitionBy(*keys, "_bkt").orderBy(*order)
    # ranked first: the join needs no sort of its own then
    out = df.withColumn(name, F.row_number().over(w)).join(offsets, [*keys, "_bkt"]).withColumn(name, F.col(name) - 1 + F.col("_off"))
    if total:
        out = out.withColumn(total, F.col("_tot"))
    return out.drop("_bkt", "_off", "_tot", "_n")


def number_bars(bars: DataFrame, keys: Sequence[str] = KEYS, chunk_rows: int | None = None) -> DataFrame:
    """``bar_no`` and ``series_rows`` for bars; timestamps are unique per series, so a time span bounds a bucket."""
    span = tf_seconds(F.col("timeframe")) * chunk_length(bars, chunk_rows)
    return number_rows(bars, keys, ["ts"], F.floor(F.unix_timestamp("ts") / span))


def with_halo(numbered: DataFrame, halo: int, chunk_rows: int | None = None) -> DataFrame:
    """Copy each row to its own chunk and to the following chunk(s) that look back at it."""
    chunk_rows = chunk_length(numbered, chunk_rows)
    own = F.expr(f"bar_no div {chunk_rows}")
    last = F.least(F.expr(f"(bar_no + {halo}) div {chunk_rows}"), F.expr(f"(series_rows - 1) div {chunk_rows}"))
    return numbered.withColumn("_chunk", F.explode(F.sequence(own, last))).withColumn("_own", own == F.col("_chunk"))


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter("_own").drop("_own", "_chunk")


def cumulate(
    df: DataFrame,
    keys: Sequence[str],
    block: str,
    order: Sequence[str | Column],
    specs: Mapping[str, tuple[str, Column]],
) -> DataFrame:
    """Running ``sum`` / ``max`` / ``last`` (non-null) per key, in blocks with a carry.

    ``block`` is a column monotone in ``order``.  The in-block window is bounded by the block size; the
    carry is one row per (key, block).
    """
    wb = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(UNB, 0)
    wk = Window.partitionBy(*keys).orderBy(block).rowsBetween(UNB, -1)
    aggs = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    tmp = {f"_v_{n}": col for n, (_, col) in specs.items()}
    df = df.withColumns(tmp)
    inner = df.withColumns({f"_in_{n}": aggs[kind](F.col(f"_v_{n}")).over(wb) for n, (kind, _) in specs.items()})
    pos = F.struct(*[o if isinstance(o, Column) else F.col(o) for o in order])
    folded = [
        (F.max_by(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), pos)) if kind == "last"
         else aggs[kind](F.col(f"_v_{n}"))).alias(f"_s_{n}")
        for n, (kind, _) in specs.items()
    ]
    carry = df.groupBy(*keys, block).agg(*folded)
    carry = carry.select(
        *keys, block, *[aggs[kind](F.col(f"_s_{n}")).over(wk).alias(f"_c_{n}") for n, (kind, _) in specs.items()]
    )
    out = inner.join(carry, [*keys, block])
    combined = {}
    for n, (kind, _) in specs.items():
        inn, car = F.col(f"_in_{n}"), F.col(f"_c_{n}")
        if kind == "sum":
            combined[n] = F.when(inn.isNull() & car.isNull(), None).otherwise(
                F.coalesce(car, F.lit(0)) + F.coalesce(inn, F.lit(0)))
        elif kind == "max":
            combined[n] = F.greatest(inn, car)
        else:
            combined[n] = F.coalesce(inn, car)
    out = out.withColumns(combined)
    return out.drop(*[f"_{p}_{n}" for n in specs for p in ("v", "in", "c")])
