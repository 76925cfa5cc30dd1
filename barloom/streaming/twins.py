"""Structured Streaming forms of batch operators.  Replaying a table as a stream gives the batch result."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.operators.regime import _switch
from barloom.session import checkpoint_folder
from barloom.sources.adapters import ticks_to_bars

C = F.col


def stream_bars(ticks: DataFrame, symbol: str, price: str, ts: str, tie: str, timeframe: str, delay: str = "2 hours") -> DataFrame:
    """Bars of a tick stream; a bar leaves once the watermark (the newest tick less ``delay``) has passed its end; ticks for it that come later are dropped.

    The end of a bounded replay is flushed by a closing tick beyond it, see ``closing_tick``.
    """
    timed = ticks.withColumn(ts, C(ts).cast("timestamp")).withWatermark(ts, delay)
    return ticks_to_bars(timed, symbol, price, ts, tie, timeframe)


def closing_tick(ticks: DataFrame, symbol: str, ts: str, ahead: str = "2 days") -> DataFrame:
    """``ticks`` and one more, far enough after the last to close every bar; its own bar never closes."""
    last = ticks.agg(F.max(ts).alias(ts)).select(F.lit("").alias(symbol), (C(ts) + F.expr(f"INTERVAL {ahead}")).cast(ticks.schema[ts].dataType).alias(ts))
    return ticks.unionByName(last, allowMissingColumns=True)


def stream_regimes(rows: DataFrame) -> DataFrame:
    """Regime label per bar with the switch state kept per series between batches; bars must arrive in order."""
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values("bar_no", ignore_index=True)
        held = json.loads(state.get[0]) if state.exists else None
        out, after = _switch(pdf, 0, len(pdf), held)
        state.update((json.dumps(after),))
        yield pd.concat([pdf[["symbol", "timeframe", "ts", "bar_no", "regime_raw"]], out], axis=1)

    return rows.groupBy("symbol", "timeframe").applyInPandasWithState(
        step, "symbol string, timeframe string, ts timestamp, bar_no long, regime_raw string, regime string, regime_live string",
        "st string", "append", GroupStateTimeout.NoTimeout)


def stream_exits(bars: DataFrame, positions: DataFrame) -> DataFrame:
    """First exit of every position, from a stream of bars and a stream of positions.

    The open positions of a symbol are its state; a bar meets only those, and a position that leaves is forgotten.  A position must
    arrive no later than the first bar after its entry; within a batch all positions are taken up before the bars.
    """
    nothing = lambda kind: F.lit(None).cast(kind)
    columns = {"trade_id": "long", "entry_bar": "long", "is_long": "boolean", "stop_loss": "double", "take_profit": "double", "half_spread": "double"}
    price = {"bar_no": "long", "high": "double", "low": "double"}
    both = bars.select("symbol", *price, *[nothing(t).alias(c) for c, t in columns.items()]).unionByName(
        positions.select("symbol", *[nothing(t).alias(c) for c, t in price.items()], *columns))

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else []
        bars_seen = []
        for pdf in batches:  # bars are three numbers each; positions go straight into the state
            fresh = pdf[pdf["trade_id"].notna()]
            held += [[int(r.trade_id), int(r.entry_bar), 1 if r.is_long else -1, r.stop_loss, r.take_profit, r.half_spread] for r in fresh.itertuples()]
            bars_seen.append(pdf.loc[pdf["bar_no"].notna(), ["bar_no", "high", "low"]].to_numpy(float))
        seen = np.concatenate(bars_seen)
        seen = seen[np.argsort(seen[:, 0], kind="stable")]
        left, out = [], []
        for p in held:
            trade, entry, side, stop, target, half = p
            now = seen[np.searchsorted(seen[:, 0], entry, side="right"):]
            near, far = (now[:, 2], now[:, 1]) if side == 1 else (-now[:, 1], -now[:, 2])
            sl = near - half <= stop * side
            hits = np.flatnonzero(sl | (far - half >= target * side))
            if len(hits):
                k = hits[0]
                out.append((key[0], trade, int(now[k, 0]), "closed_sl" if sl[k] else "closed_tp", stop if sl[k] else target))
            else:
                left.append(p)
        state.update((json.dumps(left),))
        yield pd.DataFrame(out, columns=["symbol", "trade_id", "bar_no", "exit_reason", "exit_price"])

    return both.groupBy("symbol").applyInPandasWithState(
        step, "symbol string, trade_id long, bar_no long, exit_reason string, exit_price double", "open string", "append", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """Drain a stream into a Parquet table in the shared checkpoint folder and read it back."""
    base = f"{checkpoint_folder(spark)}/streams/{uuid.uuid4().hex}"
    query = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out")
             .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def replay(df: DataFrame, order: str | None = None, slices: int = 3) -> DataFrame:
    """A table written to the shared folder and read back as a stream, a slice of ``order`` in each batch (without it, all in one)."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/replay/{uuid.uuid4().hex}"
    if order is None:
        df.write.parquet(path)
        return spark.readStream.schema(df.schema).parquet(path)
    at = (C(order).cast("timestamp") if dict(df.dtypes)[order] == "timestamp_ntz" else C(order)).cast("double")
    cuts = df.select(at.alias("_o")).approxQuantile("_o", [k / slices for k in range(1, slices)], 0.01)
    for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):  # written one after the other, so that the stream reads them in this order
        part = df.filter(F.lit(True) if lo is None else at > lo).filter(F.lit(True) if hi is None else at <= hi)
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
