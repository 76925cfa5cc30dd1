"""Mixing sources to target weights by blocks.

The words of a source, document after document, are packed into blocks of ``BLOCK`` words.  A source's target is its share of the mix by
weight, at most ``MOST`` times its own words; what a cap cuts off is shared anew among the others.  The mix has a slot for each block to
take.  Output shards draw their counts per source without replacement from the sources' slots: multinomial counts, conditioned
on the exact totals, so that no source drifts from its target.  Slot j of a source takes the block that the source's pseudorandom permutation of
block indexes (a Feistel network, another key for each round through the source) gives for j, and slots meet blocks by a join on index.

The driver holds sources and ``SHARDS`` counts for each (at most ``MAX_SOURCES`` sources); documents, blocks and slots stay distributed.
A document's place in its source is its place in a hashed bucket plus the words of earlier buckets, so a source with a third of all
rows is spread over all buckets.

Defined cases: a null text has no words and is never taken; null is a source of its own, last in order; repeated rows count each;
a source without words has target 0; an empty table gives an empty result; other columns are ignored (``mixed`` keeps them).
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import NO_ID, Batches, checkpointed, row_keys, text_bytes, to_batch
from barloom.llm.simhash import mix

BLOCK, WEIGHTS, SHARE, MOST, SHARDS, SEED, MAX_SOURCES = 128, (3, 1, 2), 1.5, 2.0, 256, 20, 100_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float = MOST) -> list[float]:
    """``total`` by weight; who would get more than ``most`` times its size gets that, the rest is shared anew until nobody is above."""
    out, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    left = float(total)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        capped = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        if not capped:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in capped:
            out[i] = most * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(capped)]
    return out


def permute(j: np.ndarray, n: int, key: int) -> np.ndarray:
    """Pseudorandom bijection of [0, n): four Feistel rounds on an even number of bits, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> np.uint64(half), x & low
        for r in range(4):
            a, b = b, a ^ (mix(b + np.uint64(key % 2**63), r + 1) & low)
        return (a << np.uint64(half)) | b

    out = once(j.astype(np.uint64))
    while (far := out >= np.uint64(n)).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def _sizes(batches: Batches) -> Batches:
    for b in batches:
        n = [len(t.split()) for t in b.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64())], ["doc_id", "_rk_h", "source", "size"])


def _slots(block_seed: int):
    def run(frames):
        for frame in frames:
            for r in frame.itertuples():
                for lo in range(0, r.count, 1 << 20):
                    j = np.arange(r.first + lo, r.first + min(r.count, lo + (1 << 20)), dtype=np.int64)
                    at = np.empty(len(j), np.int64)
                    for epoch in np.unique(j // r.blocks):
                        here = j // r.blocks == epoch
                        at[here] = permute(j[here] % r.blocks, r.blocks, (block_seed * 1_000_003 + r.source_no) * 31 + int(epoch))
                    yield pd.DataFrame({"source_no": r.source_no, "block": at, "epoch": j // r.blocks, "shard": r.shard, "slot": j})
    return run


class Mix:
    """``docs``: rid, doc_id, _rk_h, source_no, size, start; ``sources``: source_no, source, source_size, target, blocks, slots; ``slots``."""

    def __init__(self, docs: DataFrame, sources: DataFrame, slots: DataFrame, block: int):
        self.docs, self.sources, self.slots, self.block = docs, sources, slots, block

    def spans(self) -> DataFrame:
        """Each document's overlap with its blocks and, per taken slot, the slot's epoch; documents without words stay, block and epoch null.

        Both sides grow with the words, but Spark takes the slots to be as small as the shard counts they are made from, and the documents as before
        they are cut: unless told to merge, it would broadcast a side whole through the driver.
        """
        b = self.block
        first, last = F.expr(f"start div {b}"), F.expr(f"(start + size - 1) div {b}")
        none = F.array(-1 - F.col("rid"))  # a block of its own, that no slot takes: nulls would all meet in one task
        cut = self.docs.withColumn("block", F.explode(F.when(F.col("size") > 0, F.sequence(first, last)).otherwise(none)))
        overlap = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b) - F.greatest(F.col("start"), F.col("block") * b)
        slots = self.slots.select("source_no", "block", "epoch").hint("merge")
        met = cut.withColumn("words", F.when(F.col("block") >= 0, overlap).otherwise(0)).join(slots, ["source_no", "block"], "left")
        return met.withColumn("block", F.when(F.col("block") >= 0, F.col("block")))

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken."""
        sums = self.spans().groupBy("rid", "doc_id", "source_no", "size").agg(
            F.coalesce(F.sum(F.when(F.col("epoch").isNotNull(), F.col("words"))), F.lit(0)).cast("long").alias("taken"))
        known = F.broadcast(self.sources.select("source_no", "source_size", "target"))  # at most MAX_SOURCES rows
        return sums.join(known, "source_no").select("doc_id", "size", "source_size", "target", "taken")


def plan(docs: DataFrame, block: int = BLOCK, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST, shards: int = SHARDS,
         seed: int = SEED) -> Mix:
    spark = docs.sparkSession
    raw = row_keys(docs.select("doc_id", "text", "source")).select(F.col("doc_id").cast("long").alias("doc_id"), "_rk_h", F.col("source").cast("string"), text_bytes().alias("t"))
    sized = raw.mapInArrow(_sizes, "doc_id long, _rk_h long, source string, size long")
    sized = checkpointed(sized.withColumns({"rid": F.monotonically_increasing_id()}))
    found = [(r.source, r.size or 0) for r in sized.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()]
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [n for _, n in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share * sum(sizes), most)
    blocks = [-(-n // block) for n in sizes]
    slots = [min(int(most * b), round(g * b / n)) if n else 0 for n, g, b in zip(sizes, goal, blocks, strict=True)]
    kind = "source_no int, source string, source_size long, target double, blocks long, slots long"
    sources = spark.createDataFrame([(i, s, n, g, b, k) for i, ((s, n), g, b, k) in enumerate(zip(found, goal, blocks, slots, strict=True))], kind)
    # counts of each shard: drawn without replacement from what is left of all sources
    rng, left, given, counts = np.random.default_rng(seed), np.array(slots, np.int64), np.zeros(len(slots), np.int64), []
    for shard in range(shards):
        n = int(left.sum()) // (shards - shard)
        got = rng.multivariate_hypergeometric(left, n, method="marginals") if n else np.zeros(len(slots), np.int64)
        counts += [(i, shard, int(given[i]), int(got[i]), blocks[i]) for i in np.flatnonzero(got).tolist()]
        left, given = left - got, given + got
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    drawn = spark.createDataFrame(counts, "source_no int, shard int, first long, count long, blocks long").repartition(tasks, "shard", "source_no")
    drawn = drawn.mapInPandas(_slots(seed), "source_no int, block long, epoch long, shard int, slot long")
    # places of documents in their source
    buckets = 4 * tasks
    known = F.broadcast(sources.select("source_no", F.col("source").alias("_s")))
    placed = sized.join(known, F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "source")
    placed = placed.withColumn("_b", F.pmod(F.xxhash64("doc_id", "_rk_h"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("source_no").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("source_no", "_b").agg(F.sum("size").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = Window.partitionBy("source_no", "_b").orderBy("doc_id", "_rk_h", "rid").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(totals.drop("_n"), ["source_no", "_b"])
    placed = placed.select("rid", "doc_id", "_rk_h", "source_no", "size", (F.col("_in") + F.col("_before")).alias("start"))
    return Mix(placed, sources, drawn, block)


def _slices(batches: Batches) -> Batches:
    """Text and list of (epoch, first word, last word + 1) in; the texts of these runs out, white space inside kept."""
    for b in batches:
        at, out = [], []
        for i, (t, runs) in enumerate(zip(b.column("_rk_text").to_pylist(), b.column("_rk_runs").to_pylist(), strict=True)):
            t = t or ""
            bounds = [m.span() for m in WORD.finditer(t)]
            for r in runs:
                at.append(i)
                out.append(t[bounds[r["a"]][0]:bounds[r["b"] - 1][1]])
        rest = pa.Table.from_batches([b]).drop_columns(["_rk_text", "_rk_runs"]).take(pa.array(at, pa.int64())).combine_chunks()
        made = rest.append_column("_rk_text", pa.array(out, pa.string()))
        yield from made.to_batches() or [pa.RecordBatch.from_pylist([], schema=made.schema)]


def runs_of(pieces: Column) -> Column:
    """Neighbouring (epoch, a, b) joined, from a sorted array."""
    start = F.array().cast("array<struct<epoch:bigint,a:bigint,b:bigint>>")

    def add(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joins = (F.size(acc) > 0) & (last["epoch"] == x["epoch"]) & (last["b"] == x["a"])
        longer = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(x["epoch"].alias("epoch"), last["a"].alias("a"), x["b"].alias("b"))))
        return F.when(joins, longer).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(pieces, start, add)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: for every run of taken words a row with the columns of ``docs``, its text cut to the run (``n_chars`` too)."""
    m = plan(docs, **options)
    b = m.block
    got = m.spans().filter("epoch is not null")
    a = F.greatest(F.col("start"), F.col("block") * b) - F.col("start")
    got = got.groupBy("rid", "doc_id", "_rk_h").agg(F.sort_array(F.collect_list(F.struct("epoch", a.alias("a"), (a + F.col("words")).alias("b")))).alias("_p"))
    got = got.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_rk_id"), "_rk_h", "rid", runs_of(F.col("_p")).alias("_rk_runs"))
    # repeated rows are told apart by their number among rows of the same key
    got = got.withColumn("_rk_rep", F.row_number().over(Window.partitionBy("_rk_id", "_rk_h").orderBy("rid"))).drop("rid")
    rows = row_keys(docs).withColumn("_rk_rep", F.row_number().over(Window.partitionBy("_rk_id", "_rk_h").orderBy("_rk_h")))
    met = rows.join(got, ["_rk_id", "_rk_h", "_rk_rep"]).withColumn("_rk_text", F.col("text")).drop("_rk_id", "_rk_h", "_rk_rep", "text")
    rest = [f for f in met.schema.fields if f.name not in ("_rk_text", "_rk_runs")]
    out = met.mapInArrow(_slices, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", _rk_text string")
    out = out.withColumnRenamed("_rk_text", "text")
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(out.dtypes)["n_chars"]))
    return out.select(*docs.columns)
