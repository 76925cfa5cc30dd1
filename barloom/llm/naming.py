"""Exact duplicates by deterministic block naming.

A normalised text (A-Z lower-cased, null as empty) is cut into blocks of ``BLOCK`` bytes.  The distinct blocks are sorted
and numbered; adjacent pairs of numbers are sorted and numbered in turn, until each document has one number.  Two documents
of as many levels have the same number exactly when their texts are equal: names are given to contents, never to hashes.
A 64-bit hash only carries the name of a block back to its occurrences, so that texts are shuffled once; the (practically
absent) hashes that two different blocks share are found while naming, and their occurrences carry the block itself.

Defined cases: a null text equals an empty one; an empty table gives an empty result; rows equal in both document number and
text form a group in which one row stays; null document numbers sort below all others; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import Batches, checkpointed, hot_join, row_keys, salted_join, signed, text_bytes, to_batch

BLOCK = 4096


def hash64(block: bytes) -> int:
    return signed(xxhash.xxh3_64_intdigest(block))


def _blocks(text: bytes, block: int) -> list[bytes]:
    return [text[i:i + block] for i in range(0, len(text), block)] or [b""]


def _distinct(block: int, hasher: Callable[[bytes], int]):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            found = Counter(b for t in batch.column(0).to_pylist() for b in _blocks(t.lower(), block))
            yield to_batch({"h": ([hasher(b) for b in found], pa.int64()), "block": (list(found), pa.binary()), "n": (list(found.values()), pa.int64())})
    return run


def _occurrences(block: int, hasher: Callable[[bytes], int], shared: frozenset[int]):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            rid, doc_id, raw, texts = (batch.column(i).to_pylist() for i in range(4))
            out: list[tuple] = []
            for r, d, x, t in zip(rid, doc_id, raw, texts, strict=True):
                t = t.lower()
                parts = _blocks(t, block)
                for pos, b in enumerate(parts):
                    h = hasher(b)
                    first = pos == 0
                    out.append((r, d if first else None, x if first else None, hashlib.sha256(t).hexdigest() if first else None, len(parts), pos, h,
                                b if h in shared else None))
            cols = list(zip(*out, strict=True)) if out else [()] * 8
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            names = ("rid", "doc_id", "_rk_h", "text_sha256", "blocks", "pos", "h", "block")
            yield to_batch({n: (list(c), k) for n, c, k in zip(names, cols, kinds, strict=True)})
    return run


def _name_blocks(docs: DataFrame, block: int, hasher) -> tuple[DataFrame, DataFrame | None, frozenset[int]]:
    """Names by hash; names by content for hashes of several blocks; those hashes (expected number: blocks^2 / 2^65)."""
    found = docs.select(text_bytes().alias("t")).mapInArrow(_distinct(block, hasher), "h long, block binary, n long")
    found = found.groupBy("h", "block").agg(F.sum("n").alias("n"))
    names = found.sortWithinPartitions("h", "block").select("h", "n", F.monotonically_increasing_id().alias("name"))
    by_hash = checkpointed(names.groupBy("h").agg(F.min("name").alias("name"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")))
    shared = frozenset(r.h for r in by_hash.filter("kinds > 1").select("h").collect())
    if not shared:
        return by_hash.select("h", "name", "n"), None, shared
    clash = found.join(by_hash.filter("kinds > 1").select("h"), "h", "left_semi").sortWithinPartitions("h", "block")
    return by_hash.select("h", "name", "n"), checkpointed(clash.select("h", "block", (-1 - F.monotonically_increasing_id()).alias("name"))), shared


def identities(docs: DataFrame, block: int = BLOCK, hasher: Callable[[bytes], int] = hash64) -> DataFrame:
    """rid, doc_id, _rk_h (hash of the raw text), text_sha256, level, name: rows with equal (level, name) have equal texts."""
    by_hash, by_block, shared = _name_blocks(docs, block, hasher)
    raw = row_keys(docs.select("doc_id", "text")).select(
        F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "_rk_h", text_bytes().alias("t"))
    seen = checkpointed(raw.mapInArrow(
        _occurrences(block, hasher, shared),
        "rid long, doc_id long, _rk_h long, text_sha256 string, blocks int, pos int, h long, block binary"))
    total = by_hash.agg(F.sum("n")).first()[0] or 0
    cur = hot_join(seen.filter("block is null").select("rid", "blocks", "pos", "h"), by_hash, ["h"], F.col("rid"), total)
    cur = cur.select("rid", "blocks", "pos", "name")
    if by_block is not None:
        more = salted_join(seen.filter("block is not null").select("rid", "blocks", "pos", "h", "block"), by_block, ["h", "block"], F.col("rid"), "inner")
        cur = cur.unionByName(more.select("rid", "blocks", "pos", "name"))
    cur = checkpointed(cur)
    done, level = cur.filter("blocks = 1").select("rid", F.lit(0).alias("level"), "name"), 0
    cur = cur.filter("blocks > 1")
    width = cur.agg(F.max("blocks")).first()[0] or 1
    while width > 1:
        width, level = -(-width // 2), level + 1
        pairs = cur.groupBy("rid", "blocks", F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.max(F.expr("CASE WHEN pos % 2 = 0 THEN name END")).alias("a"), F.max(F.expr("CASE WHEN pos % 2 = 1 THEN name END")).alias("b"))
        pairs = pairs.withColumn("none", F.col("b").isNull()).withColumn("b", F.coalesce("b", F.lit(0)))
        names = pairs.groupBy("a", "b", "none").agg(F.count(F.lit(1)).alias("n"))
        names = checkpointed(names.sortWithinPartitions("a", "b", "none").withColumn("name", F.monotonically_increasing_id()))
        named = checkpointed(hot_join(pairs, names, ["a", "b", "none"], F.col("rid"), total).select("rid", "blocks", "pos", "name"))
        left = F.expr(f"ceil(blocks / pow(2, {level}))")
        done = done.unionByName(named.filter(left == 1).select("rid", F.lit(level).alias("level"), "name"))
        cur = named.filter(left > 1)
    return seen.filter("pos = 0").select("rid", "doc_id", "_rk_h", "text_sha256").join(done, "rid")


def exact_groups(docs: DataFrame, block: int = BLOCK, hasher: Callable[[bytes], int] = hash64) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256, and ``_rk_h`` for finding the row again; the largest doc_id stays."""
    found = checkpointed(identities(docs, block, hasher))
    groups = found.groupBy("level", "name").agg(F.max(F.struct("doc_id", "rid")).alias("_top"), F.count(F.lit(1)).alias("group_size"))
    out = hot_join(found, groups, ["level", "name"], F.col("rid"), found.count(), "group_size")
    return out.select("doc_id", F.col("_top.doc_id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"),
                      (F.col("rid") == F.col("_top.rid")).alias("kept"), "text_sha256", "_rk_h")
