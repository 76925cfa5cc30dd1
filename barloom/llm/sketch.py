"""Document fingerprints by one-permutation MinHash.

Each five-word shingle is hashed once; its top bits choose one of ``BINS`` bins and each bin keeps its least hash.  Empty bins
are filled by optimal densification: bin i probes other bins in a hashed order of its own until it meets a full one, so two texts with
the same full bins fill alike.  Of each bin ``BITS`` low-order bits are stored, two bins a byte, in hex.  Equal bins estimate likeness after
the bias correction (m - c) / (1 - c), c = 2^-BITS being the chance that other values share their low bits.

``next_texts`` deals documents out by ranges of doc_id and streams each range in falling order, so every document sees
the next one in line while texts are shuffled once; the first row of each range also goes to the range before it.

Defined cases: a null text is empty; a text without words has the empty fingerprint, alike (1) to another such and unlike (0) any other;
fewer than five words are one shingle; rows without doc_id come last; equal doc_ids follow each other by text; a single
row is its own next document; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import Batches, to_batch
from barloom.llm.simhash import mix, shingle_hashes

BINS, BITS, SHINGLE = 512, 4, 5
EMPTY = np.uint64(2**64 - 1)


def _probe(bins: np.ndarray, attempt: int, n: int) -> np.ndarray:
    return (mix(bins * np.uint64(0x100000001) + np.uint64(attempt), 7) % np.uint64(n)).astype(np.int64)


PROBES = np.stack([_probe(np.arange(BINS, dtype=np.uint64), a, BINS) for a in range(256)])


def minima(hashes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Least hash of each bin; the bin is the hash's top bits."""
    out = np.full(bins, EMPTY)
    if len(hashes):
        ordered = np.sort(hashes)
        at = (ordered >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        out[at[first]] = ordered[first]
    return out


def densify(least: np.ndarray) -> np.ndarray:
    full = least != EMPTY
    if full.all() or not full.any():
        return least
    out = least.copy()
    if full.sum() == 1:
        out[:] = least[full][0]
        return out
    waiting, attempt = np.flatnonzero(~full), 0
    while len(waiting):
        if attempt < len(PROBES) and len(least) == BINS:
            to = PROBES[attempt][waiting]
        else:
            to = _probe(waiting.astype(np.uint64), attempt, len(least))
        hit = full[to]
        out[waiting[hit]] = least[to[hit]]
        waiting, attempt = waiting[~hit], attempt + 1
    return out


def low_bits(text: bytes, shingle: int = SHINGLE) -> np.ndarray | None:
    """Low-order bits of each bin; None for a text without words."""
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return None
    # hashed with the bin's number, so that a value lent to many bins does not meet another value by one chance in all of them
    values = mix(densify(minima(mix(hashes, 5))) + np.arange(BINS, dtype=np.uint64), 9)
    return (values & np.uint64(2**BITS - 1)).astype(np.uint8)


def packed(bits: np.ndarray | None) -> str:
    return "" if bits is None else (bits[::2] << BITS | bits[1::2]).astype(np.uint8).tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None:
        return float(a is b)
    chance = 2.0**-BITS
    return float(min(1.0, max(0.0, ((a == b).mean() - chance) / (1 - chance))))


def next_texts(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """bucket, own, doc_id, text: rows of a bucket in falling doc_id, then (own = false) the first row of the next bucket."""
    spark = docs.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = docs.filter("doc_id is not null")
    cuts = sorted({int(c) for c in known.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.1 / ranges)}) if ranges > 1 else []
    above = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c >= F.col("doc_id"))) if cuts else F.lit(0)
    docs = docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(above))
    tops = sorted(docs.groupBy("bucket").agg(F.max("doc_id").alias("top")).collect())  # one row per range
    before = {r.bucket: tops[i - 1].bucket for i, r in enumerate(tops)}
    rows = docs.withColumn("own", F.lit(True))
    if tops:
        wanted = F.col("doc_id").isin([r.top for r in tops if r.top is not None])
        if any(r.top is None for r in tops):
            wanted = F.coalesce(wanted, F.lit(False)) | F.col("doc_id").isNull()
        heads = docs.filter(wanted).groupBy("bucket", "doc_id").agg(F.min("text").alias("text"))
        to = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
        rows = rows.unionByName(heads.select("doc_id", "text", to[F.col("bucket")].alias("bucket"), F.lit(False).alias("own")))
    rows = rows.select("bucket", "own", "doc_id", "text").repartition(ranges, "bucket")
    return rows.sortWithinPartitions("bucket", F.desc("own"), F.desc_nulls_last("doc_id"), "text")


def edit(text: str, following: str) -> str:
    """The last third replaced by the beginning of the next text."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


def _sketches(batches: Batches) -> Batches:
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    held = None  # bucket, doc_id, text, low bits of the row that waits for the next
    for batch in batches:
        out = []
        for bucket, own, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not own and (held is None or held[0] != bucket):
                continue  # the next text has been seen already
            bits = low_bits(text.encode())
            if held is not None and held[0] == bucket:
                _, d, t, b = held
                changed = edit(t, text)
                raw = changed.encode()
                eb = b if changed == t else low_bits(raw)
                out.append((d, len(t), hashlib.sha256(raw).hexdigest(), packed(b), packed(eb), likeness(b, eb), likeness(b, bits)))
            held = (bucket, doc_id, text, bits) if own else None
        cols = list(zip(*out, strict=True)) if out else [()] * len(names)
        yield to_batch({n: (list(c), k) for n, c, k in zip(names, cols, kinds, strict=True)})


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of each text and of its edited text, and the likeness to that and to the next document."""
    return next_texts(docs).mapInArrow(
        _sketches, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
