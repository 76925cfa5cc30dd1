"""Best-fit decreasing packing of token pieces into sequences.

``pieces`` tokenises each document and cuts only those longer than a sequence.  Best fit depends on lengths alone, so the
driver holds one count per length (at most ``capacity`` of them, whatever the corpus), takes lengths in falling order and
asks a segment tree over remaining capacities for the tightest open bin: O(log capacity) per step.  Bins of equal remaining
capacity are kept as number ranges; all pieces of a length that go to one range are placed in one step.  The result is the plan
of one global best-fit-decreasing run, a few thousand rows (see ``MAX_STEPS``), which the pieces of a length meet by their rank.

Defined cases: a null text is empty and packs as its closing id alone; repeated rows are packed each; ties in length go by
document number and piece; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import array
import json
import re
import sys
import zlib
from bisect import insort
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import Batches, checkpointed, text_bytes, to_batch

CAPACITY = 1024
END_ID = 2
#: Each length opens at most two new ranges and splits at most one, so steps <= lengths * ranges; in practice about 10 per length.
MAX_STEPS = 2_000_000
#: Strings kept by each Python worker; the store is emptied when full.
CACHE = 600_000


class Ids(dict):
    """Token ids (little-endian unsigned 32-bit) of strings between spaces, found once per string.

    The vocabulary's pattern breaks before every space that follows a non-space, so these strings are tokenised alone.
    Texts are first cut at the added tokens of the tokenizer file beside the rank file, as that file's tokenizer does.
    """

    def __init__(self, vocabulary: str):
        super().__init__()
        import base64

        import tiktoken
        from public_tokenizers import PATTERN

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.piece = self.encoding._core_bpe.encode_single_piece
        self.added = added_tokens(vocabulary)
        longest = sorted(self.added, key=len, reverse=True)
        self.cuts = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None

    def __missing__(self, s: str) -> bytes:
        body = s[1:] if s[:1] == " " else s
        if body.isalpha():
            found = array.array("I", self.piece(s.encode())).tobytes()
        else:
            stem = body.rstrip(".,!?;:#$%&*")
            if stem.isalpha() and len(stem) < len(body):
                found = self[s[: len(s) - len(body) + len(stem)]] + self[body[len(stem):]]
            else:
                found = array.array("I", self.encoding.encode_ordinary(s)).tobytes()
        if len(self) >= CACHE:
            self.clear()
        self[s] = found
        return found

    def of_text(self, text: str) -> bytes:
        if self.cuts and any(a in text for a in self.added):
            parts = self.cuts.split(text)  # every second part is an added token
            return b"".join([array.array("I", [self.added[p]]).tobytes() if i % 2 else self.of_part(p) for i, p in enumerate(parts)])
        return self.of_part(text)

    def of_part(self, text: str) -> bytes:
        if not text:
            return b""
        if SPACES.search(text):  # here white space joins across the cut
            return array.array("I", self.encoding.encode_ordinary(text)).tobytes()
        head, *tail = text.split(" ")
        return b"".join([self[head], *[self[" " + w] for w in tail]])


SPACES = re.compile(r"\s \s|  | $")


def added_tokens(vocabulary: str) -> dict[str, int]:
    """Added tokens of the tokenizer file beside a rank file, none if there is no such file."""
    file = Path(vocabulary).with_suffix(".json")
    found = json.loads(file.read_text("utf-8"))["added_tokens"] if file.exists() else []
    if any(a[k] for a in found for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{file}: added tokens that do not match as plain strings")
    return {a["content"]: a["id"] for a in found}


def token_ids(text: str, vocabulary: str) -> bytes:
    stores = sys.__dict__.setdefault("_barloom_ids", {})  # kept by the process: what a task's function refers to is sent anew with every task
    if vocabulary not in stores:
        stores[vocabulary] = Ids(vocabulary)
    return stores[vocabulary].of_text(text)


def cut(ids: bytes, capacity: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of each piece: all but the first hold ``capacity`` ids."""
    n = len(ids) // 4
    first = n - (-(-n // capacity) - 1) * capacity
    bounds = [0, *range(first, n + 1, capacity)]
    return [(a, b - a, zlib.crc32(ids[4 * a:4 * b])) for a, b in zip(bounds, bounds[1:], strict=False)]


def _pieces(vocabulary: str, capacity: int, end: bytes):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            out: list[tuple] = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out += [(d, k, *p) for k, p in enumerate(cut(token_ids(t.decode(), vocabulary) + end, capacity))]
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}
            yield to_batch({n: (list(c), k) for (n, k), c in zip(kinds.items(), cols, strict=True)})
    return run


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32.  ``vocabulary``: a rank file (the same ids as its tokenizer file, but faster)."""
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("t"))
    run = _pieces(vocabulary or default_vocabulary(), capacity, array.array("I", [end_id]).tobytes())
    return raw.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class OpenBins:
    """Segment tree over remaining capacities: leaf c counts the open bins with c places left; ranges of bin numbers beside it."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def add(self, left: int, first: int, n: int) -> None:
        insort(self.ranges[left], (first, n))
        self._change(left, n)

    def take(self, left: int, most: int) -> tuple[int, int]:
        """Up to ``most`` bins with ``left`` places, from their first range."""
        first, n = self.ranges[left].pop(0)
        if n > most:
            self.ranges[left].insert(0, (first + most, n - most))
            n = most
        self._change(left, -n)
        return first, n

    def _change(self, left: int, n: int) -> None:
        i = left + self.size
        while i:
            self.count[i] += n
            i //= 2

    def tightest(self, length: int) -> int | None:
        """Least remaining capacity of at least ``length`` with an open bin."""
        i = length + self.size
        while not self.count[i]:
            while i & 1:  # up to the next right sibling
                i //= 2
                if i == 0:
                    return None
            i += 1
        while i < self.size:
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        return i - self.size


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, offset) for each run of pieces of a length."""
    bins, out, fresh = OpenBins(capacity), [], 0
    for length in sorted(counts, reverse=True):
        rank, n = 0, counts[length]
        while rank < n:
            left = bins.tightest(length)
            if left is None:  # new bins take as many of this length as fit; the last one takes the rest
                fit = capacity // length
                for k, each in (((n - rank) // fit, fit), (1, (n - rank) % fit)):
                    if not k or not each:
                        continue
                    for i in range(each):
                        out.append((length, rank, rank + k - 1, fresh, i * length))
                        rank += k
                    if capacity > each * length:
                        bins.add(capacity - each * length, fresh, k)
                    fresh += k
                break
            first, k = bins.take(left, n - rank)
            out.append((length, rank, rank + k - 1, first, capacity - left))
            if left > length:
                bins.add(left - length, first, k)
            rank += k
            if len(out) > MAX_STEPS:
                raise ValueError(f"more than {MAX_STEPS} packing steps")
    return out


def pack(found: DataFrame, capacity: int = CAPACITY, buckets: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32).

    The rank of a piece among those of its length is its rank in a hashed bucket plus the totals of the earlier buckets; one
    length may hold a third of all pieces.
    """
    spark = found.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = checkpointed(found.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(buckets)).cast("int")))
    totals = found.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = checkpointed(totals.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))))
    counts = {r.length: r.n for r in totals.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # one row per length
    steps = spark.createDataFrame(plan(counts, capacity), "length long, first long, last long, seq long, offset long")
    within = Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = found.withColumn("_in", F.row_number().over(within) - 1)
    ranked = ranked.join(totals.select("length", "_b", "_before"), ["length", "_b"]).withColumn("_rank", F.col("_in") + F.col("_before"))
    runs = steps.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "last", "seq", "offset"))).alias("_runs"))
    met = ranked.join(F.broadcast(runs), "length")  # at most ``capacity`` rows, MAX_STEPS runs
    run = F.filter("_runs", lambda r: (r["first"] <= F.col("_rank")) & (F.col("_rank") <= r["last"]))[0]
    return met.withColumn("_run", run).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_run.seq") + F.col("_rank") - F.col("_run.first")).alias("sequence_id"), F.col("_run.offset").alias("offset"))
