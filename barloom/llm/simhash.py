"""Near duplicates by SimHash: a byte-position inverted index with count filtering.

A fingerprint of m bytes is indexed under chosen sets of byte positions: key = the set's number and the bytes there.  Rows of
one key share those positional bytes; for each pair in the list the shared positional bytes are tallied, pairs with fewer than
``min_shared`` are dropped and the others verified by their differing bits.  With 8 bytes and 3 bits, at least 5 positional
bytes agree, and each 5 of 8 positions hold one of ``FOUR_OF_EIGHT``, so no linked pair is missed while a list is
as rare as 32 equal bits.

Equal fingerprints are one node.  A list is searched breadth first in NumPy (linked rows leave the unvisited ones), and only a
spanning forest of its links goes on, never its pairs.  For groups the forest of a list is drawn as stars, from the least row of each
tree to its others: lists that hold the same rows then give the same pairs, of which one goes on.  Lists of more than ``WIDE`` rows are first cut by the bytes at the
remaining positions, of which the count filter needs at least one; this again loses no pair.

Defined cases: null text as empty; texts without a word have fingerprint zero and link like any other; fewer words than
the shingle width: the whole sequence is the one shingle; null document numbers take part and are below all others when
a group's smallest number is taken only if no other is there; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import Batches, checkpointed, hot_join, row_keys, text_bytes, to_batch, words
from barloom.llm.components import components
from barloom.llm.components import stars as drawn_stars

#: Fourteen sets of four positions; every five of the eight positions contain one of them.
FOUR_OF_EIGHT = ((0, 1, 2, 3), (4, 5, 6, 7)) + tuple(
    a + b
    for left, right in zip((((0, 1), (2, 3)), ((0, 2), (1, 3)), ((0, 3), (1, 2))), (((4, 5), (6, 7)), ((4, 6), (5, 7)), ((4, 7), (5, 6))), strict=True)
    for a in left for b in right
)
WIDE = 20_000


@dataclass(frozen=True)
class Index:
    """Shingle width, bytes of a fingerprint, indexed position sets, least shared bytes, most differing bits."""

    shingle: int = 3
    n_bytes: int = 8
    positions: Sequence[tuple[int, ...]] = FOUR_OF_EIGHT
    min_shared: int = 5
    max_bits: int = 3


#: Three-word shingles and at most 3 of 64 bits: no pair is missed.
STRICT = Index()


def similar(n_bytes: int = 32, tables: int = 64, shingle: int = 5, similarity: float = 0.8) -> Index:
    """Index for a given Jaccard similarity of shingle sets.

    Sets of similarity s differ in a share acos(2s / (1 + s)) / pi of their bits (0.152 at 0.8).  A link is allowed one standard
    deviation more.  Each of ``tables`` keys holds two byte positions; two texts at 0.8 share one with probability 0.99.
    """
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    bits = 8 * n_bytes
    pairs = list(itertools.combinations(range(n_bytes), 2))
    order = np.random.default_rng(11).permutation(len(pairs))
    uses, chosen = np.zeros(n_bytes, int), []
    for cap in range(1, n_bytes):  # each position equally often
        for i in order:
            p = pairs[i]
            if len(chosen) < tables and p not in chosen and max(uses[list(p)]) < cap:
                chosen.append(p)
                uses[list(p)] += 1
    return Index(shingle, n_bytes, tuple(chosen), 3, int(bits * share + np.sqrt(bits * share * (1 - share))))


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle, repeats included."""
    ws = words(text)
    if not ws:
        return np.empty(0, np.uint64)
    joined = b" ".join(ws)
    ends = np.cumsum([len(w) + 1 for w in ws])
    if len(ws) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    starts, stops = np.concatenate(([0], ends[:-width])).tolist(), (ends[width - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))


def mix(h: np.ndarray, salt: int) -> np.ndarray:
    """Another 64-bit hash of each value; salt 0 leaves it."""
    if not salt:
        return h
    z = h + np.uint64((0x9E3779B97F4A7C15 * salt) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(hashes: np.ndarray, n_bytes: int = 8) -> bytes:
    """Big-endian 64-bit words; a bit is 1 if it is set in over half of the hashes."""
    out = b""
    for word in range(n_bytes // 8):
        ones = np.zeros(64, np.int64)
        for i in range(0, len(hashes), 65_536):  # a long text in parts
            part = mix(hashes[i:i + 65_536], word).astype(">u8")
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out += np.packbits(2 * ones > len(hashes)).tobytes()
    return out


def _prints(index: Index):
    def run(batches: Batches) -> Batches:
        for b in batches:
            prints = [fingerprint(shingle_hashes(t, index.shingle), index.n_bytes) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prints, pa.binary())], ["doc_id", "_rk_h", "fp"])
    return run


def fingerprints(docs: DataFrame, index: Index = STRICT) -> DataFrame:
    """doc_id, _rk_h (hash of the raw text), fp binary."""
    raw = row_keys(docs.select("doc_id", "text")).select(F.col("doc_id").cast("long"), "_rk_h", text_bytes().alias("t"))
    return raw.mapInArrow(_prints(index), "doc_id long, _rk_h long, fp binary")


def _links(rows: np.ndarray, index: Index, rest: tuple[int, ...]) -> list[tuple[int, int]]:
    """Spanning forest of the linked rows of one list; ``rest``: positions not known to agree."""
    if len(rows) > WIDE and rest and index.min_shared > index.n_bytes - len(rest):
        out = []
        for p in rest:  # one of them agrees in each pair that passes the count filter
            order = np.argsort(rows[:, p], kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(rows[order, p])) + 1):
                out += [(part[a], part[b]) for a, b in _links(rows[part], index, tuple(x for x in rest if x != p))]
        return out
    out, left, todo = [], np.arange(len(rows)), []
    while len(left):
        if not todo:
            todo, left = [left[0]], left[1:]
        a = todo.pop()
        shared = (rows[left] == rows[a]).sum(axis=1) >= index.min_shared
        hit = np.zeros(len(left), bool)
        hit[shared] = np.bitwise_count(rows[left[shared]] ^ rows[a]).sum(axis=1, dtype=np.int64) <= index.max_bits
        out += [(a, b) for b in left[hit]]
        todo += left[hit].tolist()
        left = left[~hit]
    return out


def _list_links(index: Index, stars: bool, kind: pa.DataType):
    """Sorted (key, name, fp) rows in, links (a, b) between names out; the rows of a key may span batches."""
    def links_of(keys: list[bytes], names: list, prints: np.ndarray, out: list) -> None:
        cuts = np.flatnonzero(np.array([x != y for x, y in itertools.pairwise(keys)], bool)) + 1
        starts, stops = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
        for i in np.flatnonzero(stops - starts > 1):
            known = index.positions[keys[starts[i]][0]]
            rest = tuple(p for p in range(index.n_bytes) if p not in known)
            found = _links(prints[starts[i]:stops[i]], index, rest)
            here = names[starts[i]:stops[i]]
            out += [(here[a], here[b]) for a, b in (drawn_stars(found) if stars else found)]

    def run(batches: Batches) -> Batches:
        keys: list[bytes] = []
        names: list = []
        prints = np.empty((0, index.n_bytes), np.uint8)
        for batch in itertools.chain(batches, [None]):
            out: list[tuple] = []
            if batch is None:
                last = len(keys)
            else:
                prints = np.concatenate((prints, np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, index.n_bytes)))
                keys, names = keys + batch.column(0).to_pylist(), names + batch.column(1).to_pylist()
                last = len(keys)
                while last and keys[last - 1] == keys[-1]:  # the last key may go on
                    last -= 1
            if last:
                links_of(keys[:last], names[:last], prints[:last], out)
            keys, names, prints = keys[last:], names[last:], prints[last:]
            yield to_batch({"a": ([a for a, _ in out], kind), "b": ([b for _, b in out], kind)})
    return run


def near_links(prints: DataFrame, index: Index = STRICT, stars: bool = False, node: str = "fp") -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that connect whatever any pair within the limits connects.

    ``node``: column that names a print in the links, the print itself or a number unique to it (then prints must be distinct).
    With ``stars`` the pairs connect the same rows, but may be farther apart than a link.
    """
    keys = F.array(*[
        F.concat(F.unhex(F.lit(f"{n:02x}")), *[F.substring("fp", p + 1, 1) for p in positions]) for n, positions in enumerate(index.positions)
    ])
    named = prints.select("fp").distinct() if node == "fp" else prints
    listed = named.select(F.explode(keys).alias("key"), F.col(node).alias("name"), "fp")
    parted = listed.repartition("key").sortWithinPartitions("key", "name")
    kind, arrow = ("binary", pa.binary()) if node == "fp" else ("long", pa.int64())
    return parted.mapInArrow(_list_links(index, stars, arrow), f"a {kind}, b {kind}").distinct()


def near_groups(docs: DataFrame, index: Index = STRICT) -> DataFrame:
    """Per row: doc_id, _rk_h, fp, component_id (smallest doc_id that the row reaches, itself included) and ``kept``.

    Of a group the row with the smallest doc_id (then the smallest _rk_h) is marked kept; rows equal in both are all marked.
    """
    prints = checkpointed(fingerprints(docs, index))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_rk_h"))
    nodes = prints.groupBy("fp").agg(least.alias("least"), F.count(F.lit(1)).alias("rows"))
    nodes = checkpointed(nodes.withColumn("node", F.monotonically_increasing_id()))  # a number per distinct print is what goes through the joins
    n_nodes, n_rows = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    roots = components(near_links(nodes, index, stars=True, node="node"))
    nodes = checkpointed(nodes.join(roots, "node", "left").select("fp", "least", "rows", F.coalesce("root", "node").alias("root")))
    tops = nodes.groupBy("root").agg(F.min("least").alias("top"), F.count(F.lit(1)).alias("n"))
    tops = hot_join(nodes.select("fp", "root", "rows"), tops, ["root"], F.col("fp"), n_nodes).select("fp", "rows", "top")
    out = hot_join(prints, tops, ["fp"], F.struct("doc_id", "_rk_h"), n_rows, "rows")
    same = F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & F.col("_rk_h").eqNullSafe(F.col("top._rk_h"))
    return out.select("doc_id", "_rk_h", "fp", F.col("top.doc_id").alias("component_id"), same.alias("kept"))
