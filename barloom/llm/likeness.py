"""Near duplicates by SimHash links and exact likeness of shingle sets: every pair that reaches the likeness counts, nothing is estimated.

Shingles are put in order of (number of texts that hold them, hash), the rarest first.  Of two sets with Jaccard similarity of at least t, the first
``n - ceil(t * n) + 1`` shingles of both (n: size of each) have one in common, so the lists of texts by such a shingle hold every pair sought.  A shingle of one text only
is in no list: most texts begin with that many of them and leave at once, and a line that thousands of texts share comes last in each and makes no list.
What is left of a set, its shingles that other texts hold too, is written once and serves all verification, since only such shingles can be shared.

* Counting: a first pass takes the load of hash buckets per task and so finds the heavy ones, fewer than ``HEAVY`` in any table.  Shingles in them
  need no counting and skip its exchange, which therefore has no hot key; the others are counted where they meet.
* Linking: fingerprints of the same sets go through the byte-position index of ``simhash``; its links are verified by the sets and join most groups of near copies.
* Completing: lists whose texts are not in one component yet are worked off in rounds.  A few leaders of each list meet all others of it, pairs that the places
  of the shingle or the parities of the sets rule out and pairs that an earlier list holds are dropped, the links found are joined into components, leaders leave and so does any list that is in one component.
  Members of a list's small components lead first, so n near copies of one text cost n pairs, not n^2; pairs inside a component are never needed.

Texts of equal sets are one node.  ``docs`` is read twice and must give the same rows in the same order again, as a table does.  Files of a round are removed after the next.

Defined cases: as in ``simhash`` for null texts, short texts and null document numbers; texts without a word have equal (empty) sets.
"""

from __future__ import annotations

from collections.abc import Iterable
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import Batches, forget, hot_join, release, row_keys, scratch, sized, text_bytes
from barloom.llm.components import components
from barloom.llm.simhash import Index, fingerprint, near_links, shingle_hashes

#: Leaders of each list in the first round and the factor by which later rounds take more.
LEADERS, GROWTH = 1, 8
#: Buckets of shingle hashes; a bucket is heavy with more than 1 / HEAVY of all shingles, so fewer than HEAVY are.
BUCKETS, HEAVY = 1 << 16, 1024
#: A row of a list names so many of the lists before it that hold its set, the nearest ones.
EARLIER = 8
#: Words of 64 bits that hold the parities of a set.
WORDS = 4
#: Pairs of sets that one task compares at least.
COMPARED = 1 << 12
#: Most shingles in one batch that a task sends on.
SENT = 1 << 18
#: Columns of the lists.
LISTED = ("key", "node", "size", "alone", "bits", "pos", "earlier")


def prefix_length(n: int, likeness: Fraction) -> int:
    return n + (-n * likeness.numerator // likeness.denominator) + 1 if n else 0


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def _described(shingle: int):
    """A row for each text, and after the last one a row (fp null; rid: bucket, size: load) for each bucket that is heavy among the task's shingles."""
    def run(batches: Batches) -> Batches:
        load = np.zeros(BUCKETS, np.int64)
        names = ["rid", "doc_id", "_rk_h", "fp", "size", "sim"]
        for b in batches:
            fps, sizes, sims = [], [], []
            for t in b.column(3).to_pylist():
                s = np.unique(shingle_hashes(t, shingle))
                fps.append(xxhash.xxh3_128_digest(s.astype("<u8").tobytes()))
                sizes.append(len(s))
                sims.append(fingerprint(s))
                if len(s) > BUCKETS // 16:
                    load += np.bincount(_bucket(s), minlength=BUCKETS)
                else:
                    np.add.at(load, _bucket(s), 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(fps, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sims, pa.binary())], names)
        heavy = np.flatnonzero(load > load.sum() // (2 * HEAVY))
        none = pa.nulls(len(heavy))
        yield pa.RecordBatch.from_arrays([pa.array(heavy, pa.int64()), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()),
                                          pa.array(load[heavy], pa.int64()), none.cast(pa.binary())], names)
    return run


def _members(shingle: int, heavy: dict[int, int]):
    """(rid, h, df) for every shingle; df: the load of a heavy bucket, 0 if the shingle is to be counted."""
    known = np.zeros(BUCKETS, np.int64)
    known[list(heavy.keys())] = list(heavy.values())

    def sent(rids: list[int], sets: list[np.ndarray]) -> Iterable[pa.RecordBatch]:
        h = np.concatenate([np.empty(0, np.uint64), *sets])
        rid = np.repeat(np.array(rids, np.int64), [len(s) for s in sets])
        for i in range(0, len(h), SENT):
            part = h[i:i + SENT]
            yield pa.RecordBatch.from_arrays([pa.array(rid[i:i + SENT]), pa.array(part.view(np.int64)), pa.array(known[_bucket(part)])], ["rid", "h", "df"])

    def run(batches: Batches) -> Batches:
        rids, sets, n = [], [], 0
        for b in batches:
            for rid, t in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
                s = np.unique(shingle_hashes(t, shingle))
                rids.append(rid)
                sets.append(s)
                n += len(s) + 1
                if n >= SENT:
                    yield from sent(rids, sets)
                    rids, sets, n = [], [], 0
        yield from sent(rids, sets)
    return run


def _reaches(shared: Column, a: Column, b: Column, likeness: Fraction) -> Column:
    """shared / (a + b - shared) >= likeness, in whole numbers."""
    return shared * F.lit(likeness.numerator + likeness.denominator) >= F.lit(likeness.numerator) * (a + b)


def _parities(members: str) -> Column:
    """``WORDS`` words; a bit tells whether an odd number of the members fall on it."""
    at = "shiftleft(IF(shiftright(h, 6) & {mask} = {w}, 1L, 0L), CAST(h & 63 AS INT))"
    return F.array(*[F.expr(f"aggregate({members}, 0L, (acc, h) -> acc ^ {at.format(mask=WORDS - 1, w=w)})") for w in range(WORDS)])


def _may_reach(a: str, b: str, likeness: Fraction) -> Column:
    """False only where two sets (columns size, alone, bits with the suffixes ``a`` and ``b``) differ in too many shingles.

    They differ in those that no other text holds, and in at least as many of the others as their parities differ in bits.
    """
    apart = sum((F.bit_count(F.col(f"bits{a}")[w].bitwiseXOR(F.col(f"bits{b}")[w])) for w in range(WORDS)), F.col(f"alone{a}") + F.col(f"alone{b}"))
    p, q = likeness.numerator, likeness.denominator
    return apart * F.lit(p + q) <= F.lit(q - p) * (F.col(f"size{a}") + F.col(f"size{b}"))


def verified(pairs: DataFrame, sets: DataFrame, likeness: Fraction) -> DataFrame:
    """Of ``pairs`` (a, b and others), those whose sets (node, size, members: the shingles that other texts hold too) reach the likeness."""
    counts = pairs.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    total = pairs.count()
    left = sets.join(counts, "node").select(F.col("node").alias("a"), F.col("members").alias("of_a"), F.col("size").alias("size_a"), "n")
    right = pairs.join(sets.select(F.col("node").alias("b"), F.col("members").alias("of_b"), F.col("size").alias("size_b")), "b")
    met = sized(hot_join(right, left, ["a"], F.col("b"), total), total, COMPARED)
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return met.filter(_reaches(shared, F.col("size_a"), F.col("size_b"), likeness)).select(*pairs.columns)


def _several(lists: DataFrame, name: str, most: int) -> DataFrame:
    """Lists (``most`` rows or fewer) in which ``name`` has more than one value."""
    ends = sized(lists.groupBy("key").agg(F.min(name).alias("_lo"), F.max(name).alias("_hi")), most).filter("_lo < _hi").select("key")
    return sized(lists.join(ends, "key", "left_semi"), most)


def _rooted(lists: DataFrame, roots: DataFrame, most: int) -> DataFrame:
    """Lists (``LISTED``; ``most`` rows or fewer) of more than one component, with the component of each row."""
    at = sized(lists.join(roots, "node", "left"), most).withColumn("root", F.coalesce("root", "node"))
    return _several(at, "root", most).select(*LISTED, "root")


class _Files:
    """Tables of a round in the shared folder; those of the round before are removed when the next begins."""

    def __init__(self, spark):
        self.spark, self.now, self.old = spark, [], []

    def put(self, df: DataFrame) -> DataFrame:
        at = scratch(self.spark, "near")
        df.write.parquet(at)
        self.now.append(at)
        return self.spark.read.parquet(at)

    def next_round(self) -> None:
        self._remove(self.old)
        self.now, self.old = [], self.now

    def end(self) -> None:
        self._remove(self.old + self.now)

    def _remove(self, paths: list[str]) -> None:
        for at in paths:
            forget(self.spark, at)
        release(self.spark)


def _joined(roots: DataFrame, links: DataFrame, n_roots: int) -> DataFrame:
    """``roots`` (node, root; ``n_roots`` rows) after links (a, b) between roots."""
    merged = components(links, links.count()).withColumnRenamed("root", "to").withColumnRenamed("node", "root")
    return sized(roots.join(merged, "root", "left"), n_roots).select("node", F.coalesce("to", "root").alias("root"))


def exact_roots(lists: DataFrame, sets: DataFrame, roots: DataFrame, likeness: Fraction, keep: _Files) -> DataFrame:
    """``roots`` (node, root; every node of a list) after all pairs that share a list (``LISTED``) and reach the likeness, in ``keep``.

    ``pos``: place of the key in the node's set; ``earlier``: keys shortly before it; ``bits``: parities of the set.  A pair is left to the first list that holds both,
    where it is met in any case, so lists in which both have an earlier key in common drop it.
    """
    files, leaders = _Files(lists.sparkSession), LEADERS
    n_roots, n = roots.count(), lists.count()
    while True:
        lists = files.put(_rooted(lists, roots, n))
        n = lists.count()
        if not n:
            roots = keep.put(roots)
            files.end()
            return roots
        same = Window.partitionBy("key", "root")
        order = Window.partitionBy("key").orderBy("n", "root", "node")
        counted = sized(lists.withColumn("n", F.count(F.lit(1)).over(same)), n)
        ranked = files.put(sized(counted.withColumn("rank", F.row_number().over(order)), n))
        first = ranked.filter(F.col("rank") <= leaders).select("key", *[F.col(x).alias(f"{x}_a") for x in (*LISTED[1:], "root", "rank")])
        most = F.least(F.col("size") - F.col("pos"), F.col("size_a") - F.col("pos_a"))  # shared at most, if the key is the first that both hold
        met = ranked.join(first, "key").filter((F.col("rank") > F.col("rank_a")) & (F.col("root") != F.col("root_a")))
        met = met.filter(_may_reach("", "_a", likeness) & ~F.arrays_overlap("earlier", "earlier_a"))
        met = sized(met.filter(_reaches(most, F.col("size"), F.col("size_a"), likeness)), n * leaders)
        pairs = met.select(F.col("node_a").alias("a"), F.col("node").alias("b"), F.col("root_a").alias("ra"), F.col("root").alias("rb")).distinct()
        pairs = files.put(sized(pairs, n * leaders))
        links = verified(pairs, sets, likeness).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        links = files.put(sized(links, pairs.count()))
        roots = files.put(_joined(roots, links, n_roots) if not links.isEmpty() else roots)  # few components are left after the first round
        lists = ranked.filter(F.col("rank") > leaders).select(*LISTED)
        leaders *= GROWTH
        files.next_round()


class Candidates:
    """``rows`` (one per text), ``nodes`` (one per distinct set), ``sets`` and ``lists`` of the nodes that may have a partner.

    The first two are written to ``keep``, the others to ``files``.
    """

    def __init__(self, docs: DataFrame, shingle: int, likeness: Fraction, keep: _Files | None = None, files: _Files | None = None):
        keep, files = keep or _Files(docs.sparkSession), files or _Files(docs.sparkSession)
        raw = row_keys(docs.select("doc_id", "text")).select(
            F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), "_rk_h", text_bytes().alias("t"))
        seen = keep.put(raw.mapInArrow(_described(shingle), "rid long, doc_id long, _rk_h long, fp binary, size long, sim binary"))
        self.rows = seen.filter("fp IS NOT NULL")
        least = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_rk_h", "rid"))
        nodes = self.rows.groupBy("fp").agg(least.alias("least"), F.count(F.lit(1)).alias("rows"), F.first("size").alias("size"), F.first("sim").alias("sim"))
        self.nodes = keep.put(nodes.withColumn("node", F.col("least.rid")))  # one row stands for each set
        loads = seen.filter("fp IS NULL").groupBy("rid").agg(F.sum("size").alias("load"))
        total = self.rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        heavy = {r["rid"]: r["load"] for r in loads.filter(F.col("load") > total // (2 * HEAVY)).collect()}  # fewer than 2 * HEAVY

        members = raw.mapInArrow(_members(shingle, heavy), "rid long, h long, df long")
        counted = members.filter("df = 0").select("rid", "h", F.count(F.lit(1)).over(Window.partitionBy("h")).alias("df")).filter("df > 1")
        shared = counted.unionByName(members.filter("df > 0")).groupBy(F.col("rid").alias("node")).agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("m"))
        met = shared.join(self.nodes.select("node", "size", "sim"), "node").withColumn("members", F.col("m.h"))
        alone = F.col("size") - F.size("members")  # these come first
        head = F.col("size") - F.expr(f"(size * {likeness.numerator} + {likeness.denominator - 1}) div {likeness.denominator}") + 1
        met = met.withColumn("alone", alone).withColumn("heads", F.slice("members", 1, F.greatest(head - alone, F.lit(0)).cast("int")))
        # parities here, once for each set: beside posexplode they would be taken for each row of a list
        self.sets = files.put(met.filter(F.size("heads") > 0).select("node", "size", "sim", "alone", "members", "heads", _parities("members").alias("bits")))
        most = self.sets.agg(F.coalesce(F.sum(F.size("heads")), F.lit(0))).first()[0]
        lists = self.sets.select("node", "size", "alone", "bits", "heads", F.posexplode("heads").alias("at", "key"))
        earlier = F.slice("heads", F.greatest(F.col("at") - EARLIER, F.lit(0)) + 1, F.least(F.col("at"), F.lit(EARLIER)))
        lists = lists.withColumn("pos", F.col("alone") + F.col("at")).withColumn("earlier", earlier).select(*LISTED)
        self.lists = files.put(_several(lists, "node", most))


def near_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Per row: doc_id, _rk_h, fp (digest of the set), component_id (smallest doc_id that the row reaches, itself included) and ``kept``.

    Of a group the row with the smallest doc_id (then the smallest _rk_h) is marked kept; rows equal in both are all marked.
    """
    likeness = Fraction(similarity).limit_denominator(1000)
    keep, files = _Files(docs.sparkSession), _Files(docs.sparkSession)
    found = Candidates(docs, shingle, likeness, keep, files)
    rows, nodes = found.rows, found.nodes
    n_nodes, n_rows = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()

    roots = found.sets.select("node", F.col("node").alias("root"))
    near = files.put(near_links(found.sets.select("node", F.col("sim").alias("fp")), Index(shingle=shingle), node="node"))
    release(docs.sparkSession)
    links = files.put(verified(near, found.sets, likeness))
    release(docs.sparkSession)
    if not links.isEmpty():
        roots = files.put(_joined(roots, links, roots.count()))
    roots = exact_roots(found.lists, found.sets, roots, likeness, keep)
    files.end()

    nodes = keep.put(sized(nodes.join(roots, "node", "left"), n_nodes).select("fp", "least", "rows", F.coalesce("root", "node").alias("root")))
    tops = nodes.groupBy("root").agg(F.min("least").alias("top"), F.count(F.lit(1)).alias("n"))
    tops = hot_join(nodes.select("fp", "root", "rows"), tops, ["root"], F.col("fp"), n_nodes).select("fp", "rows", "top")
    out = hot_join(rows.select("doc_id", "_rk_h", "fp"), tops, ["fp"], F.struct("doc_id", "_rk_h"), n_rows, "rows")
    same = F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & F.col("_rk_h").eqNullSafe(F.col("top._rk_h"))
    return out.select("doc_id", "_rk_h", "fp", F.col("top.doc_id").alias("component_id"), same.alias("kept"))
