"""Connected components of an edge table by alternating star contractions, in DataFrame joins.

Before the first round each task draws the edges that it holds as stars, ``CONTRACTED`` at a time; this changes no component, and edges that fit one task need no round.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import TASK_ROWS, Batches, checkpointed, hot_join, release, sized, to_batch

#: Edges that a task draws as stars at once, whatever it holds.
CONTRACTED = 4 * TASK_ROWS


def stars(links: list[tuple]) -> list[tuple]:
    """Pairs (least, other) of each connected part of ``links``."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [(find(x), x) for x in root if find(x) != x]


def _contracted(batches: Batches) -> Batches:
    """Edges (a, b) with the same components, (other, least) of each connected part of up to ``CONTRACTED`` of them."""
    links: list[tuple] = []
    kind = None

    def drawn() -> pa.RecordBatch:
        ends = stars(links)
        return to_batch({"a": ([x for _, x in ends], kind), "b": ([x for x, _ in ends], kind)})

    for batch in batches:
        kind = batch.schema.field(0).type
        links += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        if len(links) >= CONTRACTED:
            yield drawn()
            links.clear()
    if links:
        yield drawn()


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """Hang the larger (``large``) or smaller neighbours of each node u on the least of u and its neighbours; ``total``: at least twice the edges."""
    both = sized(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), total)
    least = sized(both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("m"), F.count(F.lit(1)).alias("n")), total)
    side = both.filter("b > a") if large else both.filter("b < a")
    hung = hot_join(side, least, ["a"], F.col("b"), total)
    out = hung.select(F.col("b").alias("x"), "m")
    if not large:
        out = out.unionByName(least.filter("m < a").select(F.col("a").alias("x"), "m"))
    # at most one row for each of ``both``, and one for each of its nodes
    ends = sized(out.filter("x <> m"), 2 * total).select(F.greatest("x", "m").alias("a"), F.least("x", "m").alias("b"))
    return sized(ends.distinct(), 2 * total)


def _open(edges: DataFrame, total: int) -> int:
    """Number of nodes at which the edges (``total``) are not yet stars: with two lower neighbours, or with one below and one above."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = sized(ends.unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("down"), F.lit(1).alias("up"))), 2 * total)
    nodes = sized(ends.groupBy("v").agg(F.sum("down").alias("down"), F.sum("up").alias("up")), 2 * total)
    return nodes.agg(F.count_if(F.expr("down > 1 OR (down > 0 AND up > 0)"))).first()[0]


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, root): the least node that each node of ``edges`` (a, b) reaches; nodes without an edge are absent.

    ``most``: number of edges or more, where it is known.

    Ends when every edge points from a node to its root; the number of rounds grows with the logarithm of the size.
    """
    once = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    once = once if most is None else sized(once, most)
    cur = checkpointed(once.mapInArrow(_contracted, once.schema))
    n = cur.count()
    open_ = _open(cur, n)
    while open_:
        cur = checkpointed(_star(_star(sized(cur, n), True, 2 * n), False, 2 * n))  # the first of them adds no edge
        release(cur.sparkSession)
        n = cur.count()
        open_ = _open(cur, n)
    cur = sized(cur, n)
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(cur.select(F.col("b"), F.col("b")).distinct().toDF("node", "root"))
