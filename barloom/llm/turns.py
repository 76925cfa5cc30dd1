"""Repair of conversations by the cheapest edits: a run-length DP over min-plus transitions.

A repaired conversation has the roles ``(s?(ua)+)?``, so while it is built it is in one of four states: nothing yet, after the system turn, after
a user turn, after an answer.  A row is a symbol: to be deleted, or its role's initial and whether it is truncated.  One symbol is a 4 x 4 matrix over (min, +), whose
entry is the cheapest way from state to state over one such row, insertions before it included.  Equal consecutive symbols are one run;
a run of n advances the costs to go by the binary powers of its matrix, which every task keeps for all conversations it sees.  The audit is then
unrolled from the front: a run is halved, the costs in its middle come from the powers again, and each row takes the ASCII-least edit that loses nothing.

Matrices compose, so no conversation has to fit in a task.  Rows without their texts are sorted by conversation and turn over range partitions; what a partition
holds of a conversation is a block.  Blocks give their product, the costs to go of the few blocks of cut conversations (at most two a partition) are
taken from these, blocks are unrolled for every state they may begin in, and a pass over their ends picks the one.  Texts join the kept rows afterwards and stream
in order through one running SHA-256 per conversation.

Defined cases: a null conv_id is a conversation of its own; nulls count as one space in the draw, role and text, and a null turn comes first; rows of
one turn are ordered by role, then by the SHA-256 of their text, so that the order of input rows is of no account; equal rows are counted before they are sorted; roles
other than system, user and assistant go by their initial; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import Batches, checkpointed, to_batch

SPACE = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
ROLES = "sua"
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.  Where an inserted or re-roled row leads, and what must follow to end.
AFTER, TO_END = (2, 2, 3, 2), (0, 2 * INSERT, INSERT, 0)
NEVER = 1 << 60
GONE = 0
#: Longest list of runs whose solution a task remembers, and number of them.
SHORT, REMEMBERED = 24, 65_536

Matrix = tuple[tuple[int, ...], ...]


def symbol(deleted: bool, role: str, truncated: bool) -> int:
    """0 for a row that must go, else 1 + 2 * role + truncated."""
    return GONE if deleted else 1 + 2 * (ROLES.find(role[:1]) % 4 if role else 3) + truncated


def moves(sym: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of one row, insertions aside."""
    out = [("D", DELETE, state)]
    if sym != GONE:
        role, late = divmod(sym - 1, 2)
        to = {0: 1 if state == 0 else None, 1: 2 if state != 2 else None, 2: 3 if state == 2 else None}.get(role)
        if to is not None:
            out.append(("K", late * TRUNCATED, to))
        out.append(("R", REROLE + late * TRUNCATED, AFTER[state]))
    return out


def product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(x + b[k][j] for k, x in enumerate(row)) for j in range(4)) for row in a)


def applied(a: Matrix, v: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(x + y for x, y in zip(row, v, strict=True)) for row in a)


UNIT: Matrix = tuple(tuple(0 if i == j else NEVER for j in range(4)) for i in range(4))


def one_row(sym: int) -> Matrix:
    out = []
    for state in range(4):
        row, s, paid = [NEVER] * 4, state, 0
        for _ in range(3):  # more insertions would come back to a state seen before
            for _, cost, to in moves(sym, s):
                row[to] = min(row[to], paid + cost)
            s, paid = AFTER[s], paid + INSERT
        out.append(tuple(row))
    return tuple(out)


POWERS: dict[int, list[Matrix]] = {}  # a plain value: it travels with the functions to executors that have no copy of this package


def power(sym: int, k: int) -> Matrix:
    """The matrix of 2**k equal rows."""
    known = POWERS.setdefault(sym, [one_row(sym)])
    while len(known) <= k:
        known.append(product(known[-1], known[-1]))
    return known[k]


def advanced(sym: int, n: int, v: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go before n equal rows, from those after them."""
    for k in range(n.bit_length()):
        if n >> k & 1:
            v = applied(power(sym, k), v)
    return v


def block_matrix(runs: list[tuple[int, int]]) -> Matrix:
    out = UNIT
    for sym, n in runs:
        for k in range(n.bit_length()):
            if n >> k & 1:
                out = product(out, power(sym, k))
    return out


def _unroll(sym: int, n: int, state: int, after: tuple[int, ...], out: list[str]) -> int:
    if n > 1:
        later = n // 2
        state = _unroll(sym, n - later, state, advanced(sym, later, after), out)
        return _unroll(sym, later, state, after, out)
    here = advanced(sym, 1, after)
    while True:
        edits = [(e, cost + after[to], to) for e, cost, to in moves(sym, state)] + [("I", INSERT + here[AFTER[state]], AFTER[state])]
        edit, _, to = min(x for x in edits if x[1] == here[state])
        out.append(edit)
        state = to
        if edit != "I":
            return state


def unrolled(runs: tuple[tuple[int, int], ...], after: tuple[int, ...] = TO_END, state: int = 0, last: bool = True) -> tuple[str, int, int]:
    """(audit, cost, state at the end) of runs that begin in ``state``; ``after``: costs to go behind them."""
    ends = [after]
    for sym, n in reversed(runs):
        ends.append(advanced(sym, n, ends[-1]))
    whole, out, start = ends.pop(), [], state
    for (sym, n), v in zip(runs, reversed(ends), strict=True):
        state = _unroll(sym, n, state, v, out)
    cost = whole[start] - after[state]
    while last and TO_END[state]:
        out.append("I")
        cost, state = cost + INSERT, AFTER[state]
    return "".join(out), cost, state


def kept(audit: str, rows: Iterator[tuple], state: int, role_at: int = 0) -> Iterator[tuple[tuple | None, str]]:
    """(row or None for an insertion, role) of what an audit leaves of ``rows``."""
    for edit in audit:
        row = None if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            state = next(t for e, _, t in moves(symbol(False, row[role_at], False), state) if e == "K")
            yield row, row[role_at]
        else:
            yield row, "assistant" if state == 2 else "user"
            state = AFTER[state]


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after the drawn faults: cn, c (conv_id is given, its value), tn, t (the same of turn), role, text, m (times the row is there, 0 if dropped)."""
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    name = F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    rows = conversations.select(
        conv.isNotNull().alias("cn"), F.coalesce(conv, F.lit(0)).alias("c"), turn.isNotNull().alias("tn"), F.coalesce(turn, F.lit(0)).alias("t"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        (F.crc32(name.cast("binary")) % 20).alias("draw"))
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("cn", "c", "tn", "t", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.when(F.col("draw") == 0, 0).when(F.col("draw") == 3, 2).otherwise(1).cast("long").alias("m"))


def _digest(text: str):
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def _sorted_rows(rows: DataFrame) -> DataFrame:
    """Equal rows as one with their number ``m``, faults marked, in range partitions that are numbered ``blk``."""
    gone = F.col("m") == 0
    end = F.rtrim("text", F.lit(SPACE))
    slim = rows.select(
        "cn", "c", gone.alias("gone"), F.when(gone, False).otherwise(F.col("tn")).alias("tn"), F.when(gone, 0).otherwise(F.col("t")).alias("t"),
        F.when(gone, "").otherwise(F.col("role")).alias("role"), F.when(gone, F.unhex(F.lit(""))).otherwise(_digest("text")).alias("key"),
        (end == "").alias("blank"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("late"), "m")
    key = ["cn", "c", "gone", "role", "key"]
    met = slim.groupBy(*key, "tn", "t").agg(F.sum("m").alias("m"), F.bool_or("blank").alias("blank"), F.bool_or("late").alias("late"))
    seen = met.groupBy(*key).agg(F.bool_or(~F.col("tn")).alias("null_turn"), F.min(F.when(F.col("tn"), F.col("t"))).alias("least"))
    first = F.when(F.col("null_turn"), ~F.col("tn")).otherwise(F.col("t") == F.col("least"))
    met = met.join(seen, key).select("cn", "c", "gone", "tn", "t", "role", "key", "m", "blank", "late", first.alias("first"))
    order = ["cn", "c", "gone", "tn", "t", "role", "key"]
    parted = met.repartitionByRange(*order).sortWithinPartitions(*order)
    return checkpointed(parted.withColumn("blk", F.spark_partition_id()))


def _conversations(batches: Batches) -> Iterator[tuple[tuple, list[tuple]]]:
    """((cn, c, blk), rows) of each block of a partition."""
    name, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:3] != name:
                if rows:
                    yield name, rows
                name, rows = row[:3], []
            rows.append(row[3:])
    if rows:
        yield name, rows


def _runs(rows: list[tuple]) -> tuple[tuple[int, int], ...]:
    """Run lengths of the symbols; after the first of equal rows the others must go."""
    parts = []
    for gone, _, _, role, _, m, blank, late, first, *_ in rows:
        if not gone:
            dead = blank or not first
            parts += [(symbol(dead, role, late), m if dead else 1)] + ([(GONE, m - 1)] if m > 1 and not dead else [])
    return tuple((sym, sum(n for _, n in group)) for sym, group in groupby(parts, lambda p: p[0]))


SUMMARY = "cn boolean, c long, blk int, blank long, duplicate long, truncated long, illegal long, first string, last string, lo long, hi long, turns long, matrix array<long>"


def _summaries(batches: Batches) -> Batches:
    out = []
    for name, rows in _conversations(batches):
        blank = duplicate = truncated = illegal = 0
        before, turns = None, set()
        first = None
        for gone, tn, t, role, _, m, is_blank, late, is_first, *_ in rows:
            if gone:
                continue
            initial = role[:1]
            if before is not None and before + initial not in ("su", "ua", "au"):
                illegal += 1
            illegal += m - 1  # a row beside its equal
            first = initial if before is None else first
            before = initial
            if tn:
                turns.add(t)
            if is_blank:
                blank += m
            elif not is_first:
                duplicate += m
            else:
                duplicate, truncated = duplicate + m - 1, truncated + bool(late)
        matrix = [x for row in block_matrix(_runs(rows)) for x in row]
        out.append((*name, blank, duplicate, truncated, illegal, first, before, min(turns, default=None), max(turns, default=None), len(turns), matrix))
        if len(out) == 4096:
            yield _rows(out, SUMMARY)
            out = []
    yield _rows(out, SUMMARY)


KINDS = {"boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return to_batch({n: (list(c), KINDS[k]) for (n, k), c in zip(names, cols, strict=True)})


def _costs_to_go(pdf):
    """For the blocks of one cut conversation, from the last to the first."""
    pdf = pdf.sort_values("blk", ascending=False)
    v, ends = TO_END, []
    for m in pdf["matrix"]:
        ends.append(list(v))
        v = applied(tuple(tuple(int(x) for x in m[4 * i:4 * i + 4]) for i in range(4)), v)
    pdf["ends"] = ends
    pdf["last"] = [i == 0 for i in range(len(pdf))]
    return pdf[["cn", "c", "blk", "ends", "last"]]


STEPS = ("cn boolean, c long, blk int, entry int, cut boolean, pos long, exit int, audit string, cost long, role string, was string, tn boolean, t long, key binary")


def _steps(batches: Batches) -> Batches:
    """Of each block and state it may begin in: a row (pos -1) with audit, cost and end state, and a row for everything it keeps or inserts."""
    out, known = [], {}
    for name, rows in _conversations(batches):
        runs, (ends, last) = _runs(rows), rows[0][-2:]
        end = (tuple(ends) if ends else TO_END, last is not False)
        for entry in range(4) if ends else (0,):
            found = known.get((runs, end, entry)) or unrolled(runs, end[0], entry, end[1])
            if len(runs) <= SHORT and len(known) < REMEMBERED:
                known[runs, end, entry] = found
            audit, cost, state = found
            out.append((*name, entry, bool(ends), -1, state, audit, cost, *[None] * 5))
            each = (r for r in rows if not r[0] for _ in range(r[5]))
            for pos, (row, role) in enumerate(kept(audit, each, entry, 3)):
                _, tn, t, was, key, *_ = row or [None] * 6
                out.append((*name, entry, bool(ends), pos, None, None, None, role, was, tn, t, key))
            if len(out) >= 8192:
                yield _rows(out, STEPS)
                out = []
    yield _rows(out, STEPS)


def _chosen(pdf):
    """The states in which the blocks of one cut conversation begin."""
    entry, keep = 0, []
    for _, block in pdf.sort_values("blk").groupby("blk", sort=True):
        row = block[block["entry"] == entry].iloc[0]
        keep.append(row)
        entry = row["exit"]
    return pdf.__class__(keep)[["cn", "c", "blk", "entry"]]


def _hashes(batches: Batches) -> Batches:
    """Sorted kept rows in, one digest per conversation out."""
    name, sha = None, None
    for batch in batches:
        out = []
        for cn, c, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            line = f"{role}:".encode() + (text or b"")
            if (cn, c) != name:
                if sha is not None:
                    out.append((*name, sha.hexdigest()))
                name, sha = (cn, c), hashlib.sha256(line)
            else:
                sha.update(b"\n" + line)
        yield _rows(out, "cn boolean, c long, sha string")
    if sha is not None:
        yield _rows([(*name, sha.hexdigest())], "cn boolean, c long, sha string")


class Repair:
    """The repair of a table: ``blocks`` (audits), ``lines`` (kept and inserted rows in order, without texts), ``counts`` per conversation."""

    def __init__(self, conversations: DataFrame):
        self.rows = damaged(conversations)
        rows = _sorted_rows(self.rows)
        cols = ["cn", "c", "blk", "gone", "tn", "t", "role", "key", "m", "blank", "late", "first"]
        summary = checkpointed(rows.select(*cols).mapInArrow(_summaries, SUMMARY))
        of = Window.partitionBy("cn", "c")
        cut = summary.withColumn("parts", F.count(F.lit(1)).over(of)).filter("parts > 1").select("cn", "c", "blk", "matrix")
        ends = cut.groupBy("cn", "c").applyInPandas(_costs_to_go, "cn boolean, c long, blk int, ends array<long>, last boolean")
        # only the first and the last conversation of a partition can be cut: at most two rows a partition are copied to all tasks
        steps = rows.select(*cols).join(F.broadcast(ends), ["cn", "c", "blk"], "left").select(*cols, "ends", "last")
        steps = checkpointed(steps.mapInArrow(_steps, STEPS))
        states = steps.filter("cut AND pos = -1").select("cn", "c", "blk", "entry", "exit")
        states = states.groupBy("cn", "c").applyInPandas(_chosen, "cn boolean, c long, blk int, entry int").withColumnRenamed("entry", "begins")
        steps = steps.join(F.broadcast(states), ["cn", "c", "blk"], "left").filter("NOT cut OR entry = begins")
        self.blocks = steps.filter("pos = -1").select("cn", "c", "blk", "audit", "cost")
        self.lines = steps.filter("pos >= 0").select("cn", "c", "blk", "pos", "role", "was", "tn", "t", "key")
        order = of.orderBy("blk")
        joint = F.lag("last").over(order)
        s = summary.withColumns({"joint": joint, "over": F.lag("hi").over(order)})
        bad = F.col("first").isNotNull() & F.col("joint").isNotNull() & ~F.concat("joint", "first").isin("su", "ua", "au")
        self.counts = s.groupBy("cn", "c").agg(
            (F.coalesce(F.max("hi") - F.min("lo") + 1 - F.sum("turns") + F.count_if(F.col("over") == F.col("lo")), F.lit(0))).alias("gaps"),
            *[F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated")], (F.sum("illegal") + F.count_if(bad)).alias("illegal"))

    def turns(self) -> DataFrame:
        """The repaired turns: conv_id, blk and pos (their order), role, text (of an insertion: empty)."""
        key = ["cn", "c", "tn", "t", "was", "key"]
        texts = self.rows.filter("m > 0").withColumn("key", _digest("text")).withColumnRenamed("role", "was").dropDuplicates(key).select(*key, "text")
        met = self.lines.join(texts, key, "left")
        return met.select("cn", "c", "blk", "pos", "role", F.coalesce("text", F.lit("")).alias("text"))

    def report(self) -> DataFrame:
        """One row per conv_id: gaps, faults, cost, audit and digest of the repaired lines."""
        audits = self.blocks.groupBy("cn", "c").agg(F.sum("cost").alias("cost"), F.sort_array(F.collect_list(F.struct("blk", "audit"))).alias("parts"))
        lines = self.turns().repartition("cn", "c").sortWithinPartitions("cn", "c", "blk", "pos")
        hashes = lines.select("cn", "c", "role", F.col("text").cast("binary").alias("text")).mapInArrow(_hashes, "cn boolean, c long, sha string")
        out = self.counts.join(audits, ["cn", "c"], "left").join(hashes, ["cn", "c"], "left")
        return out.select(
            F.when(F.col("cn"), F.col("c")).alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", F.coalesce("cost", F.lit(0)).cast("long").alias("cost"),
            F.coalesce(F.array_join("parts.audit", ""), F.lit("")).alias("audit"), F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
