import hashlib
import heapq
import random
import zlib

from barloom.llm import turns

KIND = "conv_id long, turn long, role string, text string, blk long, m string, key double"
SPACE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if draw == 0:
            continue
        text = "" if draw == 1 else "".join(ch for ch in text if ch not in ".!?") if draw == 2 else text
        out += [(turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))


def plainly(rows):
    """Cheapest way over all edit sequences, the ASCII-least first: a search over (row, last initials)."""
    rows, seen, faults = damaged(rows), set(), []
    for _, role, text in rows:
        end = text.rstrip(SPACE)
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    todo, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, made = heapq.heappop(todo)
        if i == len(rows) and state in ("", "a"):
            break
        if (i, state) in done:
            continue
        done.add((i, state))
        need, name = ("a", "assistant") if state == "u" else ("u", "user")
        heapq.heappush(todo, (cost + 3, audit + "I", i, need, (*made, f"{name}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(todo, (cost + 4, audit + "D", i + 1, state, made))
            if faults[i] in ("", "truncated"):
                late = 3 * (faults[i] == "truncated")
                if role[:1] == need or (role[:1] == "s" and state == ""):
                    heapq.heappush(todo, (cost + late, audit + "K", i + 1, role[:1], (*made, f"{role}:{text}")))
                heapq.heappush(todo, (cost + 3 + late, audit + "R", i + 1, need, (*made, f"{name}:{text}")))
    known = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return (max(known) - min(known) + 1 - len(set(known)) if known else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], KIND)


def compare(spark, rows):
    got = turns.Repair(table(spark, rows)).report().collect()
    by = {}
    for conv, *rest in rows:
        by.setdefault(conv, []).append((conv, *rest))
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((c, *plainly(r))) for c, r in by.items())


def some_rows(seed, conv, n, few=False):
    r = random.Random(seed)
    role = lambda: r.choice(["user", "assistant"] if r.random() < 0.8 else ["system", "tool", "", None, "usher"])
    text = lambda: r.choice(["Yes.", "no", "", " \t", None]) if few or r.random() < 0.3 else f"text {r.random()} é" + r.choice([".", "?\n", "!", ""])
    return [(conv, r.choice([None, i, i + 1, i]), role(), text()) for i in range(n)]


def test_against_a_search(spark):
    rows = [x for i in range(150) for x in some_rows(i, i - 3, i % 12, i % 3 == 0)]
    rows += [(None, None, None, None), (None, 1, "user", "Hi."), (None, 1, "user", "Hi."), (None, 2, "assistant", "x" * 100_000 + ".")]
    rows += [(9000, t, r, "Ok.") for t, r in enumerate(["user", "assistant"] * 8)] + [(9001, 0, "user", "same")] * 7 + [(9002, t, "system", f"{t}.") for t in range(9)]
    rows += [(c, 0, "user", None) for c in range(10_000, 10_040)]  # some of these lose their only row
    compare(spark, rows)
    assert turns.Repair(table(spark, [])).report().count() == 0


def test_one_conversation_over_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        rows = some_rows(1, 5, 300, True) + some_rows(2, 6, 250) + [(7, t, "user", f"{t}.") for t in range(130)] + [(8, 1, "user", "a.")] * 50
        repair = turns.Repair(table(spark, rows))
        assert repair.blocks.groupBy("c").count().filter("count > 2").count() >= 1
        compare(spark, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_long_runs_by_powers():
    for sym in range(9):
        v = turns.TO_END
        for n in range(1, 70):
            v = turns.applied(turns.one_row(sym), v)
            assert turns.advanced(sym, n, turns.TO_END) == v
            assert turns.applied(turns.block_matrix([(sym, n)]), turns.TO_END) == v
    audit, cost, state = turns.unrolled(((turns.symbol(False, "user", False), 100_001),))
    assert len(audit) - audit.count("I") == 100_001 and cost == 3 * 100_000 // 2 + 3 and state == 3
