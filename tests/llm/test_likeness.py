import random
from fractions import Fraction

from fixtures import doc_rows, docs

from barloom.llm import likeness


def shingles(t):
    ws = (t or "").encode().lower().split()
    return frozenset(tuple(ws[i:i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()


def brute_force(rows):
    """Least document number of each row's group."""
    sets = {d: shingles(t) for d, t in rows}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ds = sorted(sets)
    for i, a in enumerate(ds):
        for b in ds[i + 1:]:
            n = len(sets[a] & sets[b])
            if sets[a] == sets[b] or 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {d: find(d) for d in ds}


def edited(ws, r, n):
    """``n`` words replaced, each at least five apart: 5 * n shingles change."""
    out = list(ws)
    for at in r.sample(range(5, len(ws) - 5, 6), n):
        out[at] = f"x{r.randrange(10**9)}"
    return out


def near_the_limit():
    """Pairs from 0.57 to 0.96 and just at 0.8, texts with repeats, and two crowds around one text each."""
    r = random.Random(4)
    rows = []
    for i in range(120):
        ws = [f"v{r.randrange(10**6)}" for _ in range(184)]  # 180 shingles; four edits leave 160 of 200
        rows += [ws, edited(ws, r, 1 + i % 10)]
    for i in range(20):
        ws = [f"r{i}"] * 40 + [f"v{r.randrange(10**6)}" for _ in range(64)]
        rows += [ws, ws[20:], ws[:80], edited(ws, r, 3)]
    for n in (1, 3):
        ws = [f"v{r.randrange(10**6)}" for _ in range(184)]
        rows += [edited(ws, r, n) for _ in range(40)]
    r.shuffle(rows)
    return [(i, " ".join(ws)) for i, ws in enumerate(rows)]


def test_groups_are_those_of_brute_force_at_the_limit(spark):
    rows = near_the_limit()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in likeness.near_groups(df).collect()}
    assert got == brute_force(rows)


def test_pipeline_keeps_what_brute_force_keeps(spark):
    import corpus_pipeline as cp

    rows = near_the_limit()
    df = docs(spark, [(d, t, *doc_rows()[0][2:]) for d, t in rows])
    assert {x.doc_id for x in cp.near(spark, df, "").collect()} == set(brute_force(rows).values())


def test_fixture_rows(spark):
    got = likeness.near_groups(docs(spark)).collect()
    assert len(got) == len(doc_rows())
    by_set = {}
    for d, t, *_ in doc_rows():
        by_set.setdefault(shingles(t), []).append(d)
    first = {s: min((d for d in ds if d is not None), default=None) for s, ds in by_set.items()}
    for d, t, *_ in doc_rows():
        near = [f for s, f in first.items() if s == shingles(t) or s | shingles(t) and len(s & shingles(t)) / len(s | shingles(t)) >= 0.8]
        want = min((f for f in near if f is not None), default=None)
        assert any(x.doc_id == d and x.component_id == want for x in got)
    assert likeness.near_groups(docs(spark, [])).count() == 0


def test_a_shared_line_makes_no_candidates(spark):
    """Texts with one line in common and nothing else: no list, so no pair, while two true pairs are listed."""
    r = random.Random(9)
    line = " ".join(f"license{i}" for i in range(30))
    rows = [(i, " ".join(f"v{r.randrange(10**9)}" for _ in range(60)) + " " + line) for i in range(1000)]
    rows += [(2000, rows[0][1] + " more"), (2001, rows[1][1] + " more")]
    found = likeness.Candidates(spark.createDataFrame(rows, "doc_id long, text string"), 5, Fraction(4, 5))
    assert found.lists.groupBy("key").count().agg({"count": "max"}).first()[0] == 2
    assert found.lists.select("node").distinct().count() == 4
    got = {x.doc_id: x.component_id for x in likeness.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: c for d, c in got.items() if d != c} == {2000: 0, 2001: 1}


def test_heavy_buckets(spark, monkeypatch):
    """Nearly every shingle in a heavy bucket: another order, the same groups."""
    monkeypatch.setattr(likeness, "HEAVY", 1 << 40)
    rows = near_the_limit()[:150]
    got = {x.doc_id: x.component_id for x in likeness.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_force(rows)


def test_prefix_length():
    for n in range(1, 400):
        assert likeness.prefix_length(n, Fraction(4, 5)) == n - -(-4 * n // 5) + 1
    assert likeness.prefix_length(0, Fraction(4, 5)) == 0


def test_parities_drop_no_pair_that_reaches_the_likeness(spark):
    """All pairs of sets of one list, held against the exact likeness; of those below 0.7 most are dropped."""
    r = random.Random(11)
    base = [r.getrandbits(63) for _ in range(120)]
    sets = []
    for i in range(60):
        kept = r.sample(base, 120 - i)
        sets.append((i, len(kept) + i % 7 * 2, i % 7 * 2, sorted(kept)))  # ``alone`` shingles beside the members
    df = spark.createDataFrame(sets, "node long, size long, alone long, members array<long>").withColumn("bits", likeness._parities("members"))
    a, b = df.drop("members"), df.drop("members").toDF("node_a", "size_a", "alone_a", "bits_a")
    kept = {(x.node, x.node_a) for x in a.join(b, a.node < b.node_a).filter(likeness._may_reach("", "_a", Fraction(4, 5))).collect()}
    far = dropped = 0
    for i, n, _, x in sets:
        for j, m, _, y in sets[i + 1:]:
            s = len(set(x) & set(y))
            if 5 * s >= 4 * (n + m - s):
                assert (i, j) in kept
            elif 10 * s < 7 * (n + m - s):
                far += 1
                dropped += (i, j) not in kept
    assert kept and far > 100 and dropped > 0.9 * far


def test_parities_are_taken_once_for_each_set(spark):
    rows = near_the_limit()
    sets = likeness.Candidates(spark.createDataFrame(rows, "doc_id long, text string"), 5, Fraction(4, 5)).sets.select("members", "bits").collect()
    assert sets
    for s in sets:
        want = [0] * likeness.WORDS
        for h in s.members:
            want[h >> 6 & likeness.WORDS - 1] ^= 1 << (h & 63)
        assert [b % 2**64 for b in s.bits] == want


def test_components_of_a_long_chain_need_no_round(spark, monkeypatch):
    from barloom.llm import components as cc

    rounds = []
    monkeypatch.setattr(cc, "_star", lambda *a, star=cc._star: rounds.append(1) or star(*a))
    ids = list(range(400))
    random.Random(3).shuffle(ids)
    edges = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)) + [(7, 7), (900, 901)], "a long, b long")
    got = {r.node: r.root for r in cc.components(edges, 401).collect()}
    assert got == dict.fromkeys(range(400), 0) | {900: 900, 901: 900} and not rounds
    got = {r.node: r.root for r in cc.components(edges.repartition(4)).collect()}  # dealt to several tasks
    assert got == dict.fromkeys(range(400), 0) | {900: 900, 901: 900}
