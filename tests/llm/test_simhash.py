import itertools
import random

import numpy as np
import xxhash
from fixtures import doc_rows, docs

from barloom.llm import simhash
from barloom.llm.components import components


def plain_print(text, k=3):
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(ws[i:i + k]), 42) for i in range(max(1, len(ws) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(nodes, linked):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_five_of_eight_positions_hold_an_indexed_set():
    assert len(simhash.FOUR_OF_EIGHT) == 14
    for five in itertools.combinations(range(8), 5):
        assert any(set(four) <= set(five) for four in simhash.FOUR_OF_EIGHT)


def test_prints_and_groups_match_brute_force(spark):
    got = simhash.near_groups(docs(spark)).collect()
    want = {(d, plain_print(t)) for d, t, *_ in doc_rows()}
    assert {(r.doc_id, int.from_bytes(r.fp, "big")) for r in got} == want
    assert len(got) == len(doc_rows())
    root = roots({p for _, p in want}, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for d, p in want:
        r = root[p]
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    assert all(r.component_id == least[root[int.from_bytes(r.fp, "big")]] for r in got)


def test_no_link_is_lost_among_crowded_prints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "WIDE", 50)  # cut lists as very wide ones are
    r = random.Random(5)
    prints = set()
    for _ in range(6):
        c = r.getrandbits(64)
        for _ in range(150):
            x = c
            for _ in range(r.randint(0, 6)):
                x ^= 1 << r.randrange(64)
            prints.add(x)
    prints |= {r.getrandbits(64) for _ in range(200)}
    root = roots(sorted(prints), lambda a, b: (a ^ b).bit_count() <= 3)
    df = spark.createDataFrame([(p.to_bytes(8, "big"),) for p in prints], "fp binary")
    links = simhash.near_links(df)
    found = {int.from_bytes(x.node, "big"): int.from_bytes(x.root, "big") for x in components(links).collect()}
    assert {p: found.get(p, p) for p in prints} == root
    assert all((int.from_bytes(x.a, "big") ^ int.from_bytes(x.b, "big")).bit_count() <= 3 for x in links.collect())
    rows = np.array([list(p.to_bytes(8, "big")) for p in prints if p >> 56 == sorted(prints)[0] >> 56], np.uint8)
    assert all((rows[a] != rows[b]).sum() <= 3 for a, b in simhash._links(rows, simhash.STRICT, tuple(range(1, 8))))


def test_chain_of_components(spark):
    n = 200
    df = spark.createDataFrame([(i, i + 1) for i in range(n) if i != 120] + [(5, 5)], "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {i: (0 if i <= 120 else 121) for i in range(n + 1)}


def test_similar_index_finds_near_copies(spark):
    index = simhash.similar()
    r = random.Random(8)
    rows, pairs = [], []
    for i in range(60):
        ws = [f"v{r.randrange(10**6)}" for _ in range(150)]
        near = list(ws)
        for at in r.sample(range(150), 2):
            near[at] = "changed"
        rows += [(2 * i, " ".join(ws)), (2 * i + 1, " ".join(near))]
        pairs.append((2 * i, 2 * i + 1))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    root = {x.doc_id: x.component_id for x in simhash.near_groups(df, index).collect()}
    assert sum(root[a] == root[b] for a, b in pairs) >= 57
    assert len(set(root.values())) >= 60  # no two different texts meet


def test_empty_table(spark):
    assert simhash.near_groups(docs(spark, [])).count() == 0
