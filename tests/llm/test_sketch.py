import hashlib

import numpy as np
from fixtures import doc_rows, docs, prose

from barloom.llm import sketch


def shingles(text):
    ws = (text or "").encode().lower().split()
    return {tuple(ws[i:i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def test_likeness_estimates_jaccard():
    errors = []
    for seed in range(40):
        a = prose(seed, 400).split()
        b = a[: 10 * seed] + prose(1000 + seed, 400).split()[10 * seed:]
        a, b = " ".join(a), " ".join(b)
        s, t = shingles(a), shingles(b)
        errors.append(sketch.likeness(sketch.low_bits(a.encode()), sketch.low_bits(b.encode())) - len(s & t) / len(s | t))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04


def test_short_texts():
    one, other = sketch.low_bits(b"a few words"), sketch.low_bits(b"other few words")
    assert sketch.likeness(one, other) < 0.1 and sketch.likeness(one, sketch.low_bits(b"A  few words")) == 1
    assert sketch.low_bits(b" \n") is None and sketch.likeness(None, None) == 1 and sketch.likeness(None, one) == 0


def test_densified_bins_agree_when_full_bins_do():
    least = np.full(sketch.BINS, sketch.EMPTY)
    least[[3, 77, 400]] = [5, 6, 7]
    full = sketch.densify(least)
    assert set(full.tolist()) == {5, 6, 7} and (full == sketch.densify(least.copy())).all()


def test_next_document_and_edit(spark):
    got = sketch.fingerprints(docs(spark)).collect()
    rows = sorted([(d, t or "") for d, t, *_ in doc_rows()], key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = []
    for i, (d, t) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        n = len(t) // 3
        edited = (t[:len(t) - n] + following[:n]).encode()
        bits, changed, after = sketch.low_bits(t.encode()), sketch.low_bits(edited), sketch.low_bits(following.encode())
        want.append((d, len(t), hashlib.sha256(edited).hexdigest(), sketch.packed(bits), sketch.packed(changed), sketch.likeness(bits, changed), sketch.likeness(bits, after)))
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_single_row_and_empty_table(spark):
    row = doc_rows()[0]
    got = sketch.fingerprints(docs(spark, [row])).collect()
    assert len(got) == 1 and got[0].near_next == 1
    nulls = [(None, *row[1:]), (None, *row[1:])]
    assert [r.near_next for r in sketch.fingerprints(docs(spark, nulls)).collect()] == [1, 1]
    assert sketch.fingerprints(docs(spark, [])).count() == 0
