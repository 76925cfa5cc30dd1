from collections import Counter
from math import log

import numpy as np
from fixtures import doc_rows, docs

from barloom.llm import lm
from barloom.llm.packing import default_vocabulary


def plain(rows, good):
    v = default_vocabulary()
    grams = [(d, lm.bigrams(t or "", v).tolist()) for d, t, *_ in rows]
    models = []
    for chosen in (grams, [x for x in grams if x[0] in good]):
        pair = Counter(g for _, gs in chosen for g in gs)
        models.append((pair, Counter(g & 65535 for g in pair.elements()), Counter(g >> 16 for g in pair.elements()), Counter(g >> 16 for g in pair)))

    def loss(g, m):
        pair, single, context, kinds = m
        p = (single[g & 65535] + 1) / (single.total() + lm.VOCABULARY)
        c = context[g >> 16]
        return -log((max(pair[g] - lm.DISCOUNT, 0) + lm.DISCOUNT * kinds[g >> 16] * p) / c if c else p)

    out = []
    for d, gs in grams:
        back, goal = (np.mean([loss(g, m) for g in gs]) if gs else 0.0 for m in models)
        out.append((d, len(gs), goal, back, back - goal))
    return out


def test_scores_match_a_plain_model(spark):
    rows = [r for r in doc_rows() if len(r[1] or "") < 5000]
    good = {1, 3, 9, 12, 101, 102, 230}
    targets = spark.createDataFrame([(g,) for g in good] + [(None,), (1,)], "doc_id long")
    got = [tuple(r) for r in lm.cross_entropy_difference(docs(spark, rows), targets, block_chars=4000).collect()]
    want = plain(rows, good)
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose(np.array([x[2:] for x in got]), np.array([x[2:] for x in want]))


def test_no_target_and_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long")
    got = lm.cross_entropy_difference(docs(spark, doc_rows()[:4]), none).collect()
    assert len(got) == 4 and all(abs(r.target_loss - log(lm.VOCABULARY)) < 1e-9 for r in got if r.n_tokens)
    assert lm.cross_entropy_difference(docs(spark, []), none).count() == 0
