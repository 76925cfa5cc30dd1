from collections import Counter, defaultdict

import numpy as np
from fixtures import DOC_KIND, doc_rows, docs
from pyspark.sql import functions as F

from barloom.llm import mixing


def test_targets_share_what_caps_cut_off():
    assert mixing.targets([100, 100, 100], [3, 1, 2], 450) == [200, 250 / 3, 500 / 3]
    assert mixing.targets([10, 1000, 0], [3, 1, 2], 100) == [20, 80, 0]
    assert mixing.targets([0, 0], [3, 1], 0) == [0, 0]
    for sizes in ([5, 900, 40, 40], [1, 1, 1, 1000]):
        got = mixing.targets(sizes, [3, 1, 2, 3], 1.5 * sum(sizes))
        assert abs(sum(got) - 1.5 * sum(sizes)) < 1e-6 and all(g <= 2 * s + 1e-9 for g, s in zip(got, sizes, strict=True))


def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 10, 257, 5000):
        for key in (1, 99):
            assert sorted(mixing.permute(np.arange(n), n, key).tolist()) == list(range(n))


def test_taken_words(spark):
    got = mixing.plan(docs(spark), block=8).taken().collect()
    rows = doc_rows()
    words = lambda t: len((t or "").encode().split())
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, words(t)) for d, t, *_ in rows)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    sizes = defaultdict(int)
    for _, t, _, s, *_ in rows:
        sizes[s] += words(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = mixing.targets([sizes[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5 * sum(sizes.values()))
    by = defaultdict(set)
    taken = Counter()
    for r in got:
        by[r.source_size].add(round(r.target, 6))
        taken[round(r.target, 6)] += r.taken
    for s, g in zip(order, goal, strict=True):
        assert round(g, 6) in by[sizes[s]]
        assert abs(taken[round(g, 6)] - g) <= 2 * 8
    again = mixing.plan(docs(spark).repartition(3), block=8).taken().collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_slots_draw_whole_counts(spark):
    m = mixing.plan(docs(spark), block=8, shards=5)
    slots = m.slots.toPandas()
    want = {r.source_no: r.slots for r in m.sources.collect()}
    assert slots.groupby("source_no").size().to_dict() == {k: v for k, v in want.items() if v}
    for _, x in slots.groupby("source_no"):
        assert sorted(x.slot) == list(range(len(x))) and not x.duplicated(["block", "epoch"]).any()
    per_shard = slots.groupby("shard").size()
    assert per_shard.max() - per_shard.min() <= 1


def test_mixed_rows_are_the_taken_words(spark):
    got = mixing.mixed(docs(spark), block=8)
    assert got.columns == docs(spark).columns and got.dtypes == docs(spark).dtypes
    taken = Counter()
    for r in mixing.plan(docs(spark), block=8).taken().collect():
        taken[r.doc_id] += r.taken
    seen = Counter()
    texts = defaultdict(list)
    for d, t, *_ in doc_rows():
        texts[d].append(t or "")
    for r in got.collect():
        assert any(r.text in t for t in texts[r.doc_id]) and r.n_chars == len(r.text)
        seen[r.doc_id] += len(r.text.encode().split())
    assert {k: v for k, v in taken.items() if v} == dict(seen)


def test_slots_meet_blocks_without_a_broadcast(spark):
    """Slots are made from a few counts, by which Spark judges their size; they grow with the words all the same."""
    for met in (mixing.plan(docs(spark), block=8).spans(), mixing.plan(docs(spark), block=8).spans().filter("epoch is not null")):
        met.collect()
        done = met._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        joins = [x for x in done.splitlines() if "Join [" in x and "block" in x]
        assert len(joins) == 1 and "SortMergeJoin" in joins[0]


def test_the_mix_itself_is_made_without_a_broadcast_of_slots(spark):
    got = mixing.mixed(docs(spark), block=8)
    got.collect()
    done = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    joins = [x for x in done.splitlines() if "Join [" in x and "block" in x]
    assert len(joins) == 1 and "SortMergeJoin" in joins[0]


def test_documents_without_words_are_dealt_to_all_tasks(spark):
    row = doc_rows()[4]
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        met = mixing.plan(docs(spark, [row] * 64 + [doc_rows()[0]])).spans().withColumn("_p", F.spark_partition_id()).filter("size = 0").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
    assert len(met) == 64 and all(r.block is r.epoch is None and r.words == 0 for r in met) and len({r._p for r in met}) > 1


def test_no_words_and_empty_table(spark):
    row = doc_rows()[3]
    assert [r.taken for r in mixing.plan(docs(spark, [row])).taken().collect()] == [0]
    assert mixing.plan(docs(spark, [])).taken().count() == 0
    assert mixing.mixed(docs(spark, [])).count() == 0
    assert "source" in DOC_KIND
