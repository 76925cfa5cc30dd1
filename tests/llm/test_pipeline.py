from collections import Counter

from fixtures import ascii_lower, doc_rows, docs, prose

import corpus_pipeline as cp


def shingles(t):
    ws = (t or "").encode().lower().split()
    return {tuple(ws[i:i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def test_exact_stage_keeps_one_row_of_each_text(spark):
    got = cp.exact(spark, docs(spark), "").collect()
    assert Counter(ascii_lower(r.text) for r in got) == Counter(set(ascii_lower(t) for _, t, *_ in doc_rows()))
    best = {}
    for d, t, *_ in doc_rows():
        k = ascii_lower(t)
        best[k] = max((x for x in (best.get(k), d) if x is not None), default=None)
    assert all(r.doc_id == best[ascii_lower(r.text)] for r in got)
    assert cp.exact(spark, docs(spark), "").columns == docs(spark).columns


def test_near_stage_keeps_one_of_each_group(spark):
    rows = cp.exact(spark, docs(spark), "")
    got = cp.near(spark, rows, "").collect()
    texts = [r.text for r in got]
    sets = [shingles(t) for t in texts]
    alike = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] | sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.85]
    assert not alike
    clean = {100 + i for i in range(40)}
    assert clean <= {r.doc_id for r in got}  # unlike all others


def test_whole_run(spark, tmp_path):
    rows = [(i, prose(i, 60 + i), "en", f"s{i % 4}", 0, *doc_rows()[0][5:]) for i in range(60)]
    rows += [(100 + i, " ".join(w.upper() + "##" for w in prose(500 + i, 60).split()), "en", "s1", 0, *doc_rows()[0][5:]) for i in range(30)]
    docs(spark, rows + doc_rows()).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(r[0], int(r[0] < 100), 0) for r in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = cp.quality(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert {r.doc_id for r in kept.select("doc_id").collect()} >= set(range(20, 60))
    assert not [r for r in kept.collect() if r.text and "##" in r.text]
    got = cp.run(spark, str(tmp_path)).toPandas()
    assert len(got) and (got.groupby("sequence_id").length.sum() <= 1024).all()


def test_empty_documents(spark, tmp_path):
    docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
