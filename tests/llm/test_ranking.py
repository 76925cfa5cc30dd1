import zlib

import numpy as np
from fixtures import doc_rows, docs, prose

from barloom.llm import ranking


def labelled(spark, n=120):
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        text = prose(i, 80) if good else " ".join(w.upper() + "!!" for w in prose(i, 80).split())
        rows.append((i, text, "en", "s", len(text), *doc_rows()[0][5:]))
        labels.append((i, int(good), 0))
    return docs(spark, rows + doc_rows()), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    df, labels = labelled(spark)
    model = ranking.learn(df, labels)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = ranking.scored(df, model, "_s").select("doc_id", "_s", "text", "score").collect()
    assert len(got) == df.count() and all(0 <= r._s <= 1 and r.score == 0.5 for r in got)
    held = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.text == r.text and r.doc_id < 100]
    own = [r for r in held if len((r.text or "").split()) == 80]
    assert own and all((r._s >= ranking.CUT) == bool(truth[r.doc_id]) for r in own)


def test_held_out_labels_are_never_read(spark):
    df, labels = labelled(spark)
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    assert ranking.learn(df, labels) == ranking.learn(df, flipped)


def test_threshold_is_a_quantile():
    rng = np.random.default_rng(0)
    y = (rng.random(2000) < 0.8).astype(int)
    x = rng.normal(size=(2000, 3)) + y[:, None] * [2.0, 0, 0]
    m = ranking.fit_pairs(x, y)
    assert m.weights[0] > 5 * abs(m.weights[1])
    assert abs((m.score(x) < ranking.CUT).mean() - (y == 0).mean()) < 0.01


def test_features_of_any_text():
    for t in (b"", b" ", b"\n\n", "É日".encode(), b"a" * 10**6, b"x\ny\nx\n"):
        assert np.isfinite(ranking.features(t)).all()


def test_without_labels(spark):
    df, labels = labelled(spark, 4)
    none = ranking.learn(df, labels.filter("quality = 1"))
    assert {r.s for r in ranking.scored(df, none, "s").select("s").collect()} == {0.5}
    assert ranking.scored(docs(spark, []), none, "s").count() == 0
