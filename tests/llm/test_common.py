from collections import Counter

from pyspark.sql import functions as F

from barloom.llm import common


def test_hot_join_equals_a_plain_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 4)
    rows = [(7, i) for i in range(300)] + [(k, k) for k in range(20, 320)] + [(None, 1)]
    big = spark.createDataFrame(rows, "k long, v long")
    small = big.filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))
    got = common.hot_join(big, small, ["k"], F.col("v"), len(rows))
    assert got.columns == ["k", "v", "n", "top"]
    want = Counter((k, v, 300 if k == 7 else 1, 299 if k == 7 else v) for k, v in rows if k is not None)
    assert Counter(map(tuple, got.collect())) == want
    assert common.hot_join(big.limit(0), small.limit(0), ["k"], F.col("v"), 0).count() == 0
