from fixtures import pages
from pyspark.sql import functions as F

from barloom.llm import cascade


def test_exact_over_the_universe(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    found = cascade.build(universe)
    assert len(found.filters) >= 2
    assert universe.filter(found.contains(F.col("key")) != F.col("listed")).count() == 0


def test_empty_and_full_lists(spark):
    for listed in (True, False):
        universe = spark.range(50).select(F.col("id").cast("string").alias("key"), F.lit(listed).alias("listed"))
        found = cascade.build(universe)
        assert universe.filter(found.contains(F.col("key")) != listed).count() == 0


def test_judge(spark):
    cases = [
        ("http://a.example.net/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"), ("http://example.net/fr", "example.net", "/fr", "net/", "block"),
        ("https://X.Example.COM/de/", "x.example.com", "/de/", "example.com/de/", "block"), ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        ("ftp://org/fr/", "org", "/fr/", "org/fr/", "allow"), ("http://b.org/frx", "b.org", "/frx", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
        ("no scheme", "", "", None, "allow"), ("http://net", "net", "", None, "allow"), ("http://spam.io?q=/a", "spam.io", "", None, "block"),
        ("http://a://b/c", "a:", "//b/c", None, "allow"), ("http://cheap-pills.org/fr/1", "cheap-pills.org", "/fr/1", "org/fr/", "allow"), ("x://ÉA/p\nq", "Éa", "/p\nq", None, "allow"),
    ]
    rows = [(i, u, "h") for i, (u, *_) in enumerate(cases)] + [(3, cases[3][0], "h"), (None, cases[0][0], None)]
    got = cascade.judge(pages(spark, rows)).drop("listed").collect()
    want = [(i, *c[1:]) for i, c in enumerate(cases)] + [(3, *cases[3][1:]), (None, *cases[0][1:])]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert cascade.judge(pages(spark, [])).count() == 0


def test_plan_has_no_python_and_no_join(spark):
    plan = cascade.judge(pages(spark, [(1, "http://spam.io/", "h"), (2, "http://ok.io/", "h")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Join" not in plan
