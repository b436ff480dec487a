"""Keys of one of two tables alone: brute force with nulls and repeats, and no join."""

from ionlake.plans import views


def test_only_in_one_is_one_pass(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (None, "z"), (5, "w")], "k int, n string")
    b = spark.createDataFrame([(2, "y"), (3, "q"), (3, "q"), (None, "z"), (5, "v")], "k int, n string")
    got = views.only_in_one(a, b, "k", "n")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "x", "left"), (None, "z", "left"), (5, "w", "left"), (3, "q", "right"), (None, "z", "right"), (5, "v", "right")], key=str)
    assert sorted(r.k for r in views.only_in_one(a.where("k > 0"), b.where("k > 0"), "k").collect()) == [1, 3]
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
