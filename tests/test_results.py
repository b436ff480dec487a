"""Comparison of runs, and what a viewer sees of a run that is written again."""

import pytest
from pyspark.sql import functions as F

from ionlake.operators import compare, ordered
from ionlake.plans import views
from ionlake.sources import results, writers


def test_digest_tells_order_and_values(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS", 100)
    rows = spark.range(1500).select("id", (F.col("id") * 31 % 17).alias("v"))
    digest = lambda df, order="id", columns=("v",), size=200: tuple(compare.chained_digest(df, order, list(columns), size).first())
    first = digest(rows)
    assert first == digest(rows.repartition(7, "v").orderBy(F.desc("v"))) and first[0] == 1500
    assert digest(rows.withColumn("v", F.when(F.col("id") == 777, 16).otherwise(F.col("v")))) != first
    assert digest(rows.withColumn("id", F.when(F.col("id") == 3, 4).when(F.col("id") == 4, 3).otherwise(F.col("id")))) != first
    assert digest(rows.limit(0)) == (0, "") and digest(rows.withColumn("v", F.when(F.col("v") > 2, F.col("v")))) != first


def test_differences_count_nulls_and_sides(spark):
    a = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 5.0), (3, 3.0, 6.0), (9, 9.0, 9.0)], "k int, x double, y double")
    b = spark.createDataFrame([(1, 1.0, None), (2, 2.5, None), (3, 2.5, 6.0), (7, 7.0, 7.0)], "k int, x double, y double")
    got = {r.term: tuple(r)[1:] for r in compare.differences(a, b, ["k"], ["x", "y"]).collect()}
    assert got == {"x": (3, 1, 1, 2, 0.5, "2"), "y": (3, 1, 1, 1, 0.0, None)}


def _run(spark, folder, s):
    rows = spark.createDataFrame([("A", s, False), ("B", 1.0, True)], "peptide string, s double, is_decoy boolean")
    terms = rows.withColumns({c: F.col("s") for c in ("coloc", "iso", "kl", "mm1", "flank", "s0")}).withColumn("n_partners", F.lit(2))
    results.retract(spark, folder)
    for name, df in (("rows", terms), ("evidence", rows)):
        writers.write_table(df, folder, name)
    for name in ("peptides", "proteins"):
        writers.write_tsv(rows.withColumn("q", F.when(F.col("s") > 2, 0.001).otherwise(0.5)), folder, name)
    writers.write_run(spark, {"s": s}, folder)


def test_a_viewer_sees_whole_runs_only(spark, tmp_path):
    folder, other = f"{tmp_path}/a", f"{tmp_path}/b"
    viewer = results.Results(spark, 1)
    with pytest.raises(results.NotPublishedError, match="no run"):
        viewer.open(folder)
    _run(spark, folder, 3.0)
    with pytest.raises(results.NotPublishedError, match="being written"):
        viewer.open(folder)
    results.publish(spark, folder)
    first = viewer.open(folder)
    assert first["rows"].where("not is_decoy").first().s == 3.0 and viewer.open(folder) is first and first["rows"].is_cached
    _run(spark, folder, 1.5)
    with pytest.raises(results.NotPublishedError, match="being written"):
        viewer.open(folder)
    results.publish(spark, folder)
    again = viewer.open(folder)
    assert again is not first and again["rows"].where("not is_decoy").first().s == 1.5 and not first["rows"].is_cached and len(viewer.held) == 1
    writers.write_table(spark.range(2), folder, "evidence")  # behind the list's back
    with pytest.raises(results.NotPublishedError, match="have changed"):
        viewer.open(folder)
    _run(spark, folder, 1.5)
    results.publish(spark, folder)
    _run(spark, other, 4.0)
    results.publish(spark, other)
    more = results.Results(spark, 2)
    a, b = dict(more.open(folder)), dict(more.open(other))
    assert len(more.held) == 2
    found = views.compared_runs(a, b)
    terms = {r.term: (r.n_both, r.n_differ, r.greatest, r.at) for r in found["terms"].collect()}
    assert terms["iso"] == (2, 1, 2.5, "A") and terms["n_partners"] == (2, 0, 0.0, None)
    assert sorted((r.peptide, r.side, r.level) for r in found["ids"].collect()) == [("A", "right", 0.01), ("A", "right", 0.05), ("A", "right", 0.1)]
    viewer.open(other)
    assert [k[0] for k in viewer.held] == [other]
