"""Products of sparse images by tiles against dense numpy, and what the plan moves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionlake.operators import evidence, gram
from ionlake.plans import views


@pytest.mark.parametrize("tile", [64, 3])
def test_products_are_the_dense_ones(spark, monkeypatch, tile):
    monkeypatch.setattr(gram, "TILE", tile)
    rng = np.random.default_rng(tile)
    dense = np.where(rng.random((25, 90)) < 0.2, rng.normal(size=(25, 90)), 0.0)
    dense[4] = 0.0
    images = spark.createDataFrame([(i, p, float(dense[i, p])) for i in range(25) for p in range(90) if dense[i, p] or p < 2], "qi int, pix int, m double")
    asked = [(i, j, f"P{i % 3}") for i in range(25) for j in range(25) if (i * j) % 4 != 1] + [(2, 3, "P9"), (2, 3, None), (4, 99, "P1")]
    pairs = spark.createDataFrame(asked, "i int, j int, group string")
    got = {(r.i, r.j): r.g for r in gram.products(images, pairs).collect()}
    assert set(got) == {(i, j) for i, j, _ in asked}
    assert got.pop((4, 99)) == 0.0
    for (i, j), g in got.items():
        assert g == pytest.approx(float(dense[i] @ dense[j]), abs=1e-12)


def test_wide_images_are_multiplied_in_parts():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    own, gram.PIXELS = gram.PIXELS, 7
    try:
        dense = rng.integers(0, 3, (6, 50)).astype(float)
        nonzero = [np.flatnonzero(r) for r in dense]
        images = pa.table({"qi": [5, 3, 1, 0, 2, 4], "pix": [nonzero[k].tolist() for k in (5, 3, 1, 0, 2, 4)], "m": [dense[k][nonzero[k]].tolist() for k in (5, 3, 1, 0, 2, 4)]})
        got = gram._multiply(pa.table({"i": [0, 5, 2], "j": [5, 5, 1]}), images)
    finally:
        gram.PIXELS = own
    assert got.column("g").to_pylist() == [dense[0] @ dense[5], dense[5] @ dense[5], dense[2] @ dense[1]]


def test_no_rows_of_pairs_and_pixels(spark):
    """One protein of 120 images: 7,140 pairs of 64 pixels, but no operator makes more rows than pairs or points."""
    images = spark.range(120 * 64).select((F.col("id") % 120).cast("int").alias("qi"), (F.col("id") / 120).cast("int").alias("pix"), (F.col("id") * 7919 % 101).cast("double").alias("m"))
    named = images.select("qi", F.when(F.col("qi") >= 0, "P").alias("protein")).distinct()
    pairs = views.image_pairs(named)
    got = views.image_correlations(images, pairs, 64)
    assert got.count() == 7140
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CoGroups" in plan or "Cogroup" in plan, plan[:2000]
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    valid = evidence.valid_images(images, named, 120, 64)
    assert valid.where("valid").count() == 120


@pytest.mark.parametrize("tile", [512, 4])
def test_pairs_within_groups_are_those_of_asked_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(gram, "WITHIN", tile)
    rng = np.random.default_rng(8)
    dense = np.where(rng.random((23, 30)) < 0.4, rng.random((23, 30)), 0.0)
    dense[5] = 0.0
    images = spark.createDataFrame([(i, f"P{i % 3}", p, float(dense[i, p])) for i in range(23) for p in range(30)], "qi int, protein string, pix int, m double")
    members = images.select("qi", F.col("protein").alias("group")).distinct()
    assert gram.apart(members) and not gram.apart(members.union(spark.createDataFrame([(1, "P0")], "qi int, group string")))
    table = lambda df: {tuple(r)[:2]: r.r for r in df.collect()}
    same = lambda a, b: a.keys() == b.keys() and all((a[k] is None) == (b[k] is None) and (a[k] is None or a[k] == pytest.approx(b[k], abs=1e-9)) for k in a)
    assert same(table(views.correlations_within(images, members, 30)), table(views.image_correlations(images, views.image_pairs(images), 30)))
    pairs = members.withColumnRenamed("qi", "x").join(members.withColumnRenamed("qi", "y"), "group").where("x <> y").select(F.col("x").alias("qi"), F.col("y").alias("pqi"))
    found = evidence.colocalisation(images, pairs, 23, 30)
    assert same(table(evidence.colocalisation_within(images, members, 23, 30)), table(found))
    weights = members.select("qi", (F.col("qi") % 4 / 7).alias("p90"), (F.col("qi") / 20).alias("ev"))
    from ionlake.operators import score

    named = pairs.select(F.col("qi").alias("feature_mz"), F.lit("").alias("protein"), "qi", F.col("pqi").alias("partner_mz"), "pqi")
    expected = score.weighted_coloc(named, found.withColumn("r", F.round("r", 6)), weights, weights.select(F.col("qi").alias("partner_mz"), "ev"))
    got = {r.qi: (r.x, r.n_partners) for r in evidence.colocalisation_within(images, members, 23, 30, weights).collect()}
    assert got == {r.feature_mz: (r.x if r.x is None else pytest.approx(r.x, abs=1e-9), r.n_partners) for r in expected.collect()}


def test_pairs_within_groups_arent_shuffled(spark):
    images = spark.range(120 * 8).select((F.col("id") % 120).cast("int").alias("qi"), (F.col("id") / 120).cast("int").alias("pix"), (F.col("id") * 7919 % 101).cast("double").alias("m"))
    got = evidence.colocalisation_within(images, images.select("qi", F.lit("P").alias("group")), 120, 8)
    assert got.count() == 120 * 119
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("FlatMapGroupsInArrow")[0], plan[:2000]


def test_tiles_grow_with_their_groups_and_are_multiplied_in_steps(spark, monkeypatch):
    """How often an image is sent doesn't grow with its group, and no table of all pairs of a block is made."""
    import pyarrow as pa

    monkeypatch.setattr(gram, "WITHIN", 4)
    monkeypatch.setattr(gram, "BLOCKS", 8, raising=False)
    images = spark.range(200 * 5).select((F.col("id") % 200).cast("int").alias("qi"), (F.col("id") / 200).cast("int").alias("pix"), (F.col("id") * 7919 % 11).cast("double").alias("m"))
    members = images.select("qi", F.lit("P").alias("group")).distinct()
    count = lambda qi, i, j, g: pa.table({"images": [len(qi)], "pairs": [len(i)], "ordered": [bool((qi[i] < qi[j]).all())]})
    made = lambda: gram.within(images, members, members.select("qi"), count, "images long, pairs long, ordered boolean").collect()
    rows = made()
    assert sum(r.images for r in rows) <= 200 * 5 and sum(r.pairs for r in rows) == 19900 and all(r.ordered for r in rows)
    monkeypatch.setattr(gram, "STEP", 7, raising=False)
    rows = made()
    assert max(r.pairs for r in rows) <= 49 and sum(r.pairs for r in rows) == 19900 and all(r.ordered for r in rows)
    table = lambda df: {tuple(r)[:2]: round(r.r, 9) for r in df.collect() if r.r is not None}
    assert table(views.correlations_within(images, members, 5)) == table(views.image_correlations(images, views.image_pairs(members.withColumnRenamed("group", "protein")), 5))
