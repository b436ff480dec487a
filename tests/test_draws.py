"""Draws made a batch at a time are numpy's own, and the best of them is found where they are made."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionlake.operators import candidates, draws

PEPTIDES = ["ADEK", "AGLPGEVGAK", "DEFGHIPSTWK", "AKKCDMSK", "AAK", "ACXDEK", "SWQYLNEADTK", "AAAAAAK", "G" * 300 + "K"]


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame([(p,) for p in PEPTIDES], "peptide string")


@pytest.mark.parametrize("variants", [1, 30, 101])
def test_words_of_a_generator_are_read_as_numpy_reads_them(base, variants, monkeypatch):
    drawing = candidates.Seeded(base, 3, variants)
    expected = []
    for n, peptide in enumerate(PEPTIDES):
        places = [i for i in range(1, len(peptide) - 1) if peptide[i] not in "KRCM"]
        if len(places) < 2 or "X" in peptide:
            continue
        rng = np.random.default_rng([3, int.from_bytes(hashlib.md5(peptide.encode()).digest()[:8], "little")])
        for k in range(variants):
            row = [n, k]
            for i in rng.choice(places, 2, replace=False).tolist():
                at = draws.ALPHABET.index(peptide[i])
                row += [i + 1, int(drawing.others[at][np.searchsorted(drawing.edges[at], rng.random(), "right")])]
            expected.append(tuple(row))
    monkeypatch.setattr(np.random, "default_rng", None)  # not asked draw by draw
    got = drawing.drawer()(PEPTIDES)
    assert list(zip(*(x.tolist() for x in (got.peptide, got.draw, got.i, got.a, got.j, got.b)), strict=True)) == expected
    assert {0, 1} <= set(got.peptide.tolist())  # one of two places is among them


@pytest.mark.parametrize("kind", [candidates.Seeded, candidates.Hashed])
def test_a_best_draw_is_that_of_all_rows(base, kind):
    keys = candidates.METHODS["d1c_raw"][0]
    drawing = kind(base.union(base), 7, 100)
    best = drawing.best(base.union(base), keys, None)
    assert best.count() == best.select("src").distinct().count() >= 5  # a row for each peptide, not for each draw
    rows = draws.best_of_rows(drawing(base), keys, None)
    order = ["src", "i", "a", "j", "b", "units"]
    assert sorted(best.select(order).collect()) == sorted(rows.select(order).collect())


def test_no_draw_leaves_the_task_that_makes_it(base):
    plan = candidates.Hashed(base, 7, 100).best(base, ("arom",), None)._jdf.queryExecution().executedPlan().toString()
    after = plan[: plan.index("MapInArrow")]
    assert "Exchange" not in after and "Aggregate" not in after


def test_odd_sequences(spark):
    odd = spark.createDataFrame([(p,) for p in (None, "", "A", "ÄÖÜß🙂K", "adefgk", "A" * 100 + "K")], "peptide string")
    for kind in (candidates.Seeded, candidates.Hashed):
        drawing = kind(odd, 1, 5)
        assert {len(r.src) for r in drawing(odd).select("src").distinct().collect()} <= {6, 101}
        assert drawing.best(odd, ("arom", "basic"), None).where(F.col("src") == "A" * 100 + "K").count() == 1
        assert drawing(odd.where("peptide is null")).count() == 0


@pytest.mark.parametrize("name", ["best_variant", "unique_decoy", "decoys_seeded"])
def test_sequences_are_made_once(spark, monkeypatch, name):
    from ionlake.plans import queries

    read, some = spark.sparkContext.accumulator(0), ["AGLPGEVGAK", "DEFGHIPSTWK", "SWQYLNEADTK"]

    def counted(peptide):
        read.add(1)
        return (peptide,)

    monkeypatch.setattr(queries, "sequences", lambda spark, sf_dir: spark.createDataFrame(spark.sparkContext.parallelize(some, 1).map(counted), "peptide string"))
    assert len(queries.QUERIES[name](spark, "").collect()) == len(some)
    assert read.value == len(some)
