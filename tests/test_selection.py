"""Exact quantiles against numpy: ties, outliers, nulls, several columns at once, and how little is gathered."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionlake.operators import selection


@pytest.mark.parametrize("limit, accuracy", [(20_000, 2_000), (50, 20), (3, 100)])
def test_quantiles_are_numpys(spark, monkeypatch, limit, accuracy):
    monkeypatch.setattr(selection, "LIMIT", limit)
    monkeypatch.setattr(selection, "ACCURACY", accuracy)
    rng = np.random.default_rng(limit)
    n = 3000
    data = {
        "even": rng.normal(size=n),
        "tied": rng.integers(0, 4, n).astype(float),
        "far": np.concatenate([rng.random(n - 3), [1e300, -1e300, 5e-324]]),
        "one": np.full(n, 2.5),
        "holes": np.where(rng.random(n) < 0.4, np.nan, rng.random(n)),
        "half": np.where(np.arange(n) < n // 2, 0.0, rng.random(n)),
    }
    rows = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in zip(*data.values(), strict=True)], ", ".join(f"`{c}` double" for c in data)).repartition(5)
    asked = {f"{c}{q}": (c, q) for c in data for q in (0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0)}
    got = selection.quantiles(rows, asked)
    for name, (c, q) in asked.items():
        assert got[name] == pytest.approx(float(np.nanquantile(data[c], q)), rel=1e-12), name


def test_few_numbers(spark):
    df = spark.createDataFrame([(1.0, None, float("nan")), (4.0, None, None)], "a double, b double, c double")
    assert selection.quantiles(df, {"a": ("a", 0.5), "b": ("b", 0.5), "c": ("c", 0.5)}) == {"a": 2.5, "b": None, "c": None}
    assert selection.quantiles(df.limit(0), {"a": ("a", 0.1)}) == {"a": None}
    assert selection.quantiles(spark.range(7), {"id": ("id", 0.5)}) == {"id": 3.0}


def test_no_more_than_a_limit_is_gathered(spark, monkeypatch):
    monkeypatch.setattr(selection, "LIMIT", 100)
    monkeypatch.setattr(selection, "ACCURACY", 200)
    seen, own = [], F.collect_list
    monkeypatch.setattr(selection.F, "collect_list", lambda c: seen.append(c) or own(c))
    rows = spark.range(20_000).select((F.col("id") * 7919 % 20_011).cast("double").alias("x"))
    assert selection.quantiles(rows, {"m": ("x", 0.5)})["m"] == pytest.approx(float(np.quantile([i * 7919 % 20_011 for i in range(20_000)], 0.5)))
    sizes = [rows.select(F.col("x").alias("c0")).agg(F.size(own(c))).first()[0] for c in seen]
    assert sizes and max(sizes) <= 100
