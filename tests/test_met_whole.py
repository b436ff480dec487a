"""Windows that are met whole: brute force, and nothing moved after the join."""

import random

import pytest
from pyspark.sql import functions as F

from ionlake.operators import evidence, rangejoin
from ionlake.sources import eventstore
from ionlake.sources.eventstore import EventStore


def tables(spark):
    rng = random.Random(3)
    mz = [rng.choice([500.0, 500.001, 501.003, 999.99]) * (1 + rng.randrange(-40, 40) * 1e-6) for _ in range(600)]
    events = [(rng.randrange(5), m, float(rng.randrange(1, 9))) for m in mz]
    queries = [(i, rng.choice([500.0, 500.002, 1000.0]) * (1 + rng.randrange(-9, 9) * 1e-6)) for i in range(60)] + [(7, 500.0), (7, 999.99)]
    return events, queries, spark.createDataFrame(events, "pix int, mz double, inten double").repartition(3), spark.createDataFrame(queries, "qi int, mz double")


def brute(events, windows):
    out = {}
    for qi, channel, lo, hi in windows:
        for pix, mz, inten in events:
            if lo <= mz <= hi:
                out[qi, channel, pix] = out.get((qi, channel, pix), 0.0) + inten
    return out


@pytest.mark.parametrize("pairs", [10_000_000, 50])
def test_window_sums_are_those_of_brute_force(spark, monkeypatch, pairs):
    monkeypatch.setattr(rangejoin, "PAIRS", pairs)
    events, _, rows, queries = tables(spark)
    windowed = evidence.windows(queries, 10)
    got = [((r.qi, r.channel, r.pix), r.inten) for r in evidence.window_sums(rows, windowed, 10).collect()]
    assert len(got) == len(dict(got))  # query 7 is there twice
    assert dict(got) == brute(events, [tuple(w) for w in windowed.select("qi", "channel", "lo", "hi").collect()])


def test_wide_intervals(spark):
    points = spark.createDataFrame([(float(i),) for i in range(1, 200)], "mz double")
    wide = spark.createDataFrame([(0, 10.0, 150.0), (1, 5.0, 5.0), (2, 9.0, 8.0)], "qi int, lo double, hi double")
    rows, _ = rangejoin.met_whole(points, wide, "mz", "lo", "hi", 20)
    assert {r.qi: r["count"] for r in rows.groupBy("qi").count().collect()} == {0: 141, 1: 1}


def test_nothing_is_moved_after_the_join(spark):
    """What windows hold is as many rows as queries times events; only these two may be shuffled."""
    _, _, rows, queries = tables(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = evidence.window_sums(rows, evidence.windows(queries.where("qi <> 7"), 10), 10)
        got.collect()
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above = plan.split("Join [__bin")[0]
    assert "HashAggregate" in above and "Exchange" not in above, plan[:3000]


def test_profiles_of_all_pixels(spark):
    _, _, rows, queries = tables(spark)
    every = queries.select("qi").distinct().crossJoin(rows.select("pix").distinct())
    table = lambda df: sorted(map(tuple, df.select("qi", "bin", "inten").collect()))
    assert table(evidence.profiles(rows, queries)) == table(evidence.profiles(rows, queries, every)) != []


def test_many_windows_arent_broadcast_from_a_store(spark, monkeypatch, tmp_path):
    events, _, rows, queries = tables(spark)
    store = EventStore.build(rows, str(tmp_path / "s"))
    store.block_rows = 10
    windowed = evidence.windows(queries, 10)
    monkeypatch.setattr(EventStore, "met", lambda *a: pytest.fail("broadcast"))
    assert windowed.count() > eventstore.BLOCKS * store.block_rows
    got = {(r.qi, r.channel, r.pix): r.inten for r in evidence.window_sums(store, windowed, 10).collect()}
    assert got == brute(events, [tuple(w) for w in windowed.select("qi", "channel", "lo", "hi").collect()])
    assert evidence.met(store, windowed.select("lo", "hi"), 10, "pix").where(F.col("mz") > 0).count() > 0
