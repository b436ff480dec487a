"""Evidence of a running acquisition against the batch evidence over all its events."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionlake.functions import chem
from ionlake.operators import evidence
from ionlake.streaming import evidence as running
from ionlake.streaming import frames

PIXELS = 12


def _events(spark, folder):
    """Four files; a pixel's events are in two of them."""
    rng = np.random.default_rng(3)
    for part in range(4):
        rows = []
        for pix in range(PIXELS):
            if pix % 4 in (part, (part + 1) % 4):
                for mz in (500.0, 700.0):
                    for channel, share in enumerate((0.1, 1.0, 0.6, 0.2)):
                        rows.append((pix, mz + (channel - 1) * chem.NEUTRON + float(rng.normal(0, 1e-4)), int(share * rng.integers(50, 200)), 1_700_000_000 + 60 * part))
        rows += [(None, 500.0, 5, 1_700_000_000), (1, None, 5, 1_700_000_000), (1, 500.0, None, 1_700_000_000), (1, 600.0, 9, 1_700_000_000)]
        df = spark.createDataFrame(rows, "pix int, mz double, inten long, s long").select("pix", "mz", "inten", F.timestamp_seconds("s").alias("at_time"))
        df.coalesce(1).write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


@pytest.mark.parametrize("time", [None, "at_time"])
def test_running_evidence_equals_batch(spark, tmp_path, time):
    rows = _events(spark, f"{tmp_path}/in")
    queries = spark.createDataFrame([(0, 500.0), (1, 700.0), (2, 900.0)], "qi int, mz double")
    reports, latest = [], {}
    listener = running.Progress(lambda *x: reports.append(x))
    spark.streams.addListener(listener)
    stream = running.running_evidence(frames.read_stream(running.with_state_store(spark), f"{tmp_path}/in", rows.schema, 1), queries, 5.0, PIXELS, time)
    query = stream.writeStream.outputMode("update").foreachBatch(lambda df, i: latest.update({r.qi: r for r in df.collect()})).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert query.awaitTermination(150)
    spark.streams.removeListener(listener)
    clean = rows.where("pix is not null and mz is not null and inten is not null").select("pix", "mz", "inten")
    images = evidence.by_channel(evidence.window_sums(clean, evidence.windows(queries, 5.0), 5.0)).withColumn("is_on", F.lit(True))
    whole = evidence.image_statistics(images, PIXELS, PIXELS)
    centroid = evidence.centroids(evidence.profile_hits(clean, queries).groupBy("qi", "bin").agg(F.sum("inten").alias("inten")))
    expected = {r.qi: r for r in whole.join(centroid, "qi").collect()}
    assert latest.keys() == expected.keys() == {0, 1}
    for qi, e in expected.items():
        for c in ("isum", "env0", "env1", "env2", "iso_r", "mm1_r", "cen"):
            assert math.isclose(latest[qi][c], e[c], rel_tol=1e-9, abs_tol=1e-9), (qi, c)


def test_late_events_of_final_pixels_are_left_out(spark, tmp_path):
    queries = spark.createDataFrame([(0, 500.0)], "qi int, mz double")
    latest = {}

    def put(rows):
        spark.createDataFrame(rows, "pix int, mz double, inten long, s long").select("pix", "mz", "inten", F.timestamp_seconds("s").alias("t")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = running.running_evidence(frames.read_stream(running.with_state_store(spark), f"{tmp_path}/in", "pix int, mz double, inten long, t timestamp", 1), queries, 5.0, 4, "t", "1 minute")
        query = stream.writeStream.outputMode("update").foreachBatch(lambda df, i: latest.update({r.qi: r for r in df.collect()})).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        assert query.awaitTermination(100)

    put([(0, 500.0, 10, 1_700_000_000)])
    put([(1, 500.0, 20, 1_700_009_000)])
    put([(0, 500.0, 1000, 1_700_000_000), (2, 500.0, 30, 1_700_009_001)])
    assert latest[0].isum == 60.0
