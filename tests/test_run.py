"""A whole run over a small made acquisition, and its streaming sums."""

import json

import numpy as np
from pyspark.sql import functions as F

from ionlake.functions import chem
from ionlake.operators import evidence
from ionlake.plans import config, pipeline
from ionlake.sources import readers
from ionlake.streaming import frames as streaming

PEPTIDES = ["AGLPGEVGAK", "DEFGHIPSTWK", "GVVGLPGQR", "LLEAAHSTPDK", "TTPDVEQSLAR", "SAVEDGNWLLK"]


def _acquisition(spark, folder):
    rng = np.random.default_rng(5)
    mz = [r[0] for r in spark.createDataFrame([(p,) for p in PEPTIDES], "p string").select(chem.protonated(chem.peptide_mass(F.col("p")))).collect()]
    events, frames = [], []
    for frame in range(36):
        frames.append((frame, frame % 6 + 2, frame // 6 + 3, float(rng.integers(1, 100))))
        for k, m in enumerate(mz):
            level = 50 + 30 * ((frame + k) % 3)
            for channel, share in enumerate((1.0, 0.5, 0.2)):
                events.append((frame, m + channel * chem.NEUTRON + float(rng.normal(0, 1e-4)), int(level * share) + int(rng.integers(0, 5))))
    spark.createDataFrame(events, "frame int, mz double, inten long").write.parquet(f"{folder}/events.parquet")
    spark.createDataFrame(frames, "frame int, x int, y int, tic double").write.parquet(f"{folder}/frames.parquet")
    lines = [f"{p}\t{'AB'[i % 2]}\t0.001\tFalse" for i, p in enumerate(PEPTIDES)]
    (folder / "psms.tsv").write_text("\n".join(["peptidoform\tprotein_list\tqvalue\tis_decoy", *lines]) + "\n")


def test_run(spark, tmp_path):
    _acquisition(spark, tmp_path)
    out = tmp_path / "out"
    c = config.load(None, events=f"{tmp_path}/events.parquet", psms=f"{tmp_path}/psms.tsv", output_dir=str(out), decoy_seeds=[0], tic_quantile=0.0)
    info = pipeline.run(spark, c)
    assert info["n_targets"] == len(PEPTIDES) and info["n_decoys"] >= 4
    got = readers.read_results(spark, str(out))
    rows = got["rows"].toPandas()
    assert {"coloc", "iso", "kl", "mm1", "flank", "n_partners", "s0", "s", "removed"} <= set(rows.columns)
    assert rows[~rows.is_decoy].s0.mean() > rows[rows.is_decoy].s0.mean()
    assert set(got["peptides"].columns) >= {"peptide", "s", "is_decoy", "protein", "seed", "q", "is_gt"}
    assert got["proteins"].where("not is_decoy").count() == 2
    assert got["evidence"].where("isum > 0").count() >= len(PEPTIDES)
    assert json.loads(got["run"].toJSON().first())["n_targets"] == len(PEPTIDES)


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 7).cast("int").alias("pix"), (F.lit(500.0) + F.col("id") % 3 * 1e-3).alias("mz"), F.col("id").alias("inten"))
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    windows = evidence.windows(spark.createDataFrame([(0, 500.0), (1, 500.002)], "qi int, mz double"), 1.0)
    stream = streaming.window_sums(streaming.read_stream(spark, f"{tmp_path}/in", rows.schema), windows, 1.0)
    query = stream.writeStream.outputMode("complete").format("memory").queryName("sums").trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda df: sorted(map(tuple, df.select("qi", "channel", "pix", "inten").collect()))
    assert key(spark.table("sums")) == key(evidence.window_sums(rows, windows, 1.0))
