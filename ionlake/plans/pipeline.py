"""The whole run: identifications and an acquisition to scored, q-valued tables."""

from __future__ import annotations

import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chem
from ..operators import candidates, evidence, fdr, ordered, score
from ..operators.lineage import cut
from ..sources import imaging, readers, results, writers
from ..sources.eventstore import EventStore
from . import views


#: The terms that find the m/z offset: all but the one that needs it.
FOUR = list(score.SIGNS)[:4]


def queries_of(found: DataFrame) -> DataFrame:
    """qi and mz: the distinct query m/z in order. Numbers come from a bucketed count, not a global sort."""
    distinct = found.select(F.col("feature_mz").alias("mz")).distinct()
    rows = ordered.running_sums(ordered.bucketed(distinct, "mz"), "mz", {"__n": F.lit(1)}, descending=False)
    return rows.select((F.col("__n") - 1).cast("int").alias("qi"), "mz")


def extract(events, frames: DataFrame, queries: DataFrame, ppm: float, tic_normalize: bool = False) -> dict[str, DataFrame]:
    """evidence, sums, profile and images (M on tissue) of the queries. ``frames`` has pix and is_on.
    ``events`` (a DataFrame, or a store whose events stay where they are) are summed by frame first;
    the sums, not the events, get their pixels."""
    place = frames.select("frame", "pix", "is_on")
    by_frame = evidence.window_sums(events, evidence.windows(queries, ppm), ppm, "frame")
    sums = cut(by_frame.join(place, "frame").groupBy("qi", "channel", "pix").agg(F.sum("inten").alias("inten")))
    counts = frames.agg(F.count_distinct("pix"), F.count_distinct(F.when(F.col("is_on"), F.col("pix")))).first()
    n_pixels, n_on = int(counts[0]), int(counts[1])
    by_channel = evidence.by_channel(sums).join(frames.select("pix", "is_on").distinct(), "pix")
    by_channel = cut(by_channel)
    images = by_channel.where("is_on").select("qi", "pix", "m")
    bright = evidence.top_decile(images, n_on)
    hits = evidence.profile_hits(events, queries, "frame").join(place.where("is_on"), "frame")
    profile = cut(evidence.profile_of(hits, bright))
    statistics = evidence.image_statistics(by_channel, n_pixels, n_on)
    coloc = evidence.tic_normalised(images) if tic_normalize else images
    n_queries = queries.count()
    valid = evidence.valid_images(coloc, queries, n_queries, n_on)
    table = queries.join(statistics, "qi", "left").join(evidence.centroids(profile), "qi", "left").join(valid, "qi", "left")
    table = table.withColumns({"isum": F.coalesce("isum", F.lit(0.0)), "p90": F.coalesce("p90", F.lit(0.0)), "valid": F.coalesce("valid", F.lit(False))})
    return {"evidence": table, "sums": sums, "profile": profile, "images": coloc, "n_queries": n_queries, "n_on": n_on}


def score_run(found: DataFrame, table: DataFrame, correlate, offset: float = 0.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scored rows, peptides and proteins. k is that of the peptides before the competition."""
    rows = score.z_sum(score.terms(found, table, correlate, offset), list(score.SIGNS), "s0")
    rows = cut(score.ion_competition(cut(rows)))
    ratio = fdr.decoy_ratio(found.groupBy("peptide").agg(F.min_by("is_decoy", "row_id").alias("is_decoy")))
    peptides = cut(fdr.q_values(cut(fdr.peptide_table(rows.where("not removed"))), ratio))
    return rows, peptides, cut(fdr.protein_table(peptides))


def _beside(events: str) -> str:
    """Where the frames of a file of events are by default: an imaging file has its own, others have them
    beside them, under the name of frames."""
    if imaging.is_imaging(events):
        return events
    folder, slash, name = events.rstrip("/").rpartition("/")
    return folder + slash + name.replace("events", "frames")


def run(spark: SparkSession, config: dict[str, Any]) -> dict[str, Any]:
    """Reads, scores and writes a run as ``config`` asks; returns what run.json holds."""
    steps: list[dict[str, Any]] = []

    def step(name: str, since: list[float] = [time.time()]) -> None:  # noqa: B006
        steps.append({"step": name, "seconds": round(time.time() - since[0], 3)})
        since[0] = time.time()

    found = candidates.targets(readers.read_psms(spark, config["psms"], config["psm_reader"]))
    if config["event_store"]:
        events = EventStore.kept(spark, config["event_store"], config["events"], readers.read_events)
    else:
        events = readers.read_events(spark, config["events"], tuple(config["mz_range"]) if config["mz_range"] else None)
    frames = evidence.pixels(readers.read_frames(spark, config["frames"] or _beside(config["events"])))
    if config["tissue_mask"]:
        frames = frames.join(readers.read_mask(spark, config["tissue_mask"]), "pix", "left").withColumn("is_on", F.coalesce("is_on", F.lit(False)))
    else:
        frames = evidence.tissue_mask(frames, config["tic_quantile"])
    step("targets")
    found = cut(found)
    world = cut(candidates.candidate_set(found, config["decoy_seeds"], config["decoy_method"], config["decoy_min_shift_da"], tuple(config["mz_range"]) if config["mz_range"] else None))
    asked = cut(queries_of(world))
    keyed = asked.select(chem.mz_key(F.col("mz")).alias("__key"), "qi")
    world = world.withColumn("__key", chem.mz_key(F.col("feature_mz"))).join(keyed, "__key").drop("__key")
    world = cut(world)
    step("decoys")
    got = extract(events, frames, asked, config["extraction_ppm"], config["tic_normalize"])
    table = cut(got["evidence"])
    correlate = lambda pairs: evidence.colocalisation(got["images"], pairs, got["n_queries"], got["n_on"])
    step("evidence")
    offset, estimate, z = (float(config["mz_offset_ppm"]), None, None) if config["mz_offset_ppm"] != "auto" else tuple(score.mz_offset(score.z_sum(score.terms(world, table, correlate), FOUR, "s4")).first())
    step("offset")
    rows, peptides, proteins = score_run(world, table, correlate, offset)
    known = readers.read_known_peptides(spark, config["gt_peptides"]).withColumn("is_gt", F.lit(True)) if config["gt_peptides"] else None
    peptides = (peptides.join(known, "peptide", "left").withColumn("is_gt", F.coalesce("is_gt", F.lit(False))) if known is not None else peptides.withColumn("is_gt", F.lit(False)))
    out = config["output_dir"]
    results.retract(spark, out)
    writers.write_table(rows.withColumn("row_id", F.to_json("row_id")), out, "rows")
    writers.write_table(table, out, "evidence")
    writers.write_tsv(peptides, out, "peptides")
    writers.write_tsv(proteins, out, "proteins")
    selected = views.viewer_selection(rows, peptides, proteins, config["viewer_all_targets"], config["viewer_all_decoys"])
    writers.write_viewer(selected, got["sums"].where("channel < 2"), got["profile"], frames, out)
    step("output")
    info = {
        "config": config,
        "n_targets": world.where("not is_decoy").count(),
        "n_decoys": world.where("is_decoy").select("peptide").distinct().count(),
        "mz_offset": {"used": offset, "estimate": estimate, "z": z, "accepted": offset == estimate},
        "ids": {str(r["level"]): r["n_ids"] for r in fdr.ids_at(peptides).collect()},
        "proteins_picked": {str(r["level"]): r["n_ids"] for r in fdr.ids_at(proteins, "q_picked").collect()},
        "proteins_nc": {str(r["level"]): r["n_ids"] for r in fdr.ids_at(proteins).collect()},
        "gt": peptides.where("is_gt and q <= 0.01").count(),
        "steps": steps,
    }
    writers.write_run(spark, info, out)
    results.publish(spark, out)
    return info


