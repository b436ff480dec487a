"""Queries on the tables of a finished run: curves, histograms, images and grids as DataFrames."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chem
from ..operators.compare import differences
from ..operators.fdr import LEVELS
from ..operators.gram import products, within
from ..operators.ordered import bucketed, running_sums
from ..operators.rangejoin import ppm_window
from ..operators.score import SIGNS
from ..operators.selection import quantiles
from ..operators.stats import bin_of, histogram, with_scalars

REPORTED_Q, TOP_DECOYS = 0.1, 50


def ids_curve(q_values: DataFrame, q: str = "q") -> DataFrame:
    """q and n: how many targets have at most that q."""
    counts = q_values.where("not is_decoy").groupBy(q).agg(F.count("*").alias("__c"))
    return running_sums(bucketed(counts, q), q, {"n": F.col("__c")}, descending=False).select(F.col(q).alias("q"), "n")


def visible_most(curve: DataFrame, x_high: float) -> DataFrame:
    """n_max: the largest n of a curve within the visible range."""
    return curve.where(F.col("q") <= x_high).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n_max"))


def mirror_histogram(peptides: DataFrame, bins: int, names: int = 6, name: str = "peptide") -> DataFrame:
    """bin, is_decoy, n, n_scaled (decoys over k) and the bin's best peptide and first names."""
    rows = with_scalars(peptides, __lo=F.min("s"), __hi=F.max("s"), __k=F.count_if("is_decoy") / F.greatest(F.count_if(~F.col("is_decoy")), F.lit(1)))
    rows = rows.withColumn("bin", F.coalesce(bin_of(F.col("s"), F.col("__lo"), (F.col("__hi") - F.col("__lo")) / bins, bins), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("bin", "is_decoy").orderBy(F.desc("s"), name))
    grouped = rows.groupBy("bin", "is_decoy").agg(F.count("*").alias("n"), F.first("__k").alias("__k"), F.min_by(name, F.struct(-F.col("s"), F.col(name))).alias("best"))
    listed = rows.select("bin", "is_decoy", name, place.alias("__at")).where(F.col("__at") <= names).groupBy("bin", "is_decoy").agg(F.array_sort(F.collect_list(F.struct("__at", name))).alias("__l"))
    out = grouped.join(listed, ["bin", "is_decoy"])
    return out.select("bin", "is_decoy", "n", F.when(F.col("is_decoy"), F.try_divide(F.col("n").cast("double"), F.col("__k"))).otherwise(F.col("n").cast("double")).alias("n_scaled"), "best", F.array_join(F.transform("__l", lambda x: x[name]), " ").alias("names"))


def score_tail(peptides: DataFrame, points: int = 300) -> DataFrame:
    """i, g, targets and decoys (over k) with a score of at least g, at even points from the targets'
    median to the best score. Each row is counted at its last point and the counts are summed over
    the points, so that nothing is joined by range."""
    target = F.when(~F.col("is_decoy"), F.col("s"))
    median = quantiles(peptides.select(target.alias("s")), {"s": ("s", 0.5)})["s"]
    scalars = peptides.agg(F.lit(median).cast("double").alias("lo"), F.max("s").alias("hi"), (F.count_if("is_decoy") / F.greatest(F.count_if(~F.col("is_decoy")), F.lit(1))).alias("k"))
    rows = peptides.join(F.broadcast(scalars)).where(F.col("s") >= F.col("lo"))  # one row
    step = (F.col("hi") - F.col("lo")) / (points - 1)
    at = F.least(F.floor(F.coalesce(F.try_divide(F.col("s") - F.col("lo"), step), F.lit(points - 1.0)) + 1e-9), F.lit(points - 1)).cast("int")
    counts = rows.groupBy(at.alias("i")).agg(F.count_if(~F.col("is_decoy")).alias("t"), F.count_if("is_decoy").alias("d"))
    grid = scalars.select(F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"), "lo", "hi", "k")
    down = Window.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)  # ``points`` rows
    out = grid.join(counts, "i", "left").na.fill(0, ["t", "d"])
    return out.select("i", (F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / (points - 1)).alias("g"), F.sum("t").over(down).alias("targets"), F.try_divide(F.sum("d").over(down).cast("double"), F.col("k")).alias("decoys"))


def cut_at(peptides: DataFrame, level: float) -> DataFrame:
    """The least score of targets at or below a level, and how many they are."""
    kept = peptides.where((F.col("q") <= level) & ~F.col("is_decoy"))
    return kept.agg(F.min("s").alias("s_cut"), F.count("*").alias("n"))


def pp_curve(peptides: DataFrame) -> DataFrame:
    """s, target_share and decoy_share: of targets and decoys, how many score at most s, at each
    target's score."""
    by = peptides.groupBy("s").agg(F.count_if(~F.col("is_decoy")).alias("__t"), F.count_if("is_decoy").alias("__d"))
    rows = with_scalars(running_sums(bucketed(by, "s"), "s", {"t": F.col("__t"), "d": F.col("__d")}, descending=False), __nt=F.sum("__t"), __nd=F.sum("__d"))
    return rows.where("__t > 0").select("s", F.try_divide("t", "__nt").alias("target_share"), F.try_divide("d", "__nd").alias("decoy_share"))


def term_histograms(rows: DataFrame, terms: list[str], bins: int) -> DataFrame:
    """term, is_decoy, bin and n: each term over its own range."""
    long = rows.select("is_decoy", F.explode(F.array(*(F.struct(F.lit(t).alias("term"), F.col(t).cast("double").alias("x")) for t in terms))).alias("v")).select("is_decoy", "v.*").where("x is not null")
    ranges = long.groupBy("term").agg(F.min("x").alias("__lo"), F.max("x").alias("__hi"))
    binned = long.join(F.broadcast(ranges), "term").withColumn("bin", F.coalesce(bin_of(F.col("x"), F.col("__lo"), (F.col("__hi") - F.col("__lo")) / bins, bins), F.lit(0)))  # a row for each term
    return binned.groupBy("term", "is_decoy", "bin").agg(F.count("*").alias("n"))


def mirror_heights(bars: DataFrame) -> DataFrame:
    """A mirror histogram with height: log10(1 + n) of targets upwards, of scaled decoys downwards."""
    height = lambda n: F.log10(1 + F.col(n))
    return bars.withColumn("height", F.when(F.col("is_decoy"), -height("n_scaled")).otherwise(height("n")))


def shortened(text: Column, longest: int, kept: int | None = None) -> Column:
    """A label: a text of more than ``longest`` characters as its first ``kept`` and an ellipsis."""
    return F.when(F.char_length(text) > longest, F.concat(F.substring(text, 1, longest if kept is None else kept), F.lit("…"))).otherwise(text)


def number_text(x: Column, digits: int = 3) -> Column:
    """A number with at most so many decimals, no zeros at the end, and none for what isn't there."""
    shown = F.call_function("format_number", x, F.lit("0." + "#" * digits))
    return F.when(x.isNull() | F.isnan(x), "").when(shown == "-0", "0").otherwise(shown)


def score_class(level: float) -> Column:
    return F.when(F.col("is_decoy"), "decoy").when(F.col("q") <= level, "reported").otherwise("target")


def score_against_mz(peptides: DataFrame, evidence: DataFrame, level: float) -> DataFrame:
    return peptides.join(evidence.select("qi", "mz"), "qi").select("peptide", "mz", "s", score_class(level).alias("class"))


def tissue_images(frames: DataFrame) -> DataFrame:
    """pix, is_on and log10 of the intensity (null where there is none)."""
    return frames.select("pix", "is_on", F.when(F.col("tic") > 0, F.log10("tic")).alias("log_tic"))


def mz_density(evidence: DataFrame, low: float, high: float, bins: int, *by: str, mz: str = "mz") -> DataFrame:
    """A histogram of m/z as a density for each value of ``by``."""
    counts = histogram(evidence, mz, low, high, bins, *by)
    total = F.sum("n").over(Window.partitionBy(*by)) if by else None
    rows = counts.withColumn("__all", total) if by else with_scalars(counts, __all=F.sum("n"))
    return rows.select(*by, "bin", (F.col("n") / (F.col("__all") * ((high - low) / bins))).alias("density"))


def centroid_histogram(rows: DataFrame, bins: int, x: str = "cen", *by: str) -> DataFrame:
    """Histogram from the 1st to the 99th percentile."""
    ends = quantiles(rows, {"low": (x, 0.01), "high": (x, 0.99)})
    low, high = (F.lit(ends[k]).cast("double") for k in ("low", "high"))
    inside = rows.where(F.col(x).between(low, high))
    return inside.groupBy(*by, F.coalesce(bin_of(F.col(x), low, (high - low) / bins, bins), F.lit(0)).alias("bin")).agg(F.count("*").alias("n"))


def ion_image(images: DataFrame, frames: DataFrame, qi: int, channel: int) -> DataFrame:
    """pix and inten over all tissue pixels, from a scaled sparse image."""
    own = images.where((F.col("qi") == qi) & (F.col("channel") == channel)).select("pix", (F.col("ratio") * F.col("scale")).alias("inten"))
    return frames.where("is_on").select("pix").distinct().join(own, "pix", "left").na.fill(0.0, ["inten"])


def envelope_against_averagine(evidence: DataFrame, qi: int) -> DataFrame:
    """channel, observed and expected share of a query's envelope."""
    row = evidence.where(F.col("qi") == qi)
    total = F.col("env0") + F.col("env1") + F.col("env2")
    expected = chem.averagine_isotopes(F.col("mz"))
    return row.select(F.explode(F.array(*(F.struct(F.lit(i).alias("channel"), F.try_divide(F.col(f"env{i}"), total).alias("observed"), e.alias("expected")) for i, e in enumerate(expected)))).alias("x")).select("x.*")


def mz_profile(profile: DataFrame, qi: int) -> DataFrame:
    return profile.where(F.col("qi") == qi).select("bin", "inten")


def best_rows(rows: DataFrame) -> DataFrame:
    """The best row of each peptide, ties by row_id."""
    return rows.groupBy("peptide").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "peptide"]), F.struct(-F.col("s"), F.col("row_id"))).alias("b")).select("peptide", "b.*")


def contributions(rows: DataFrame, signs: dict[str, float], peptide: str) -> DataFrame:
    """term and signed z-score of a peptide's best row."""
    from ..operators.stats import z_scores

    z = z_scores(rows, {t: f"__z_{t}" for t in signs})
    best = best_rows(z.where(F.col("peptide") == peptide))
    return best.select(F.explode(F.array(*(F.struct(F.lit(t).alias("term"), (F.col(f"__z_{t}") * s).alias("value")) for t, s in signs.items()))).alias("x")).select("x.*")


def image_pairs(found: DataFrame) -> DataFrame:
    """i, j and group: the pairs of images of each protein (qi, protein), each once."""
    ids = found.select("protein", "qi").distinct()
    pairs = ids.withColumnRenamed("qi", "i").join(ids.withColumnRenamed("qi", "j"), "protein").where("i < j")
    return pairs.groupBy("i", "j").agg(F.min(F.col("protein").cast("string")).alias("group"))


def image_correlations(images: DataFrame, pairs: DataFrame, n_pixels: int) -> DataFrame:
    """i, j and r for the asked pairs (i, j, group) of images (qi, pix, m): plain Pearson, no mean image."""
    own = images.groupBy("qi").agg(F.sum("m").alias("s"), F.sum(F.col("m") * F.col("m")).alias("ss"))
    side = lambda x: own.select(F.col("qi").alias(x), F.col("s").alias(f"s{x}"), F.col("ss").alias(f"ss{x}"))
    rows = products(images, pairs).join(side("i"), "i", "left").join(side("j"), "j", "left").na.fill(0.0, ["si", "ssi", "sj", "ssj"])
    vi, vj = F.col("ssi") - F.col("si") * F.col("si") / n_pixels, F.col("ssj") - F.col("sj") * F.col("sj") / n_pixels
    return rows.select("i", "j", F.when((vi > 1e-10) & (vj > 1e-10), (F.col("g") - F.col("si") * F.col("sj") / n_pixels) / F.sqrt(vi * vj)).alias("r"))


def correlations_within(images: DataFrame, members: DataFrame, n_pixels: int) -> DataFrame:
    """``image_correlations`` of all pairs of each group (members: qi, group, each image in one), by blocks
    of a group's images, so that pairs are made where they are multiplied."""
    own = images.groupBy("qi").agg(F.sum("m").alias("s"), F.sum(F.col("m") * F.col("m")).alias("ss"))

    def finish(qi, i, j, g, s, ss):
        vi, vj = (ss[x] - s[x] * s[x] / n_pixels for x in (i, j))
        good = (vi > 1e-10) & (vj > 1e-10)
        r = np.where(good, (g - s[i] * s[j] / n_pixels) / np.sqrt(np.where(good, vi * vj, 1.0)), np.nan)
        return pa.table({"i": qi[i], "j": qi[j], "r": pa.array(r, pa.float64(), from_pandas=True)})

    return within(images, members, own, finish, "i long, j long, r double")


def protein_rows(proteins: DataFrame, peptides: DataFrame, level: float, decoys: bool = False) -> DataFrame:
    """Proteins with n_peptides, n_reported and n_gt."""
    counts = peptides.groupBy("protein").agg(F.count("*").alias("n_peptides"), F.count_if(F.col("q") <= level).alias("n_reported"), F.count_if("is_gt").alias("n_gt"))
    kept = proteins if decoys else proteins.where("not is_decoy")
    return kept.join(counts, "protein", "left").na.fill(0, ["n_peptides", "n_reported", "n_gt"])


def peptide_rows(peptides: DataFrame, imaged: DataFrame, decoys: bool = False, protein: str | None = None) -> DataFrame:
    """Peptides with a flag for those whose images were kept."""
    kept = peptides if decoys else peptides.where("not is_decoy")
    kept = kept.where(F.col("protein") == protein) if protein is not None else kept
    return kept.join(imaged.select("qi").distinct().withColumn("has_images", F.lit(True)), "qi", "left").withColumn("has_images", F.coalesce("has_images", F.lit(False)))


def searched(grid: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows that hold a text in one of the columns, whatever its case."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower())), F.lit(False))
    return grid.where(found)


def same_ion(rows: DataFrame, feature_mz: float, ppm: float = 0.05) -> DataFrame:
    """Rows that read an ion; the range is pushed to the scan."""
    low, high = ppm_window(F.lit(feature_mz), ppm)
    return rows.where(F.col("feature_mz").between(low, high))


def family(rows: DataFrame, peptide: str) -> DataFrame:
    """A peptide, its parent, its decoys, and the other decoys of its parent."""
    parent = rows.where(F.col("peptide") == peptide).agg(F.max("parent_peptide").alias("__parent"))
    joined = rows.join(F.broadcast(parent))  # one row
    return joined.where((F.col("peptide") == peptide) | (F.col("parent_peptide") == peptide) | (F.col("peptide") == F.col("__parent")) | (F.col("parent_peptide") == F.col("__parent"))).drop("__parent")


def viewer_selection(rows: DataFrame, peptides: DataFrame, proteins: DataFrame, all_targets: bool = False, all_decoys: bool = False) -> DataFrame:
    """qi whose images are kept: peptides at REPORTED_Q, target peptides of proteins at that picked q,
    known ones, and the TOP_DECOYS best decoys. Peptides are read once, and once more for the decoys."""
    good = proteins.where((F.col("q_picked") <= REPORTED_Q) & ~F.col("is_decoy")).select("protein", F.lit(True).alias("__good"))
    wanted = (F.col("q") <= REPORTED_Q) | (~F.col("is_decoy") & (F.coalesce("__good", F.lit(False)) | F.col("is_gt")))
    top = peptides.where("is_decoy").orderBy(F.desc("s"), "peptide").limit(TOP_DECOYS).select("peptide")
    chosen = peptides.join(good, "protein", "left").where(wanted).select("peptide").union(top)
    out = rows.join(chosen, "peptide", "left_semi").select("qi")
    if all_targets:
        out = out.union(rows.where("not is_decoy").select("qi"))
    if all_decoys:
        out = out.union(rows.where("is_decoy").select("qi"))
    return out.distinct()


def headline(peptides: DataFrame, proteins: DataFrame, level: float) -> DataFrame:
    """One row: peptides, proteins, picked proteins and known peptides at a level."""
    a = peptides.agg(F.count_if((F.col("q") <= level) & ~F.col("is_decoy")).alias("peptides"), F.count_if((F.col("q") <= level) & F.col("is_gt")).alias("known"))
    b = proteins.agg(F.count_if((F.col("q") <= level) & ~F.col("is_decoy")).alias("proteins"), F.count_if((F.col("q_picked") <= level) & ~F.col("is_decoy")).alias("proteins_picked"))
    return a.join(F.broadcast(b))


def only_in_one(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Keys that one of two tables has and the other hasn't, with a column side. One
    pre-aggregated pass, no join of all rows."""
    tagged = lambda df, left: df.select(*keys, F.lit(left).alias("__left"))
    unmatched = F.when(reduce(lambda x, y: x | y, [F.col(k).isNull() for k in keys]), F.col("__left"))  # a null equals no other
    found = tagged(a, True).unionByName(tagged(b, False)).groupBy(*keys, unmatched.alias("__own")).agg(F.bool_or("__left").alias("__any"), F.bool_and("__left").alias("__all"))
    return found.where("__any = __all").select(*keys, F.when(F.col("__any"), "left").otherwise("right").alias("side"))


def compared_runs(a: dict[str, DataFrame], b: dict[str, DataFrame], levels: tuple[float, ...] = LEVELS) -> dict[str, DataFrame]:
    """Of two runs (as results are opened): terms (the greatest difference of every term over the rows of
    both), and ids (peptides that only one of them reports, with the level and the side)."""
    terms = [*SIGNS, "n_partners", "s0", "s"]
    parts = []
    for level in levels:
        reported = lambda run: run["peptides"].where((F.col("q") <= level) & ~F.col("is_decoy"))  # noqa: B023, E731
        parts.append(only_in_one(reported(a), reported(b), "peptide").withColumn("level", F.lit(level)))
    return {"terms": differences(a["rows"], b["rows"], ["peptide"], terms), "ids": reduce(DataFrame.unionByName, parts)}
