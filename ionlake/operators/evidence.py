"""Evidence from an acquisition: events to m/z windows, isotope images, their statistics and
colocalisation. Images stay sparse and long (qi, channel, pix, inten); absent is zero."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chem
from .gram import both_ways, products, within
from .lineage import cut
from .rangejoin import met_whole, ppm_join, ppm_window
from .selection import quantiles
from .stats import p90_of_nonzero, zero_aware_quantile

CHANNELS = (-1, 0, 1, 2)
PROFILE_PPM = 25
FLAT = 1e-10


def pixels(frames: DataFrame) -> DataFrame:
    """``frames`` (frame, x, y, tic) with pix = row * width + column from the least coordinates."""
    box = frames.agg(F.min("x").alias("__x0"), F.min("y").alias("__y0"), F.max("x").alias("__x1"))
    at = (F.col("y") - F.col("__y0")) * (F.col("__x1") - F.col("__x0") + 1) + F.col("x") - F.col("__x0")
    return frames.join(F.broadcast(box)).withColumn("pix", at).drop("__x0", "__y0", "__x1")  # one row


def tissue_mask(frames: DataFrame, quantile: float) -> DataFrame:
    """``frames`` with is_on: tic at or above the quantile of the positive ones (0: any positive);
    a missing tic is 0."""
    tic = frames.withColumn("tic", F.coalesce("tic", F.lit(0.0)))
    if quantile <= 0:
        return tic.withColumn("is_on", F.col("tic") > 0)
    least = quantiles(tic.where("tic > 0"), {"tic": ("tic", quantile)})["tic"]
    return tic.withColumn("is_on", F.coalesce(F.col("tic") >= F.lit(least).cast("double"), F.lit(False)))


def windows(queries: DataFrame, ppm: float) -> DataFrame:
    """qi, channel, lo and hi of each query's isotope windows."""
    rows = queries.select("qi", "mz", F.explode(F.array(*map(F.lit, CHANNELS))).alias("channel"))
    low, high = ppm_window(F.col("mz") + F.col("channel") * chem.NEUTRON, ppm)
    return rows.select("qi", "channel", low.alias("lo"), high.alias("hi"))


def met(events, intervals: DataFrame, ppm: float, at: str) -> DataFrame:
    """Events (``at``, mz, inten) with the intervals (lo, hi) that hold them. ``events``: a DataFrame, or
    a store of events, which aren't moved then."""
    events = _unless_few(events, intervals)
    if isinstance(events, DataFrame):
        return ppm_join(events.select(at, "mz", "inten"), intervals, "mz", "lo", "hi", ppm * 2)
    return events.met(intervals, "lo", "hi", ppm)


def _unless_few(events, intervals: DataFrame):
    """A store of events as a DataFrame where there are too many intervals to be broadcast."""
    return events if isinstance(events, DataFrame) or events.takes(intervals) else events.events


def window_sums(events, windowed: DataFrame, ppm: float, at: str = "pix") -> DataFrame:
    """qi, channel, pix and inten: events (pix, mz, inten) summed in each window and pixel. ``at``:
    another column than pix that says where events are. Windows are met whole, so that what they hold
    is summed where it is met; only the sums of windows that repeat qi and channel are moved."""
    events, key = _unless_few(events, windowed), ["qi", "channel"]
    summed = lambda rows, *more: rows.groupBy(*more, *key, at).agg(F.sum("inten").alias("inten")).drop(*more)
    if not isinstance(events, DataFrame):
        return summed(events.met(windowed, "lo", "hi", ppm))
    whole = lambda asked: summed(*_flat(met_whole(events.select(at, "mz", "inten"), asked, "mz", "lo", "hi", ppm * 2)))
    repeated = cut(windowed.groupBy(*key).count().where("count > 1").select(key))
    if repeated.isEmpty():
        return whole(windowed)
    once, again = (windowed.join(repeated, [windowed[c].eqNullSafe(repeated[c]) for c in key], how) for how in ("left_anti", "left_semi"))
    return whole(once).unionByName(summed(whole(again)))


def _flat(met: tuple[DataFrame, list[str]]) -> tuple:
    return met[0], *met[1]


def by_channel(sums: DataFrame) -> DataFrame:
    """qi, pix and a column for each channel: a, m, b, c for M-1 to M+2, zero where absent."""
    names = dict(zip(CHANNELS, "ambc", strict=True))
    return sums.groupBy("qi", "pix").agg(*(F.coalesce(F.sum(F.when(F.col("channel") == k, F.col("inten"))), F.lit(0)).alias(n) for k, n in names.items()))


def pearson(x: str, y: str, n: Column) -> Column:
    """An aggregate: correlation over ``n`` points of which those that aren't rows are zero in both;
    null where either is flat."""
    sx, sy, sxy = F.sum(x), F.sum(y), F.sum(F.col(x) * F.col(y))
    vx, vy = F.sum(F.col(x) * F.col(x)) - sx * sx / n, F.sum(F.col(y) * F.col(y)) - sy * sy / n
    return F.when((vx > FLAT) & (vy > FLAT), (sxy - sx * sy / n) / F.sqrt(vx * vy))


def image_statistics(images: DataFrame, n_pixels: Column | float, n_on: Column | float) -> DataFrame:
    """isum, p90, env0 to env2, iso_r and mm1_r of each qi from ``by_channel`` rows with is_on."""
    n_pixels, n_on = (F.lit(float(n)) if isinstance(n, (int, float)) else n for n in (n_pixels, n_on))
    on = images.withColumns({f"{c}_on": F.when(F.col("is_on"), F.col(c)).otherwise(0) for c in "amb"})
    slope = lambda c: F.coalesce(F.try_divide(F.sum(F.col("m") * F.col(c)), F.sum(F.col("m") * F.col("m"))), F.lit(0.0))
    rows = on.groupBy("qi").agg(
        F.sum("m").cast("double").alias("isum"),
        p90_of_nonzero(F.collect_list(F.when(F.col("m") > 0, F.col("m").cast("double")))).alias("p90"),
        slope("b").alias("__s1"),
        slope("c").alias("__s2"),
        pearson("m_on", "b_on", n_on).alias("iso_r"),
        F.when(F.sum("m_on") > 0, F.coalesce(pearson("a_on", "m_on", n_on), F.lit(0.0))).alias("mm1_r"),
    )
    mean = F.when(F.col("isum") > 0, F.col("isum") / n_pixels)
    return rows.select("qi", "isum", "p90", mean.alias("env0"), (mean * F.col("__s1")).alias("env1"), (mean * F.col("__s2")).alias("env2"), "iso_r", "mm1_r")


def top_decile(images: DataFrame, n_on: int) -> DataFrame:
    """qi and pix of the on-tissue pixels at or above the 0.9 quantile (absent pixels are zeros) and
    above zero. ``images``: qi, pix, m on tissue."""
    cuts = images.where("m > 0").groupBy("qi").agg(F.collect_list(F.col("m").cast("double")).alias("__values")).withColumn("__n", F.lit(n_on)).select("qi", zero_aware_quantile("__values", "__n", 0.9).alias("__cut"))
    return images.join(cuts, "qi").where("m > 0 and m >= __cut").select("qi", "pix")


def profile_hits(events, queries: DataFrame, at: str = "pix") -> DataFrame:
    """qi, pix (or another ``at``), bin (-25 to 25 ppm) and inten of all pixels."""
    ppm = PROFILE_PPM + 1.0
    low, high = ppm_window(F.col("q_mz"), ppm)
    asked = queries.select("qi", F.col("mz").alias("q_mz")).withColumns({"lo": low, "hi": high})
    hits = met(events, asked, ppm, at).withColumn("bin", chem.ppm_bin(F.col("mz"), F.col("q_mz")))
    return hits.where(F.col("bin").between(0, 2 * PROFILE_PPM)).groupBy("qi", at, (F.col("bin") - PROFILE_PPM).alias("bin")).agg(F.sum("inten").alias("inten"))


def profiles(events, queries: DataFrame, bright: DataFrame | None = None) -> DataFrame:
    """qi, bin (-25 to 25 ppm) and inten over each query's bright pixels; over all pixels without
    ``bright``. Those aren't told apart then: events of one m/z are one, and so are queries."""
    if bright is not None:
        return profile_of(profile_hits(events, queries), bright)
    points = (events if isinstance(events, DataFrame) else events.events).groupBy("mz").agg(F.sum("inten").alias("inten"))
    low, high = ppm_window(F.col("q_mz"), PROFILE_PPM + 1.0)
    asked = queries.select(F.col("mz").alias("q_mz")).distinct().withColumns({"lo": low, "hi": high})
    hits, keys = met_whole(points, asked, "mz", "lo", "hi", (PROFILE_PPM + 1.0) * 2)
    hits = hits.withColumn("bin", chem.ppm_bin(F.col("mz"), F.col("q_mz"))).where(F.col("bin").between(0, 2 * PROFILE_PPM))
    found = hits.groupBy(*keys, "q_mz", (F.col("bin") - PROFILE_PPM).alias("bin")).agg(F.sum("inten").alias("inten")).drop(*keys)
    return found.join(queries.select("qi", F.col("mz").alias("q_mz")), "q_mz").groupBy("qi", "bin").agg(F.sum("inten").alias("inten"))


def profile_of(hits: DataFrame, bright: DataFrame) -> DataFrame:
    return hits.join(bright, ["qi", "pix"], "left_semi").groupBy("qi", "bin").agg(F.sum("inten").alias("inten"))


def centroids(profile: DataFrame) -> DataFrame:
    return profile.groupBy("qi").agg(F.try_divide(F.sum(F.col("bin") * F.col("inten")), F.sum("inten")).alias("cen"))


def tic_normalised(images: DataFrame) -> DataFrame:
    """Each pixel divided by its sum over all queries, where that is positive."""
    total = images.groupBy("pix").agg(F.sum("m").alias("__tic"))
    return images.join(total, "pix").withColumn("m", F.when(F.col("__tic") > 0, F.col("m") / F.col("__tic")).otherwise(F.col("m"))).drop("__tic")


def _beside_mean(images: DataFrame, n_queries: int, n_on: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The points that aren't zero; b, avg and g of each image; m2 and mbar of the mean image."""
    one = images.where("m <> 0").select("qi", "pix", F.col("m").cast("double").alias("m"))
    mean = one.groupBy("pix").agg((F.sum("m") / n_queries).alias("mu"))
    scalars = mean.agg(F.coalesce(F.sum(F.col("mu") * F.col("mu")), F.lit(0.0)).alias("m2"), F.coalesce(F.sum("mu") / n_on, F.lit(0.0)).alias("mbar"))
    own = one.join(mean, "pix").groupBy("qi").agg(F.sum(F.col("m") * F.col("mu")).alias("b"), (F.sum("m") / n_on).alias("avg"), F.sum(F.col("m") * F.col("m")).alias("g"))
    return one, own, scalars


def colocalisation_within(images: DataFrame, members: DataFrame, n_queries: int, n_on: int, weights: DataFrame | None = None) -> DataFrame:
    """``colocalisation`` of all pairs of two images of a group (members: qi, group, each image in one),
    made by blocks of a group's images: qi, pqi and r, in both orders. With ``weights`` (qi, p90, ev) no
    pair becomes a row: qi, x and n_partners as ``score.weighted_coloc`` has them, of correlations with six decimals."""
    one, own, scalars = _beside_mean(images, n_queries, n_on)
    m2, mbar = scalars.first()

    def correlations(i, j, g, own_g, b, avg):
        centred = lambda g, s, t: g - b[s] - b[t] + m2 - n_on * (avg[s] - mbar) * (avg[t] - mbar)
        vi, vj = centred(own_g[i], i, i), centred(own_g[j], j, j)
        good = (vi > FLAT) & (vj > FLAT)
        return np.where(good, centred(g, i, j) / np.sqrt(np.where(good, vi * vj, 1.0)), np.nan)

    def pairs(qi, i, j, g, own_g, b, avg):
        return both_ways(correlations(i, j, g, own_g, b, avg), qi, i, j)

    def sums(qi, i, j, g, own_g, b, avg, root, ev):
        r = np.round(correlations(i, j, g, own_g, b, avg), 6)
        total = lambda x: np.bincount(i, x[0], len(qi)) + np.bincount(j, x[1], len(qi))
        w = root[i] * root[j] * ev[j], root[i] * root[j] * ev[i]
        return pa.table({"qi": qi, "w": total(w), "wr": total([np.where(np.isnan(r), 0.0, v * r) for v in w]), "n": total([np.ones(len(i))] * 2).astype(np.int64)})

    own = own.withColumnRenamed("g", "own_g")
    if weights is None:
        return within(one, members, own, pairs, "qi long, pqi long, r double")
    own = members.select("qi").distinct().join(own, "qi", "left").join(weights.select("qi", F.sqrt(F.greatest(F.coalesce("p90", F.lit(0.0)), F.lit(0.0))).alias("root"), "ev"), "qi", "left")
    parts = within(one, members, own, sums, "qi long, w double, wr double, n long").groupBy("qi").agg(*(F.sum(c).alias(c) for c in ("w", "wr", "n")))
    return parts.where("n > 0").select("qi", F.when(F.col("w") > 0, F.col("wr") / F.col("w")).alias("x"), F.col("n").alias("n_partners"))


def colocalisation(images: DataFrame, pairs: DataFrame, n_queries: int, n_on: int) -> DataFrame:
    """qi, pqi and r of the asked pairs: the correlation of two images (qi, pix, m) after the mean
    image of all queries is taken from each. Pairs of one protein (if they name it) share tiles. With G
    the products of two images over the pixels they share and b, m2 those with and of the mean image,
    C = G - b_i - b_j + m2 - n * (mean_i - mean) * (mean_j - mean) and r = C_ij / sqrt(C_ii C_jj)."""
    one, own, scalars = _beside_mean(images, n_queries, n_on)
    group = F.regexp_replace("protein", "^DECOY_", "") if "protein" in pairs.columns else F.lit("")
    asked = pairs.select(F.least("qi", "pqi").alias("i"), F.greatest("qi", "pqi").alias("j"), group.alias("group")).groupBy("i", "j").agg(F.min("group").alias("group"))
    shared = products(one, asked.where("i < j")).withColumnRenamed("g", "G")
    side = lambda s: own.select(F.col("qi").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("b", "avg", "g")))
    rows = asked.join(shared, ["i", "j"], "left").join(side("i"), "i", "left").join(side("j"), "j", "left").na.fill(0.0).join(F.broadcast(scalars))  # one row
    rows = rows.withColumn("G", F.when(F.col("i") == F.col("j"), F.col("g_i")).otherwise(F.col("G")))
    centred = lambda g, s, t: F.col(g) - F.col(f"b_{s}") - F.col(f"b_{t}") + F.col("m2") - n_on * (F.col(f"avg_{s}") - F.col("mbar")) * (F.col(f"avg_{t}") - F.col("mbar"))
    spread = centred("g_i", "i", "i") * centred("g_j", "j", "j")
    r = rows.select("i", "j", F.when((centred("g_i", "i", "i") > FLAT) & (centred("g_j", "j", "j") > FLAT), centred("G", "i", "j") / F.sqrt(spread)).alias("r"))
    return pairs.select("qi", "pqi").distinct().withColumns({"i": F.least("qi", "pqi"), "j": F.greatest("qi", "pqi")}).join(r, ["i", "j"], "left").select("qi", "pqi", "r")


def valid_images(images: DataFrame, queries: DataFrame, n_queries: int, n_on: int) -> DataFrame:
    """qi and valid: whether an image isn't flat after the mean image is taken from it."""
    own = queries.select("qi", F.col("qi").alias("pqi"))
    return colocalisation(images, own, n_queries, n_on).select("qi", F.col("r").isNotNull().alias("valid"))


def unit_rows(images: DataFrame, n_queries: int, n_on: int) -> DataFrame:
    """Dense colocalisation rows (qi, pix, x) for images that have a row for every pixel: the mean
    image taken off, centred, unit norm."""
    by_qi = Window.partitionBy("qi")
    off = images.join(images.groupBy("pix").agg((F.sum("m") / n_queries).alias("__mu")), "pix").withColumn("x", F.col("m") - F.col("__mu"))
    off = off.withColumn("x", F.col("x") - F.sum("x").over(by_qi) / n_on)
    return off.select("qi", "pix", F.try_divide(F.col("x"), F.sqrt(F.sum(F.col("x") * F.col("x")).over(by_qi))).alias("x"))
