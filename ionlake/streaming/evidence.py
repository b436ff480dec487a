"""Evidence of an acquisition that is still running, kept for each query as state.

Events meet the queries' isotope windows and profiles as they arrive. For each query the state holds
the sums of the pixels that can still change and the moments over all pixels, from which its image
sum, envelope, correlations and centroid follow at once, so that a batch of events costs what it
brings and not what came before. With a time of events, pixels older than the watermark are final:
their sums leave the state, their part in the moments stays, and events for them that come later are
left out. After the last batch the rows equal the batch evidence, with all pixels taken as tissue
and the centroid over all pixels (the batch's bright pixels are known only at the end).

Nulls: events without m/z, pixel or intensity meet no window or add nothing; without a time (where
one is named) they are left out. A query without events has no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import chem
from ..operators.evidence import FLAT, PROFILE_PPM, windows
from ..operators.rangejoin import ppm_join, ppm_window

#: Channel number of rows that are in a profile.
PROFILE = 9
OUT = "qi long, isum double, env0 double, env1 double, env2 double, iso_r double, mm1_r double, cen double"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Sums over pixels of a (M-1), m, b (M+1), c (M+2) and their products, and of the profile.
MOMENTS = ("a", "m", "b", "c", "aa", "mm", "bb", "am", "mb", "mc", "bin_inten", "inten")
PRODUCTS = tuple(k for k in MOMENTS if len(k) == 2)


def _moments(pixel: tuple[float, ...]) -> dict[str, float]:
    one = dict(zip("ambc", pixel, strict=True))
    return one | {k: one[k[0]] * one[k[1]] for k in PRODUCTS}


def _correlation(s: dict[str, float], x: str, y: str, n: float) -> float | None:
    vx, vy = s[x + x] - s[x] ** 2 / n, s[y + y] - s[y] ** 2 / n
    return (s["".join(sorted(x + y, key="ambc".index))] - s[x] * s[y] / n) / (vx * vy) ** 0.5 if vx > FLAT and vy > FLAT else None


def _evidence(qi: int, s: dict[str, float], n: float) -> dict[str, float | None]:
    slope = lambda k: s[k] / s["mm"] if s["mm"] else 0.0
    mean = s["m"] / n if s["m"] > 0 else None
    envelope = [None if mean is None else mean * k for k in (1.0, slope("mb"), slope("mc"))]
    flank = (_correlation(s, "a", "m", n) or 0.0) if s["m"] > 0 else None
    return {"qi": qi, "isum": s["m"], **{f"env{i}": e for i, e in enumerate(envelope)}, "iso_r": _correlation(s, "m", "b", n), "mm1_r": flank, "cen": s["bin_inten"] / s["inten"] if s["inten"] else None}


class Evidence(StatefulProcessor):
    """Sums of a query's open pixels, and moments over all its pixels."""

    def __init__(self, n_pixels: int):
        self.n_pixels = float(n_pixels)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "pix long", "a double, m double, b double, c double, at long")
        self.sums = handle.getValueState("sums", ", ".join(f"{k} double" for k in MOMENTS))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.sums.get() if self.sums.exists() else None
        sums = dict(zip(MOMENTS, known or (0.0,) * len(MOMENTS), strict=True))
        final = timerValues.getCurrentWatermarkInMs()
        for part in rows:
            part = part[(part["at"] < 0) | (part["at"] >= final)]
            profile = part[part["channel"] == PROFILE]
            sums["inten"] += float(profile["inten"].sum())
            sums["bin_inten"] += float((profile["bin"] * profile["inten"]).sum())
            for pix, hits in part[part["channel"] != PROFILE].groupby("pix"):
                held = self.open.getValue((int(pix),)) if self.open.containsKey((int(pix),)) else None
                before = tuple(held[:4]) if held else (0.0,) * 4
                added = hits.groupby("channel")["inten"].sum()
                after = tuple(x + float(added.get(k, 0.0)) for x, k in zip(before, (-1, 0, 1, 2), strict=True))
                old = _moments(before)
                for k, x in _moments(after).items():
                    sums[k] += x - old[k]
                self.open.updateValue((int(pix),), (*after, int(max(hits["at"].max(), held[4] if held else -1))))
        if final > 0:
            for (pix,), row in list(self.open.iterator()):
                if 0 <= row[4] < final:
                    self.open.removeKey((pix,))
        self.sums.update(tuple(sums[k] for k in MOMENTS))
        yield pd.DataFrame([_evidence(key[0], sums, self.n_pixels)])

    def close(self) -> None:
        pass


def running_evidence(events: DataFrame, queries: DataFrame, ppm: float, n_pixels: int, time: str | None = None, late: str = "10 minutes") -> DataFrame:
    """A stream, in update mode, of the columns OUT: a row for each query (qi, mz) that a batch of
    ``events`` (pix, mz, inten, and ``time``) changed. The session's state store has to be RocksDB
    (``with_state_store``)."""
    low, high = ppm_window(F.col("mz"), PROFILE_PPM + 1.0)
    profile = queries.select("qi", F.lit(PROFILE).alias("channel"), low.alias("lo"), high.alias("hi"), F.col("mz").alias("q_mz"))
    asked = windows(queries, ppm).withColumn("q_mz", F.lit(None).cast("double")).unionByName(profile)
    at = F.unix_millis(time) if time else F.lit(-1).cast("long")
    rows = events.withWatermark(time, late).where(F.col(time).isNotNull()) if time else events
    rows = rows.select("pix", "mz", "inten", at.alias("at"), *([time] if time else [])).where("pix is not null and inten is not null")
    hits = ppm_join(rows, asked, "mz", "lo", "hi", 2 * (PROFILE_PPM + 1.0))
    bin_ = chem.ppm_bin(F.col("mz"), F.col("q_mz")) - PROFILE_PPM
    hits = hits.select(F.col("qi").cast("long").alias("qi"), F.col("channel").cast("int").alias("channel"), F.col("pix").cast("long").alias("pix"), F.col("inten").cast("double").alias("inten"), F.coalesce(bin_, F.lit(0)).alias("bin"), "at", *([time] if time else []))
    hits = hits.where(F.abs("bin") <= PROFILE_PPM)
    return hits.groupBy("qi").transformWithStateInPandas(statefulProcessor=Evidence(n_pixels), outputStructType=OUT, outputMode="Update", timeMode="EventTime" if time else "None")


def with_state_store(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


class Progress(StreamingQueryListener):
    """Calls ``report`` with the number of each batch, its events, events a second and rows of state."""

    def __init__(self, report: Callable[[int, int, float, int], None]):
        self.report = report

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.report(p.batchId, p.numInputRows, p.processedRowsPerSecond, sum(s.numRowsTotal for s in p.stateOperators))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
