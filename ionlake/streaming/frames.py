"""Window sums of an acquisition that is still running: Structured Streaming over arriving events.

The sum of intensities is mergeable, so that a stream of events gives the same table as a batch
over all of them; the watermark bounds the state to windows of frames that can still change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.rangejoin import ppm_join


def read_stream(spark: SparkSession, folder: str, schema: StructType | str, files_per_trigger: int = 16) -> DataFrame:
    """Events from Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def window_sums(events: DataFrame, windows: DataFrame, ppm: float, time: str | None = None, late: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """qi, channel, pix and inten; with ``time``, for each period of ``every``, final once events are
    ``late`` past it."""
    hits = ppm_join(events.withWatermark(time, late) if time else events, windows, "mz", "lo", "hi", ppm * 2)
    keys = ["qi", "channel", "pix"]
    return hits.groupBy(*([F.window(time, every)] if time else []), *keys).agg(F.sum("inten").alias("inten"))
