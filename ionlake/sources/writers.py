"""Outputs of a run, written by executors to any file system that Spark knows."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, folder: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def write_tsv(df: DataFrame, folder: str, name: str) -> None:
    """Without qi, which is internal."""
    df.drop("qi").write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{folder}/{name}.tsv")


def write_grid(df: DataFrame, path: str) -> None:
    """A grid as it is shown, to CSV."""
    df.write.mode("overwrite").option("header", True).csv(path)


def scaled_images(images: DataFrame) -> DataFrame:
    """Images (qi, channel, pix, inten) over their largest value, which is kept as scale."""
    most = images.groupBy("qi", "channel").agg(F.greatest(F.max("inten").cast("double"), F.lit(1e-30)).alias("scale"))
    return images.join(most, ["qi", "channel"]).withColumn("ratio", (F.col("inten") / F.col("scale")).cast("float"))


def write_viewer(selected: DataFrame, images: DataFrame, profile: DataFrame, frames: DataFrame, folder: str) -> None:
    """Images and profiles of the selected queries, and the pixels' intensities. Partitioned by a
    range of qi, so that one query's image is read from one file."""
    kept = scaled_images(images.join(selected, "qi", "left_semi")).select("qi", "channel", "pix", "ratio", "scale")
    kept.repartitionByRange("qi").sortWithinPartitions("qi", "channel", "pix").write.mode("overwrite").parquet(f"{folder}/viewer/images.parquet")
    profile.write.mode("overwrite").parquet(f"{folder}/viewer/profiles.parquet")
    frames.select("frame", "pix", "tic", "is_on").write.mode("overwrite").parquet(f"{folder}/viewer/frames.parquet")


def write_run(spark: SparkSession, info: dict[str, Any], folder: str) -> None:
    """run.json: configuration, counts and steps, one small document."""
    spark.createDataFrame([(json.dumps(info, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/run.json")
