"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionlake.operators.lineage import cut, shared_folder

__all__ = ["BATCH_ROWS", "cut", "filesystem", "hash_share", "kept", "make_room", "memory", "per_batch", "shared_folder", "small_batches", "table"]

#: Rows that Spark hands to a Python task at once. Texts are whole, so that fewer rows mean less memory.
BATCH_ROWS = 500


_memories: list[dict] = []


def memory() -> dict:
    """A dictionary that a Python worker keeps from task to task, until another operator makes room."""
    _memories.append({})
    return _memories[-1]


def make_room() -> None:
    """Empties all memories of this Python worker, which may serve another operator than before."""
    for kept_so_far in _memories:
        kept_so_far.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """Bounds what a Python task holds at once; returns ``df``."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def filesystem(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder that Spark names by path or URI."""
    return pyarrow.fs.FileSystem.from_uri(folder.rstrip("/"))


def hash_share(key: Column, share: float, seed: int) -> Column:
    """True for about ``share`` of the keys, the same ones in every run."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return run


def kept(df: DataFrame, *names: str) -> list[str]:
    """Columns of ``df`` other than ``names``, to be carried through beside new ones of those names."""
    return [c for c in df.columns if c not in names]
