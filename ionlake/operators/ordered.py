"""Running sums and ranks in a global order, without sending all rows to one task.

Rows are put into buckets by sampled quantiles of the order column; windows run inside a bucket, and
what came before a bucket is added from a table of at most BUCKETS rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows a bucket should hold, and most buckets.
ROWS, BUCKETS = 500_000, 1_000
BUCKET = "__bucket"


def bucketed(df: DataFrame, by: str, rows: int = ROWS) -> DataFrame:
    """``df`` with a column BUCKET that ascends with ``by``; equal values share a bucket."""
    buckets = min(BUCKETS, -(-df.count() // rows))
    if buckets <= 1:
        return df.withColumn(BUCKET, F.lit(0))
    cuts = sorted(set(df.approxQuantile(by, [i / buckets for i in range(1, buckets)], 0.1 / buckets)))
    edges = F.array(*map(F.lit, cuts))
    return df.withColumn(BUCKET, F.size(F.filter(edges, lambda e: e <= F.col(by))))


def _before(df: DataFrame, aggregates: dict[str, Column], over: dict[str, Column], descending: bool) -> DataFrame:
    """A row for each bucket with what the buckets before it add up to."""
    totals = df.groupBy(BUCKET).agg(*(a.alias(n) for n, a in aggregates.items()))
    w = Window.orderBy(F.desc(BUCKET) if descending else F.asc(BUCKET)).rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS rows
    return totals.select(BUCKET, *(over[n].over(w).alias(f"__before_{n}") for n in aggregates))


def running_sums(df: DataFrame, by: str, sums: dict[str, Column], descending: bool = True) -> DataFrame:
    """Adds for each name the sum over all rows up to this one in the order of ``by``, ties
    included. ``df`` comes from ``bucketed``."""
    before = _before(df, {n: F.sum(c) for n, c in sums.items()}, {n: F.sum(n) for n in sums}, descending)
    w = Window.partitionBy(BUCKET).orderBy(F.desc(by) if descending else F.asc(by)).rangeBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({f"__in_{n}": F.sum(c).over(w) for n, c in sums.items()}).join(F.broadcast(before), BUCKET)
    return out.withColumns({n: F.col(f"__in_{n}") + F.coalesce(f"__before_{n}", F.lit(0)) for n in sums}).drop(*(f"__{k}_{n}" for k in ("in", "before") for n in sums))


def running_min(df: DataFrame, by: str, name: str, value: str, descending: bool = False) -> DataFrame:
    """Adds the least ``value`` of all rows up to this one in the order of ``by``, ties included."""
    before = _before(df, {name: F.min(value)}, {name: F.min(name)}, descending)
    w = Window.partitionBy(BUCKET).orderBy(F.desc(by) if descending else F.asc(by)).rangeBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("__in", F.min(value).over(w)).join(F.broadcast(before), BUCKET)
    return out.withColumn(name, F.least("__in", f"__before_{name}")).drop("__in", f"__before_{name}")


def following(df: DataFrame, by: str, name: str) -> DataFrame:
    """Adds the next larger value of ``by``, whose values are distinct; infinity after the last."""
    ahead = _before(df, {name: F.min(by)}, {name: F.min(name)}, descending=True)
    out = df.withColumn("__next", F.lead(by).over(Window.partitionBy(BUCKET).orderBy(by))).join(F.broadcast(ahead), BUCKET)
    return out.withColumn(name, F.coalesce("__next", f"__before_{name}", F.lit(float("inf")))).drop("__next", f"__before_{name}")


def average_rank(df: DataFrame, by: str, name: str) -> DataFrame:
    """Adds the average rank of ``by`` over the number of rows, equal values sharing theirs."""
    rows = running_sums(bucketed(df, by), by, {"__upto": F.lit(1)}, descending=False)
    tied = F.count("*").over(Window.partitionBy(BUCKET, by))
    total = df.agg(F.count("*").alias("__total"))
    return rows.withColumn("__tied", tied).join(F.broadcast(total)).withColumn(name, (F.col("__upto") - (F.col("__tied") - 1) / 2) / F.col("__total")).drop("__upto", "__tied", "__total", BUCKET)
