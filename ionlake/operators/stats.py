"""Column statistics: median fill, z-scores, signed sums, quantiles that know of absent zeros,
histograms and the box mode. Scalars come from one-row aggregates that are joined, never collected."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .ordered import bucketed, following, running_sums
from .selection import quantiles


def with_scalars(df: DataFrame, **aggregates: Column) -> DataFrame:
    """``df`` with the aggregates over all its rows as columns."""
    return df.join(F.broadcast(df.agg(*(a.alias(n) for n, a in aggregates.items()))))  # one row


def median_filled(df: DataFrame, *columns: str) -> DataFrame:
    """Nulls of each column become its median over all rows."""
    medians = quantiles(df, {c: (c, 0.5) for c in columns})
    return df.withColumns({c: F.coalesce(c, F.lit(medians[c]).cast("double")) for c in columns})


def z_scores(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Adds a z-score (population deviation, 1 where it is 0) for each column, after the median
    fill (0 where all are null). ``columns``: column -> name of its z-score."""
    medians = quantiles(df, {c: (c, 0.5) for c in columns})
    rows = df.withColumns({f"__f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(medians[c] or 0.0)) for c in columns})
    spread: dict[str, Column] = {}
    for c in columns:
        spread |= {f"__avg_{c}": F.avg(f"__f_{c}"), f"__sd_{c}": F.stddev_pop(f"__f_{c}")}
    rows = with_scalars(rows, **spread)
    rows = rows.withColumns({z: (F.col(f"__f_{c}") - F.col(f"__avg_{c}")) / F.when(F.col(f"__sd_{c}") > 0, F.col(f"__sd_{c}")).otherwise(1.0) for c, z in columns.items()})
    return rows.drop(*(f"__{k}_{c}" for k in ("f", "avg", "sd") for c in columns))


def signed_sum(signs: Mapping[str, float]) -> Column:
    return sum((F.col(c) * F.lit(s) for c, s in signs.items()), F.lit(0.0))


def zero_aware_quantile(values: str, count: str, q: float) -> Column:
    """The linear quantile of ``count`` numbers of which only the non-zero ones are in the array
    ``values``."""
    ordered, n = F.array_sort(F.col(values)), F.col(count)
    at = F.lit(q) * (n - 1)
    low, zeros = F.floor(at).cast("int"), (n - F.size(values)).cast("int")
    value = lambda i: F.when(i < zeros, F.lit(0.0)).otherwise(F.get(ordered, i - zeros))
    high = F.least(low + 1, (n - 1).cast("int"))
    return value(low) + (at - low) * (value(high) - value(low))


def p90_of_nonzero(values: Column) -> Column:
    """The element at place int(0.9 n), from 0, of the n non-zero numbers in order; 0 without any."""
    ordered = F.array_sort(F.filter(values, lambda x: x != 0))
    n = F.size(ordered)
    return F.when(n > 0, F.get(ordered, F.floor(n * F.lit(0.9)).cast("int"))).otherwise(F.lit(0.0))


def bin_of(x: Column, low: Column | float, width: Column | float, bins: int) -> Column:
    """Bin of a histogram whose last bin is closed."""
    low, width = (F.lit(v) if isinstance(v, (int, float)) else v for v in (low, width))
    return F.least(F.floor(F.try_divide(x - low, width)), F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, x: str, low: float, high: float, bins: int, *by: str) -> DataFrame:
    """Rows in each of ``bins`` even bins from low to high (closed), for each value of ``by``."""
    inside = df.where(F.col(x).between(low, high))
    return inside.groupBy(*by, bin_of(F.col(x), low, (high - low) / bins, bins).alias("bin")).agg(F.count("*").alias("n"))


#: The grid of a box mode, the reach of its numbers, and the rounds of medians.
GRID_STEP, GRID_REACH, NUMBERS_REACH, ROUNDS = 0.05, 5.0, 10.0, 20


def box_counts(df: DataFrame, x: str, width: float) -> DataFrame:
    """i and n: how many numbers lie in the box of half-width ``width`` (closed) around the i-th point of
    the grid. A number is counted at each of its points, by a pre-aggregated sum."""
    steps = round(2 * GRID_REACH / GRID_STEP)
    near = df.where(F.abs(x) < NUMBERS_REACH).select(F.col(x).cast("double").alias("x"))
    at = lambda y: (F.col("x") + y + GRID_REACH) / GRID_STEP
    cells = F.sequence(F.greatest(F.ceil(at(-width) - 1e-7), F.lit(0)).cast("int"), F.least(F.floor(at(width) + 1e-7), F.lit(steps)).cast("int"))
    touched = near.where((F.col("x") + width >= -GRID_REACH) & (F.col("x") - width <= GRID_REACH))
    counts = touched.select(F.explode(cells).alias("i")).groupBy("i").agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("i"))
    return grid.join(counts, "i", "left").na.fill(0, ["n"])


def prefix_counts(df: DataFrame, x: str) -> DataFrame:
    """x, before, upto and next of each distinct number: how many are smaller, how many at most as large,
    and the next larger one; and a row of minus infinity. Made of sums in buckets, not of one sort."""
    counts = bucketed(df.where(F.col(x).isNotNull()).groupBy(F.col(x).cast("double").alias("x")).agg(F.count("*").alias("__n")), "x")
    rows = following(running_sums(counts, "x", {"upto": F.col("__n")}, descending=False), "x", "next")
    rows = rows.select("x", (F.col("upto") - F.col("__n")).alias("before"), "upto", "next")
    least = rows.agg(F.coalesce(F.min("x"), F.lit(float("inf"))).alias("next"))
    return rows.unionByName(least.select(F.lit(float("-inf")).alias("x"), F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("upto"), "next"))


#: One round looks up how many numbers lie below each end of the open box, then the numbers of the two
#: middle ranks between; the rounds are a recursive query over the table of counts.
_ROUNDS = """with recursive rounds(k, mode) as (
  select 0, mode from {start}
  union all
  select k + 1, (one.x + two.x) / 2 from rounds
  join {counts} low on low.x <= mode - {width} and mode - {width} < low.next
  join {counts} high on high.x < mode + {width} and mode + {width} <= high.next and high.upto > low.upto
  join {counts} one on one.before <= (low.upto + high.upto - 1) div 2 and (low.upto + high.upto - 1) div 2 < one.upto
  join {counts} two on two.before <= (low.upto + high.upto) div 2 and (low.upto + high.upto) div 2 < two.upto
  where k < {rounds}
) select max(case when k = {rounds} then mode end) as mode from rounds"""


def box_mode(df: DataFrame, x: str, width: float) -> DataFrame:
    """One row: mode, the centre of the box of half-width ``width`` that holds most numbers: the mean of
    the grid's best points, then ROUNDS times the median inside the open box (null once it is empty)."""
    counts = box_counts(df, x, width)
    best = with_scalars(counts, __most=F.max("n")).where("n = __most and n > 0")  # a row for each point
    start = best.agg((F.avg("i") * GRID_STEP - GRID_REACH).alias("mode")).where("mode is not null")
    table = cut(prefix_counts(df.where(F.abs(x) < NUMBERS_REACH), x))
    return df.sparkSession.sql(_ROUNDS, start=cut(start), counts=table, width=float(width), rounds=ROUNDS)
