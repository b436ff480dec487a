"""Comparison of two tables that ought to be the same: row by row, and by one digest of all rows in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import BUCKET, bucketed, running_sums

#: Rows whose digests are chained in one group.
CHAIN = 10_000


def differences(left: DataFrame, right: DataFrame, keys: list[str], terms: list[str]) -> DataFrame:
    """A row for each term: n_both, n_left and n_right (keys that both or one of the tables have), n_differ
    (of both, where the term isn't the same; two nulls are), greatest (absolute difference) and at (the
    key that has it, the first in order). Keys are those of rows; both tables have them once."""
    side = lambda df, name: df.select(*keys, F.struct(*terms).alias(name))
    rows = side(left, "__l").join(side(right, "__r"), keys, "full_outer")
    both = F.col("__l").isNotNull() & F.col("__r").isNotNull()
    key = F.concat_ws("|", *(F.col(k).cast("string") for k in keys))
    aggregates = [F.count_if(both).alias("n_both"), F.count_if(F.col("__r").isNull()).alias("n_left"), F.count_if(F.col("__l").isNull()).alias("n_right")]
    for i, t in enumerate(terms):
        a, b = F.col(f"__l.{t}"), F.col(f"__r.{t}")
        away = F.when(both, F.abs(a - b))
        aggregates += [F.count_if(both & ~a.eqNullSafe(b)).alias(f"__n{i}"), F.max(away).alias(f"__d{i}"), F.min_by(key, F.when(away > 0, F.struct(-away, key))).alias(f"__k{i}")]
    one = rows.agg(*aggregates)
    each = F.array(*(F.struct(F.lit(t).alias("term"), F.col(f"__n{i}").alias("n_differ"), F.col(f"__d{i}").cast("double").alias("greatest"), F.col(f"__k{i}").alias("at")) for i, t in enumerate(terms)))
    return one.select("n_both", "n_left", "n_right", F.explode(each).alias("x")).select("x.term", "n_both", "n_left", "n_right", "x.n_differ", "x.greatest", "x.at")


def chained_digest(df: DataFrame, order: str, columns: list[str], size: int = CHAIN) -> DataFrame:
    """One row: n and digest, which changes with any value of ``columns`` and with the order of rows.
    ``order`` is a number, another one for each row. Rows are numbered by sums in buckets; the digests
    of ``size`` rows make one, and these are chained, a text of 64 letters for each ``size`` rows."""
    line = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns))
    rows = df.select(F.col(order).alias("__order"), F.sha2(line, 256).alias("__row"))
    placed = running_sums(bucketed(rows, "__order"), "__order", {"__at": F.lit(1)}, descending=False).drop(BUCKET)
    joined = lambda pairs: F.array_join(F.transform(F.array_sort(pairs), lambda x: x["d"]), "")
    group = F.floor((F.col("__at") - 1) / size)
    groups = placed.groupBy(group.alias("__group")).agg(F.count("*").alias("n"), F.sha2(joined(F.collect_list(F.struct(F.col("__at").alias("at"), F.col("__row").alias("d")))), 256).alias("d"))
    listed = F.array_sort(F.collect_list(F.struct("__group", "d")))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.aggregate(listed, F.lit(""), lambda h, x: F.sha2(F.concat(h, x["d"]), 256)).alias("digest"))
