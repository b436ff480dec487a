"""Exact quantiles of whole columns without sorting or gathering them.

A number of a known rank is looked for in an ever smaller interval: a sketch of the interval's numbers
(a pre-aggregated summary) proposes two bounds close around the rank, and exact counts below, at,
between and above them say where it lies. A pass leaves some ACCURACY-th of the rows, whatever their
distribution; a number that many rows share is found as soon as it is a bound. Once at most LIMIT
numbers are left, they alone are gathered and sorted. All columns and ranks go through the same passes.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut

#: Numbers that may be gathered for a rank, and accuracy of the sketches.
LIMIT, ACCURACY = 20_000, 2_000


@dataclass
class Search:
    """The number of ``rank`` (from 0) among the ``rows`` numbers of a column from ``low`` to ``high``."""

    column: str
    rank: int
    rows: int
    low: float
    high: float

    def inside(self) -> Column:
        return F.when(F.col(self.column).between(self.low, self.high), F.col(self.column))


def quantiles(df: DataFrame, asked: Mapping[str, tuple[str, float]]) -> dict[str, float | None]:
    """The linear quantile of each (column, fraction) by its name; nulls and NaN aren't counted, and
    without numbers it is None."""
    names = {c: f"c{i}" for i, c in enumerate(dict.fromkeys(c for c, _ in asked.values()))}
    number = lambda c: F.col(c).cast("double")
    rows = cut(df.select(*(F.when(~F.isnan(number(c)), number(c)).alias(n) for c, n in names.items())))
    whole = rows.agg(*(F.struct(F.count(n), F.min(n), F.max(n)).alias(n) for n in names.values())).first()
    found: dict[tuple[str, int], float] = {}
    todo: list[Search] = []
    ranks: dict[str, tuple[str, int, float] | None] = {}
    for name, (c, q) in asked.items():
        n, low, high = whole[names[c]]
        if not n:
            ranks[name] = None
            continue
        at = q * (n - 1)
        ranks[name] = (names[c], math.floor(at), at - math.floor(at))
        todo += [Search(names[c], r, n, low, high) for r in {math.floor(at), math.ceil(at)}]
    todo = list({(s.column, s.rank): s for s in todo}.values())
    origin = {id(s): (s.column, s.rank) for s in todo}  # a search's rank is counted from its own interval later
    while todo:
        for s in [s for s in todo if s.low == s.high]:
            found[origin[id(s)]] = s.low
        todo = [s for s in todo if s.low < s.high]
        small, large = [s for s in todo if s.rows <= LIMIT], [s for s in todo if s.rows > LIMIT]
        if small:
            boxes = list(dict.fromkeys((s.column, s.low, s.high) for s in small))
            lists = rows.agg(*(F.sort_array(F.collect_list(Search(c, 0, 0, a, b).inside())).alias(f"l{i}") for i, (c, a, b) in enumerate(boxes)))
            picked = lists.select(*(F.get(f"l{boxes.index((s.column, s.low, s.high))}", F.lit(s.rank)).alias(f"r{i}") for i, s in enumerate(small))).first()
            found |= {origin[id(s)]: picked[i] for i, s in enumerate(small)}
        if large:
            _narrow(rows, large)
        todo = large
    out: dict[str, float | None] = {}
    for name, asked_rank in ranks.items():
        if asked_rank is None:
            out[name] = None
            continue
        c, r, share = asked_rank
        low = found[c, r]
        out[name] = low + (found[c, r + 1] - low) * share if share else low
    return out


def _narrow(rows: DataFrame, searches: list[Search]) -> None:
    """Makes each search's interval smaller: a sketch, then exact counts."""
    near = lambda s: [min(1.0, max(0.0, (s.rank + 0.5) / s.rows + d / ACCURACY)) for d in (-2, 2)]
    bounds = rows.agg(*(F.percentile_approx(s.inside(), near(s), ACCURACY).alias(f"b{i}") for i, s in enumerate(searches))).first()
    parts = []
    for i, s in enumerate(searches):
        a, b = bounds[i]
        x = F.col(s.column)
        own = [x.between(s.low, a) & (x < a), x == a, (x > a) & (x < b), (x == b) & (F.lit(b) > a), (x > b) & (x <= s.high)]
        parts += [F.struct(F.count_if(p), F.min(F.when(p, x)), F.max(F.when(p, x))).alias(f"p{i}_{k}") for k, p in enumerate(own)]
    counts = rows.agg(*parts).first()
    for i, s in enumerate(searches):
        for k in range(5):
            n, low, high = counts[f"p{i}_{k}"]
            if s.rank < n:
                s.rows, s.low, s.high = n, low, high
                break
            s.rank -= n
        else:
            raise AssertionError("a rank beyond the numbers")
