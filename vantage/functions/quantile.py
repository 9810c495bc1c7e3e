"""Exact order statistics of many filtered columns at once, without sorting the data.

A mergeable sketch brackets each wanted rank; the values inside the bracket are then counted by value. Where a bracket
holds too many rows it is narrowed by another sketch over the bracket alone, so the work is a few scans and the driver
receives a bounded number of distinct values, whatever the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.functions.statistics import midpoint, ranks

#: A sketch's ranks are off by at most one in so many.
ACCURACY = 10_000
#: Rows of a bracket from which on it is narrowed again.
BRACKET_ROWS = 100_000


@dataclass
class Ask:
    """Quantile p of a column (any numeric) over the n rows where a predicate holds."""

    column: Column
    where: Column
    n: int
    p: float


def quantiles(df: DataFrame, asks: list[Ask]) -> list[float]:
    """The tie-aware quantile of every ask (each with n > 0)."""
    value = [F.when(a.where, a.column.cast("double")) for a in asks]
    wanted = [ranks(a.n, a.p) for a in asks]
    low = [float("-inf")] * len(asks)
    high = [float("inf")] * len(asks)
    below = [0] * len(asks)
    inside = [a.n for a in asks]
    while wide := [k for k in range(len(asks)) if inside[k] > BRACKET_ROWS and low[k] < high[k]]:
        row = df.agg(*(_bracket(value[k], low[k], high[k], wanted[k], below[k], inside[k]).alias(str(k)) for k in wide)).first()
        new = {}
        for k in wide:
            margin = 2 * inside[k] / ACCURACY + 2
            a = row[str(k)][0] if wanted[k][0] - below[k] > margin else low[k]
            b = row[str(k)][1] if wanted[k][1] - below[k] < inside[k] - margin else high[k]
            new[k] = (a, b)
        counts = df.agg(
            *(F.count_if(value[k] < F.lit(new[k][0])).alias(f"b{k}") for k in wide),
            *(F.count_if(value[k].between(F.lit(new[k][0]), F.lit(new[k][1]))).alias(f"i{k}") for k in wide),
        ).first()
        moved = False
        for k in wide:
            if counts[f"b{k}"] <= wanted[k][0] and wanted[k][1] < counts[f"b{k}"] + counts[f"i{k}"]:
                moved |= counts[f"i{k}"] < inside[k]
                low[k], high[k] = new[k]
                below[k], inside[k] = counts[f"b{k}"], counts[f"i{k}"]
        if not moved:  # ties, or a bracket as narrow as it gets: counting by value settles it
            break
    found = value_counts(df, [F.when(value[k].between(F.lit(low[k]), F.lit(high[k])), value[k]) for k in range(len(asks))])
    ends: list[tuple[float, float]] = []
    for k, (values, counts) in enumerate(found):
        at = np.searchsorted(below[k] + np.cumsum(counts), wanted[k], "right")
        ends.append((float(values[at[0]]), float(values[at[1]])))
    # equal ends move one of them to the next distinct value, which may lie outside the bracket
    tied = [k for k, (a, b) in enumerate(ends) if a == b]
    if tied:
        nearest = df.agg(*((F.max(F.when(value[k] < F.lit(ends[k][1]), value[k])) if asks[k].p > 0.5 else F.min(F.when(value[k] > F.lit(ends[k][0]), value[k]))).alias(str(k)) for k in tied)).first()
        for k in tied:
            if (v := nearest[str(k)]) is not None:
                ends[k] = (v, ends[k][1]) if asks[k].p > 0.5 else (ends[k][0], v)
    return [midpoint(a, b) for a, b in ends]


def value_counts(df: DataFrame, columns: list[Column], rows: Column | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each column its distinct values, ascending and without null, and how often each occurs; one scan, unpivoted by an array.

    rows: how many rows each one stands for. The driver receives every distinct value.
    """
    held = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), c.cast("double").alias("v")) for k, c in enumerate(columns))))
    each = df.select(held.alias("x"), (F.lit(1).cast("long") if rows is None else rows).alias("n")).where("x.v is not null")
    got = each.groupBy("x.k", "x.v").agg(F.sum("n").alias("n")).toArrow()
    of, values, counts = (got.column(n).to_numpy() for n in ("k", "v", "n"))
    order = np.lexsort((values, of))
    of, values, counts = of[order], values[order], counts[order]
    ends = np.searchsorted(of, np.arange(len(columns) + 1))
    return [(values[a:b], counts[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def _bracket(value: Column, low: float, high: float, wanted: tuple[int, int], below: int, inside: int) -> Column:
    held = F.when(value.between(F.lit(low), F.lit(high)), value)
    first = max(0.0, (wanted[0] - below) / inside - 2 / ACCURACY)
    last = min(1.0, (wanted[1] - below) / inside + 2 / ACCURACY)
    return F.percentile_approx(held, [first, last], ACCURACY)


def quantile_sql(relation: str, column: str, p: float, where: str = "true") -> str:
    """The same rule as one SQL scalar subquery, by cumulative counts; both Spark and DuckDB run it."""
    tie = "max(CASE WHEN v < b THEN v END)" if p > 0.5 else "min(CASE WHEN v > a THEN v END)"
    a = "coalesce(other, a)" if p > 0.5 else "a"
    b = "b" if p > 0.5 else "coalesce(other, b)"
    return f"""(SELECT CASE WHEN a = b THEN ({a} + {b}) / 2 ELSE (a + b) / 2 END FROM (
      SELECT min(a) AS a, min(b) AS b, {tie} AS other FROM (
        SELECT v, min(CASE WHEN upto > floor((n - 1) * CAST({p!r} AS DOUBLE)) THEN v END) OVER () AS a,
               min(CASE WHEN upto > ceil((n - 1) * CAST({p!r} AS DOUBLE)) THEN v END) OVER () AS b
        FROM (SELECT v, sum(c) OVER (ORDER BY v) AS upto, sum(c) OVER () AS n
              FROM (SELECT CAST({column} AS DOUBLE) AS v, count(*) AS c FROM {relation} WHERE {where} GROUP BY 1) AS g) AS h) AS i) AS j)"""
