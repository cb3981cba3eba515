"""Nested cut-offs from one quantile sketch.

A cascade repeats "cut-off = exact ``q`` percentile of what is left, keep
values at or above it". What a round leaves is always the top of the column's
order, so every round's percentile is an order statistic of the whole column:
if ``m`` of ``n`` values are left, rank ``h`` of these is rank ``n - m + h`` of
all. Three passes over the input therefore serve all rounds:

1. the number of values and a grid of approximate quantiles (a bounded,
   mergeable sketch). The rounds are played through on the grid, which gives a
   bracket for each cut-off; ties are seen there as equal neighbours;
2. per bracket, the exact number of values below it and inside it;
3. the values inside the brackets, counted by value and ranked.

The cut-offs and what they keep are then read off the ranks. A round whose
ranks lie outside its bracket is found by the general exact quantile over what
its predecessor left, alone; the next rounds go on with their own brackets.
"""

from __future__ import annotations

import math
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairnet.operators.ranking import exact_quantile_value, value_ranks
from pairnet.session import checkpoint

#: Relative rank error of the sketch, and the points of the grid.
ACCURACY, GRID = 10_000, 2_000


def _brackets(grid: list, q: float, rounds: int, accuracy: int) -> list[tuple]:
    """The bracket of each round's cut-off, by playing the rounds on the grid."""
    steps, out, below = len(grid) - 1, [], 0.0
    for r in range(rounds):
        p = below + (1.0 - below) * q
        # What a round leaves is known to a grid step and the sketch's error; so is the next target.
        margin = (r + 1) * (1.0 / steps + 2.0 / accuracy)
        lo, hi = max(0, math.floor((p - margin) * steps)), min(steps, math.ceil((p + margin) * steps))
        out.append((grid[lo], grid[hi]))
        # The value at the target, and how many lie below it (the first grid point that has it).
        below = bisect_left(grid, grid[min(steps, round(p * steps))]) / steps
    return out


def _tagged(values: DataFrame, brackets: list[tuple]) -> DataFrame:
    x = F.col("_x")
    tags = [F.when((x >= F.lit(lo)) & (x <= F.lit(hi)), F.lit(i)) for i, (lo, hi) in enumerate(brackets)]
    return values.select("_x", F.explode(F.array_compact(F.array(*tags))).alias("_q"))


def nested_cutoffs(df: DataFrame, col: str, q: float, rounds: int, accuracy: int = ACCURACY, grid: int = GRID,
                   materialize: bool = False) -> list[tuple[int, float, int]]:
    """``(round, cut-off, kept)`` of each round, exact; fewer rounds if there
    is no value (NULLs are no values; NaN is the largest).

    Reads ``df`` three times, one pruned column of a Parquet source, and
    copies nothing but the values inside the brackets; ``materialize=True``
    writes the column first, for a ``df`` that is dear to compute. Only
    scalars and the grid reach the driver."""
    values = df.select(F.col(col).alias("_x")).where(F.col("_x").isNotNull())
    if materialize:
        values = checkpoint(values, "cascade")
    points = F.array(*[F.lit(k / grid) for k in range(grid + 1)])
    first = values.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_x", points, accuracy).alias("grid")).first()
    n = int(first["n"])
    if not n or rounds < 1:
        return []
    brackets = _brackets(first["grid"], q, rounds, accuracy)
    x = F.col("_x")
    counted = values.agg(*[c for i, (lo, hi) in enumerate(brackets) for c in (
        F.count_if(x < F.lit(lo)).alias(f"b{i}"),
        F.count_if((x >= F.lit(lo)) & (x <= F.lit(hi))).alias(f"i{i}"))]).first()
    inside = sum(int(counted[f"i{i}"]) for i in range(rounds))
    ranks = checkpoint(value_ranks(_tagged(values, brackets), "_x", ["_q"], max_rows=inside), "ranks")
    out, left = [], n
    for i in range(rounds):
        h = (left - 1) * q
        low, high, part = n - left + math.floor(h), n - left + math.ceil(h), h - math.floor(h)
        below = int(counted[f"b{i}"])
        if below <= low and high < below + int(counted[f"i{i}"]):
            cut, under = _read_off(ranks, i, low - below, high - below, part)
            left = n - below - under
        else:
            rest = df.where(F.col(col) >= F.lit(out[-1][1])) if out else df
            cut = exact_quantile_value(rest, col, q)
            left = values.where(x >= F.lit(cut)).count()
        out.append((i + 1, cut, left))
    return out


def _read_off(ranks: DataFrame, bracket: int, low: int, high: int, part: float) -> tuple[float, int]:
    """The value ``part`` of the way from one rank of a bracket to the next,
    and how many of the bracket's values lie below it."""
    def at(k: int):
        return F.max(F.when((F.col("_first") <= k) & (F.col("_last") >= k), F.struct("_x", "_first", "_last")))

    row = ranks.where(F.col("_q") == bracket).agg(at(low).alias("a"), at(high).alias("b")).first()
    a, b = row["a"], row["b"]
    cut = a["_x"] if part == 0 else a["_x"] + part * (b["_x"] - a["_x"])
    if cut <= a["_x"] or math.isnan(a["_x"]):
        return cut, a["_first"]
    return cut, b["_first"] if cut <= b["_x"] or math.isnan(cut) else b["_last"] + 1
