"""Order-dependent aggregates without a single-partition step.

Running totals over a global order (curve points) and exact order statistics
(percentiles, box quartiles) are usually written with an unpartitioned
``Window``, which plans ``Exchange SinglePartition``: one task sorts all the
data. Here the order is cut into contiguous blocks by a range shuffle, each
block is summed (a small table: one row per block and group), the offsets
of the blocks are a running total over that small table, and every row adds
its block offset to a running total inside its block. The largest single
task is one block, whatever the data size.

When the exact row count of the table to rank has been checked to be at
most ``pairnet.singleTask.maxRows``, a plain window does the same work.

Exact quantiles are then found by rank: the distinct values with their
counts are ranked this way and the values at ranks ``floor(h)`` and
``ceil(h)`` (``h = (n-1)q``) are picked. Only the values inside a verified
``percentile_approx`` bracket, of the column or of a group, are ranked. No value set of
a whole group is ever held in one buffer (Spark's ``percentile`` keeps a
value->count map of the whole column in one task).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairnet.operators.joins import checked_broadcast
from pairnet.session import checkpoint

_BLK = "_blk"
DEFAULT_SINGLE_TASK_ROWS = 1_000_000


def _blocks(df: DataFrame, num_blocks: int | None) -> int:
    if num_blocks:
        return num_blocks
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def single_task_rows(df: DataFrame) -> int:
    """Rows a step may sort in one task once its row count has been checked
    (session conf ``pairnet.singleTask.maxRows``)."""
    try:
        v = df.sparkSession.conf.get("pairnet.singleTask.maxRows")
    except Exception:  # noqa: BLE001 - unset key
        v = None
    return int(v) if v else DEFAULT_SINGLE_TASK_ROWS


def prefix_sums(df: DataFrame, order_by: str, sums: Sequence[str], keys: Sequence[str] = (),
                descending: bool = False, prefix: str = "cum_",
                num_blocks: int | None = None, known_rows: int | None = None) -> DataFrame:
    """Add ``<prefix><c>`` = running total of ``c`` in the order of
    ``order_by`` (inclusive of the row itself) within each ``keys`` group.

    Rows must be unique on ``keys + [order_by]`` (aggregate first); then the
    running total is a plain sum of everything that sorts before the row.

    ``known_rows``: an exact row count of ``df``. When it is at most
    ``single_task_rows``, a plain window does the job (its largest task is
    bounded by that count); otherwise, or when the count is unknown, the
    block method below runs.
    """
    keys = list(keys)
    o = F.col(order_by).desc() if descending else F.col(order_by).asc()
    if known_rows is not None and known_rows <= single_task_rows(df):
        w = Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select(*[F.col(f"`{c}`") for c in df.columns],
                         *[F.sum(c).over(w).alias(f"{prefix}{c}") for c in sums])
    ranged = df.repartitionByRange(_blocks(df, num_blocks), *[F.col(k) for k in keys], o) \
        .withColumn(_BLK, F.spark_partition_id())
    # Materialise the block assignment once: the two branches below must see
    # the same blocks, also after a lost executor recomputes a partition.
    ranged = checkpoint(ranged)

    tot = ranged.groupBy(*keys, _BLK).agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    before = Window.partitionBy(*keys).orderBy(_BLK) \
        .rowsBetween(Window.unboundedPreceding, -1)
    # One row per (group, block): bounded by groups + blocks.
    off = tot.select(*keys, _BLK, *[
        F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums])
    inside = Window.partitionBy(*keys, _BLK).orderBy(o) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Null-safe on the keys: a NULL group is a group like any other.
    o2 = off.withColumnsRenamed({c: f"_j_{c}" for c in [*keys, _BLK]})
    cond = F.col(_BLK) == F.col(f"_j_{_BLK}")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_j_{k}"))
    # Without keys: at most num_blocks rows.
    joined = ranged.join(o2 if keys else F.broadcast(o2), cond, "inner")
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[(F.col(f"_o_{c}") + F.sum(c).over(inside)).alias(f"{prefix}{c}") for c in sums],
    )


def value_ranks(df: DataFrame, value: str, keys: Sequence[str] = (),
                num_blocks: int | None = None, max_rows: int | None = None) -> DataFrame:
    """Distinct non-NULL values per group with their 0-based rank span
    ``[_first, _last]`` in ascending order (ties share a span).

    ``max_rows``: a proven upper bound of the input rows (hence of the
    distinct values); without one, the (value, count) table is materialised
    and counted to choose between the window and the block method."""
    counts = df.where(F.col(value).isNotNull()) \
        .groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    if max_rows is None:
        counts = checkpoint(counts, "ranks")
        max_rows = counts.count()
    ranked = prefix_sums(counts, value, ["_n"], keys, num_blocks=num_blocks, known_rows=max_rows)
    return ranked.select(*keys, value, (F.col("cum__n") - F.col("_n")).alias("_first"),
                         (F.col("cum__n") - 1).alias("_last"))


#: A group's sketch errs by at most n / GROUP_ACCURACY ranks; its brackets reach GROUP_MARGIN times that far.
GROUP_ACCURACY, GROUP_MARGIN = 1_000, 1.05


def _beside(rows: DataFrame, groups: DataFrame, keys: Sequence[str], extra: Column | None = None) -> DataFrame:
    """Rows with their group's columns; a NULL key is a key like any other."""
    g = groups.withColumnsRenamed({k: f"_g_{i}" for i, k in enumerate(keys)})
    cond = F.lit(True) if extra is None else extra
    for i, k in enumerate(keys):
        cond = cond & rows[k].eqNullSafe(g[f"_g_{i}"])
    return rows.join(g, cond).drop(*[f"_g_{i}" for i in range(len(keys))])


def exact_quantiles(df: DataFrame, value: str, qs: Sequence[float], keys: Sequence[str] = (),
                    interpolation: str = "linear", out: str = "quantile",
                    num_blocks: int | None = None, materialize: bool = False, written: bool = False,
                    accuracy: int = GROUP_ACCURACY) -> DataFrame:
    """Exact quantiles of ``value`` per ``keys`` group (a NULL key is a group
    of its own), NULL values ignored.

    ``linear``: ``x[floor(h)] + (h - floor(h)) * (x[ceil(h)] - x[floor(h)])``
    with ``h = (n-1)q`` (the NumPy default). ``nearest``: ``x[round(h)]``,
    half away from zero. Returns ``keys, q, <out>``; groups with no value
    give no row.

    1. One sketch a group (merged map-side) brackets every quantile;
    2. one aggregate a group counts the values below and inside the brackets;
    3. only values inside brackets are shuffled, counted by value and ranked.

    The groups' brackets are broadcast when their checked size allows, so the
    rows themselves are not shuffled and a group with a third of them stays
    spread. A quantile whose bracket misses its ranks takes the whole group as
    its bracket, so results are exact in every case. ``df`` is read three
    times; ``materialize=True`` writes its key and value columns first. Of such
    a table, or a ``written`` one, the rows are counted: if they are at most
    ``single_task_rows``, whole groups are ranked without a sketch.
    """
    keys = list(keys)
    if not keys:
        return global_quantiles(df, value, qs, interpolation, out, materialize=materialize)
    if interpolation not in ("linear", "nearest"):
        raise ValueError(f"unknown interpolation {interpolation!r}")
    x = F.col("_x")
    v = df.select(*keys, F.col(value).alias("_x")).where(x.isNotNull())
    if materialize:
        v = checkpoint(v, "values")
    m = len(qs)
    inside = [(x >= F.col(f"_lo{i}")) & (x <= F.col(f"_hi{i}")) for i in range(m)]
    if (materialize or written) and v.count() <= single_task_rows(df):
        none = F.lit(None).cast(v.schema["_x"].dataType)
        plan = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cnt")).withColumns(
            {name: value for i in range(m) for name, value in (
                (f"_lo{i}", none), (f"_hi{i}", none), (f"_below{i}", F.lit(0)), (f"_in{i}", F.lit(0)))})
    else:
        margin = GROUP_MARGIN / accuracy
        probes = F.array(*[F.lit(p) for q in qs for p in (max(0.0, q - margin), min(1.0, q + margin))])
        sketch = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cnt"), F.percentile_approx("_x", probes, accuracy).alias("_b"))
        brackets = checked_broadcast(sketch.select(*keys, "_cnt", *[
            c for i in range(m) for c in (F.col("_b")[2 * i].alias(f"_lo{i}"), F.col("_b")[2 * i + 1].alias(f"_hi{i}"))]))
        counted = _beside(v, brackets, keys).groupBy(*keys).agg(*[
            c for i in range(m) for c in (F.count_if(x < F.col(f"_lo{i}")).alias(f"_below{i}"),
                                          F.count_if(inside[i]).alias(f"_in{i}"))])
        plan = _beside(counted, brackets, keys)
    for i, q in enumerate(qs):
        h = (F.col("_cnt") - 1).cast("double") * F.lit(float(q))
        nearest = F.round(h, 0)
        low, high, part = (F.floor(h), F.ceil(h), h - F.floor(h)) if interpolation == "linear" else \
            (nearest, nearest, F.lit(0.0))
        holds = (F.col(f"_below{i}") <= low) & (high < F.col(f"_below{i}") + F.col(f"_in{i}"))
        before = F.when(holds, F.col(f"_below{i}")).otherwise(0)
        plan = plan.withColumns({f"_holds{i}": holds, f"_klo{i}": (low - before).cast("long"),
                                 f"_khi{i}": (high - before).cast("long"), f"_frac{i}": part})
    # One row a group.
    plan = checked_broadcast(plan)
    rows = plan.agg(*[F.sum(F.when(F.col(f"_holds{i}"), F.col(f"_in{i}")).otherwise(F.col("_cnt"))).alias(f"r{i}")
                      for i in range(m)]).first()
    tags = [F.when(~F.col(f"_holds{i}") | inside[i], F.lit(i)) for i in range(m)]
    tagged = _beside(v, plan.select(*keys, *[f"_{c}{i}" for i in range(m) for c in ("lo", "hi", "holds")]), keys) \
        .select(*keys, "_x", F.explode(F.array_compact(F.array(*tags))).alias("_q"))
    ranks = value_ranks(tagged, "_x", [*keys, "_q"], num_blocks, max_rows=sum(r or 0 for r in rows))
    targets = plan.select(*keys, F.inline(F.array(*[F.struct(
        F.lit(i).alias("_i"), F.lit(float(q)).alias("q"), F.col(f"_klo{i}").alias("_klo"), F.col(f"_khi{i}").alias("_khi"),
        F.col(f"_frac{i}").alias("_frac")) for i, q in enumerate(qs)])))
    # One row for each group and quantile: broadcast when small; above the
    # limit a shuffle join with AQE's split.
    found = _beside(ranks, checked_broadcast(targets), keys, F.col("_q") == F.col("_i"))
    picked = found.groupBy(*keys, "q").agg(
        *[F.max(F.when((F.col("_first") <= F.col(k)) & (F.col(k) <= F.col("_last")), x)).alias(name)
          for k, name in (("_klo", "_vlo"), ("_khi", "_vhi"))], F.max("_frac").alias("_frac"))
    res = F.when(F.col("_frac") == 0, F.col("_vlo")) \
        .otherwise(F.col("_vlo") + F.col("_frac") * (F.col("_vhi") - F.col("_vlo")))
    return picked.select(*keys, "q", res.alias(out))


def _targets(n: int, q: float, interpolation: str) -> tuple[int, int, float]:
    h = (n - 1) * q
    if interpolation == "nearest":
        k = int(math.floor(h + 0.5))
        return k, k, 0.0
    return int(math.floor(h)), int(math.ceil(h)), h - math.floor(h)


def global_quantiles(df: DataFrame, value: str, qs: Sequence[float], interpolation: str = "linear",
                     out: str = "quantile", accuracy: int = 10_000, materialize: bool = False) -> DataFrame:
    """Exact quantiles of a whole column without ranking all of it.

    1. One aggregate pass: the count and, per quantile, an approximate
       bracket ``percentile_approx(q -+ 3/accuracy)`` (bounded sketch).
    2. One aggregate pass: per bracket, the exact number of values below it
       and inside it. If a bracket does not contain the target ranks (the
       sketch's guarantee failed), that quantile falls back to the whole
       column, so the result is exact in every case.
    3. Only the values inside the brackets (about 6/accuracy of the rows)
       are ranked by ``value_ranks`` and the target ranks are picked.

    The three passes read ``df`` directly (for a Parquet source: one pruned
    column); ``materialize=True`` first writes the non-NULL values as a
    one-column table, which pays off when ``df`` is an expensive plan (joins,
    aggregates). Only scalars (the count, the bracket bounds and counts) reach the
    driver. Returns ``q, <out>`` (no row for an empty column).
    """
    x = F.col(value)
    v = df.select(x.alias("_x")).where(F.col("_x").isNotNull())
    if materialize:
        v = checkpoint(v, "values")
    margin = 3.0 / accuracy
    probes = []
    for q in qs:
        probes += [max(0.0, q - margin), min(1.0, q + margin)]
    first = v.agg(F.count(F.lit(1)).alias("n"),
                  F.percentile_approx("_x", F.array(*[F.lit(p) for p in probes]), accuracy).alias("b")).first()
    n, bounds = int(first["n"]), first["b"]
    spark = df.sparkSession
    if n == 0:
        return spark.range(0).select(F.lit(0.0).alias("q"), F.lit(None).cast("double").alias(out))
    brackets = [(bounds[2 * i], bounds[2 * i + 1]) for i in range(len(qs))]
    checks = []
    for i, (lo, hi) in enumerate(brackets):
        checks += [F.sum(F.when(F.col("_x") < F.lit(lo), 1).otherwise(0)).alias(f"b{i}"),
                   F.sum(F.when((F.col("_x") >= F.lit(lo)) & (F.col("_x") <= F.lit(hi)), 1)
                         .otherwise(0)).alias(f"i{i}")]
    counted = v.agg(*checks).first()
    plan = []  # (index, q, bracket or None, rank offset, k_lo, k_hi, frac)
    for i, q in enumerate(qs):
        klo, khi, frac = _targets(n, q, interpolation)
        below, inside = int(counted[f"b{i}"]), int(counted[f"i{i}"])
        if below <= klo and khi <= below + inside - 1:
            plan.append((i, float(q), brackets[i], below, klo, khi, float(frac)))
        else:
            plan.append((i, float(q), None, 0, klo, khi, float(frac)))
    tags = [F.when(F.lit(True) if b is None else
                   (F.col("_x") >= F.lit(b[0])) & (F.col("_x") <= F.lit(b[1])), F.lit(i))
            for i, _, b, *_ in plan]
    tagged = v.select("_x", F.explode(F.array(*tags)).alias("_q")).where(F.col("_q").isNotNull())
    # Exact bound of the rows to rank: the verified bracket sizes (the whole
    # column for a quantile that fell back).
    bound = sum(int(counted[f"i{i}"]) if b is not None else n for i, _, b, *_ in plan)
    ranks = value_ranks(tagged, "_x", keys=["_q"], max_rows=bound)
    # One aggregate picks the target ranks of all quantiles (literals by quantile).
    def of(k: int):
        values = [p_[k] if k != 4 and k != 5 else p_[k] - p_[3] for p_ in plan]
        return F.element_at(F.array(*[F.lit(v_) for v_ in values]), F.col("_q") + 1)

    picked = [F.max(F.when((F.col("_first") <= of(k)) & (of(k) <= F.col("_last")), F.col("_x"))).alias(name)
              for k, name in ((4, "_vlo"), (5, "_vhi"))]
    one = ranks.groupBy("_q").agg(*picked)
    res = F.when(of(6) == 0, F.col("_vlo")).otherwise(F.col("_vlo") + of(6) * (F.col("_vhi") - F.col("_vlo")))
    return one.select(of(1).alias("q"), res.alias(out))


def exact_quantile(df: DataFrame, value: str, q: float, out: str = "quantile",
                   interpolation: str = "linear", materialize: bool = False) -> DataFrame:
    """One-row frame holding one exact quantile of a column."""
    return global_quantiles(df, value, [q], interpolation=interpolation, out=out,
                            materialize=materialize).select(out)


def exact_quantile_value(df: DataFrame, value: str, q: float, interpolation: str = "linear",
                         materialize: bool = False) -> float | None:
    """One exact quantile as a number (for use as a literal cut-off that a
    Parquet scan can apply to row-group statistics)."""
    row = exact_quantile(df, value, q, "_v", interpolation, materialize).first()
    return None if row is None else row["_v"]
