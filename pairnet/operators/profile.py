"""Data behind the figures: histograms, box statistics per group, linear
regression of two scores. The plots themselves are not drawn here; each
function returns the table a plotting tool would read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairnet.functions.expr import hist_bin
from pairnet.operators.joins import checked_broadcast, scalars
from pairnet.operators.ranking import exact_quantiles
from pairnet.session import checkpoint


def histogram(df: DataFrame, col: str, bins: int, materialize: bool = False) -> DataFrame:
    """Equal-width histogram over [min, max] of the values (neither NULL nor
    NaN), last
    bin closed: ``bin, bin_start, bin_end, count`` for every bin (empty ones
    too). The values are counted by a partial + final aggregate on the bin
    index; the bin list comes from ``range(bins)``. ``materialize`` writes the
    column first, so that an expensive input plan runs once, not twice."""
    spark = df.sparkSession
    vals = df.select(F.col(col).cast("double").alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    if materialize:
        vals = checkpoint(vals, "values")
    rng = scalars(vals.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi")))
    counts = vals.select(hist_bin("_x", rng["_lo"], rng["_hi"], bins).alias("bin")) \
        .groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    lo = F.when(rng["_lo"] == rng["_hi"], rng["_lo"] - 0.5).otherwise(rng["_lo"])
    hi = F.when(rng["_lo"] == rng["_hi"], rng["_hi"] + 0.5).otherwise(rng["_hi"])
    step = (hi - lo) / F.lit(bins)
    edges = spark.range(bins).select(F.col("id").alias("bin")).select(
        "bin",
        (F.col("bin").cast("double") * step + lo).alias("bin_start"),
        F.when(F.col("bin") == bins - 1, hi)
        .otherwise((F.col("bin") + 1).cast("double") * step + lo).alias("bin_end"),
    )
    return edges.join(counts, on="bin", how="left") \
        .select("bin", "bin_start", "bin_end", F.coalesce(F.col("count"), F.lit(0)).alias("count"))


def box_stats(df: DataFrame, group: str, value: str, whis: float = 1.5, materialize: bool = False) -> DataFrame:
    """Per group: ``n, q1, median, q3, iqr, whisker_low, whisker_high,
    n_outliers`` (quartiles linear-interpolated; whiskers are the furthest
    values within 1.5 IQR of the box). Rows without a group are left out. The
    fences, one row per group, are broadcast when their checked size allows:
    a group with a third of the rows then stays spread over its scan tasks.
    The rows are read four times; ``materialize`` writes the two columns first,
    for a ``df`` that is dear to compute."""
    df = df.select(group, value)
    if materialize:
        df = checkpoint(df, "box")
    fences = checked_broadcast(_fences(df, group, value, whis, materialize))
    j = df.select(group, value).where(F.col(value).isNotNull()).join(fences, on=group)
    inside = (F.col(value) >= F.col("_lo_fence")) & (F.col(value) <= F.col("_hi_fence"))
    return j.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.first("iqr").alias("iqr"),
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(1)).alias("n_outliers"),
    )


def box_outliers(df: DataFrame, group: str, value: str, whis: float = 1.5, materialize: bool = False) -> DataFrame:
    """Rows outside their group's fences (the points a box plot draws).
    ``materialize`` writes ``df`` first: it is read four times."""
    if materialize:
        df = checkpoint(df, "box")
    fences = _fences(df, group, value, whis, materialize)
    j = df.where(F.col(value).isNotNull()).join(checked_broadcast(fences.select(group, "_lo_fence", "_hi_fence")), on=group)
    return j.where((F.col(value) < F.col("_lo_fence")) | (F.col(value) > F.col("_hi_fence"))) \
        .drop("_lo_fence", "_hi_fence")


def _fences(df: DataFrame, group: str, value: str, whis: float, written: bool) -> DataFrame:
    qs = exact_quantiles(df, value, [0.25, 0.5, 0.75], keys=[group], out="_v", written=written)
    wide = qs.groupBy(group).agg(
        F.max(F.when(F.col("q") == 0.25, F.col("_v"))).alias("q1"),
        F.max(F.when(F.col("q") == 0.5, F.col("_v"))).alias("median"),
        F.max(F.when(F.col("q") == 0.75, F.col("_v"))).alias("q3"),
    )
    iqr = F.col("q3") - F.col("q1")
    return wide.select(group, "q1", "median", "q3", iqr.alias("iqr"),
                       (F.col("q1") - whis * iqr).alias("_lo_fence"),
                       (F.col("q3") + whis * iqr).alias("_hi_fence"))


def regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: least-squares fit of ``y`` on ``x``: ``n, slope, intercept,
    r2, corr`` (pairs with a NULL are skipped)."""
    return df.agg(
        F.regr_count(F.col(y), F.col(x)).alias("n"),
        F.regr_slope(F.col(y), F.col(x)).alias("slope"),
        F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
        F.regr_r2(F.col(y), F.col(x)).alias("r2"),
        F.corr(F.col(x), F.col(y)).alias("corr"),
    )
