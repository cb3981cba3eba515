"""Statistics over pairs and proteins: per-protein counts and means, the
z-score bias table, ranges, exact percentiles, describe, the quartile
cascade, scaling and z-scores of a whole column.

Global scalars (mean, std, max) come from one-row aggregates that run once
and enter the main plan as literals; percentile cut-offs are single numbers
used as literal filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairnet.functions import names as N
from pairnet.functions.expr import safe_div
from pairnet.operators.cascade import nested_cutoffs
from pairnet.operators.joins import scalars
from pairnet.operators.pairs import unpivot_pairs
from pairnet.operators.ranking import exact_quantile, exact_quantile_value, exact_quantiles
from pairnet.session import checkpoint


def protein_stats(confident: DataFrame, value: str = N.BEST) -> DataFrame:
    """Per protein: ``confident_interaction_count``, ``protein_avg_iptm``
    (partial + final hash aggregate on ``protein_id``)."""
    return unpivot_pairs(confident, value).groupBy(N.PROTEIN_ID).agg(
        F.count(F.lit(1)).alias(N.INTERACTION_COUNT),
        F.avg(value).alias(N.PROTEIN_AVG),
    )


def protein_mean_std(stats: DataFrame) -> DataFrame:
    """One row: unweighted mean of the protein means and their sample std
    (NULL for a single protein)."""
    return stats.agg(F.avg(N.PROTEIN_AVG).alias("mean_of_protein_means"),
                     F.stddev_samp(N.PROTEIN_AVG).alias("std_of_protein_means"))


def bias_table(stats: DataFrame) -> DataFrame:
    """Each protein's distance from the mean of protein means, raw and in
    standard deviations, highest mean first (NULLs first; ties by protein id,
    which also lets the range shuffle of the sort split a hot mean value).

    The per-protein table is read twice (for the global mean and std, and
    row by row), so it is checkpointed once: one row per protein, written
    to the shared folder, instead of running the pair pipeline twice."""
    stats = checkpoint(stats)
    ms = scalars(protein_mean_std(stats))
    diff = F.col(N.PROTEIN_AVG) - ms["mean_of_protein_means"]
    return stats.select(
        N.PROTEIN_ID, N.INTERACTION_COUNT, N.PROTEIN_AVG,
        diff.alias(N.DIFF_FROM_AVG),
        safe_div(diff, ms["std_of_protein_means"]).alias(N.STD_UNITS),
    ).orderBy(F.col(N.PROTEIN_AVG).desc_nulls_first(), F.col(N.PROTEIN_ID).asc_nulls_first())


def score_range(df: DataFrame, col: str) -> DataFrame:
    """Smallest and largest value; NaN counts as no value."""
    return df.agg(F.min(number(col)).alias("min_value"), F.max(number(col)).alias("max_value"))


def number(col: str):
    """The column with NaN as NULL (Spark ranks NaN above every number)."""
    return F.when(~F.isnan(col), F.col(col))


def score_percentile(df: DataFrame, col: str, q: float = N.CASCADE_QUANTILE) -> DataFrame:
    """One row: exact linear-interpolated percentile (NULLs ignored)."""
    return exact_quantile(df, col, q, out="percentile")


DESCRIBE_STATS = ("count", "null_count", "mean", "std", "min", "25%", "50%", "75%", "max")


def describe(df: DataFrame, col: str) -> DataFrame:
    """``statistic, value`` rows: count, null count, mean, std, min, the
    quartiles by the nearest-rank rule, max."""
    basic = df.agg(
        F.count(col).cast("double").alias("count"),
        F.sum(F.when(F.col(col).isNull(), 1).otherwise(0)).cast("double").alias("null_count"),
        F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
        F.min(number(col)).cast("double").alias("min"), F.max(number(col)).cast("double").alias("max"),
    )
    qs = exact_quantiles(df, col, [0.25, 0.5, 0.75], interpolation="nearest", out="v")
    quart = scalars(qs.agg(*[F.max(F.when(F.col("q") == q, F.col("v"))).alias(name)
                             for q, name in ((0.25, "25%"), (0.5, "50%"), (0.75, "75%"))]))
    wide = basic.select(*[(F.col(f"`{s}`") if s in basic.columns else quart[s]).cast("double").alias(s)
                          for s in DESCRIBE_STATS])
    return wide.unpivot([], list(DESCRIBE_STATS), "statistic", "value")


def filter_cutoff(df: DataFrame, col: str = N.MEAN_CORRECTED, cutoff: float = N.EDGE_CUTOFF) -> DataFrame:
    return df.where(F.col(col) >= cutoff)


def filter_top_quantile(df: DataFrame, col: str = N.MEAN_CORRECTED,
                        q: float = N.CASCADE_QUANTILE) -> DataFrame:
    """Rows at or above the exact ``q`` percentile of the same column.

    The cut-off is one number, applied as a literal: a Parquet scan skips
    row groups whose maximum lies below it."""
    c = exact_quantile_value(df, col, q)
    if c is None:
        return df.where(F.lit(False))
    return df.where(F.col(col) >= F.lit(c))


def quartile_cascade(df: DataFrame, col: str = N.MEAN_CORRECTED, q: float = N.CASCADE_QUANTILE,
                     rounds: int = N.CASCADE_ROUNDS, materialize: bool = False) -> tuple[DataFrame, DataFrame]:
    """Repeat: cut-off = exact ``q`` percentile of what is left, keep rows
    ``>= cut-off``. Returns (survivors, one row per round: ``round, cutoff,
    kept``).

    Survivors are never copied: they are the input filtered by the last
    cut-off as a literal, which a Parquet scan applies to its row groups. All
    cut-offs and counts come from ``nested_cutoffs``: three passes over the
    column, however many rounds."""
    steps = nested_cutoffs(df, col, q, rounds, materialize=materialize)
    table = df.sparkSession.createDataFrame([(r, float(c), k) for r, c, k in steps], "round int, cutoff double, kept long")
    return (df.where(F.col(col) >= F.lit(steps[-1][1])) if steps else df), table


def scale(df: DataFrame, col: str, method: str = "max", out: str | None = None) -> DataFrame:
    """``x / max`` (default) or ``(x - min) / (max - min)``; a zero divisor
    gives NULL. NaN is left out of min and max and stays NaN."""
    out = out or col
    rng = scalars(score_range(df, col))
    if method == "max":
        v = safe_div(F.col(col), rng["max_value"])
    elif method == "minmax":
        v = safe_div(F.col(col) - rng["min_value"], rng["max_value"] - rng["min_value"])
    else:
        raise ValueError(f"unknown method {method!r}")
    return df.withColumn(out, v)


def zscore(df: DataFrame, col: str, ddof: int = 0, out: str = "z_score") -> DataFrame:
    """``(x - mean) / std`` over the whole column (population std by
    default), two passes of aggregation, no column held in memory."""
    std = F.stddev_pop(col) if ddof == 0 else F.stddev_samp(col)
    ms = scalars(df.agg(F.avg(col).alias("_mu"), std.alias("_sd")))
    return df.withColumn(out, safe_div(F.col(col) - ms["_mu"], ms["_sd"]))
