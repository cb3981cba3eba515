"""ROC and precision-recall curves of a predicted score against a label
drawn from the evidence score.

Rows are first collapsed to one row per distinct score (positives and
negatives at that threshold). The running totals in descending score order
come from ``prefix_sums`` (range blocks, no single-partition window). The
areas need no ``lag``: the previous curve point is the running total minus
the row's own counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairnet.functions import names as N
from pairnet.operators.joins import scalars
from pairnet.operators.ranking import prefix_sums
from pairnet.session import checkpoint


def labelled(df: DataFrame, score: str, label_col: str = N.COMBINED_SCORE,
             label_threshold: float = N.SIGNIFICANT_LINK_SCORE, unscored: str = "drop") -> DataFrame:
    """``score, label``: label 1 when ``label_col >= label_threshold``.
    Rows without a label score are dropped (``unscored='negative'`` keeps
    them as negatives); rows without a predicted score are dropped."""
    out = df.where(F.col(score).isNotNull())
    if unscored == "drop":
        out = out.where(F.col(label_col).isNotNull())
    elif unscored != "negative":
        raise ValueError(f"unknown unscored rule {unscored!r}")
    lab = F.when(F.col(label_col) >= label_threshold, 1).otherwise(0)
    return out.select(F.col(score).alias("threshold"), lab.alias("label"))


def curve_counts(df: DataFrame, score: str, **kw) -> DataFrame:
    """One row per threshold, highest first in rank: ``threshold, pos, neg,
    tp, fp, P, N`` (``tp``/``fp`` = rows with score >= threshold)."""
    lab = labelled(df, score, **kw)
    per = lab.groupBy("threshold").agg(F.sum("label").cast("long").alias("pos"),
                                       F.sum(1 - F.col("label")).cast("long").alias("neg"))
    # One row per distinct score, read twice (running totals, grand totals).
    per = checkpoint(per)
    ranked = prefix_sums(per, "threshold", ["pos", "neg"], descending=True, known_rows=per.count())
    totals = scalars(per.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")))
    return ranked.withColumns({"P": totals["P"], "N": totals["N"]}) \
        .withColumnsRenamed({"cum_pos": "tp", "cum_neg": "fp"})


def roc_curve(df: DataFrame, score: str, **kw) -> DataFrame:
    c = curve_counts(df, score, **kw)
    return c.select("threshold", "tp", "fp",
                    F.try_divide(F.col("tp"), F.col("P")).alias("tpr"),
                    F.try_divide(F.col("fp"), F.col("N")).alias("fpr"))


def pr_curve(df: DataFrame, score: str, **kw) -> DataFrame:
    c = curve_counts(df, score, **kw)
    return c.select("threshold", "tp", "fp",
                    F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                    F.try_divide(F.col("tp"), F.col("P")).alias("recall"))


def roc_auc(df: DataFrame, score: str, **kw) -> DataFrame:
    """One row: area under the ROC curve by trapezoids from (0, 0)."""
    c = curve_counts(df, score, **kw)
    # In double: the products pass 2^63 from about 3e10 rows.
    term = F.col("neg").cast("double") * (2.0 * F.col("tp").cast("double") - F.col("pos").cast("double"))
    whole = 2.0 * F.max("P").cast("double") * F.max("N").cast("double")
    return c.groupBy().agg(F.try_divide(F.sum(term), whole).alias("roc_auc"))


def average_precision(df: DataFrame, score: str, **kw) -> DataFrame:
    """One row: sum over thresholds of (recall step) x precision."""
    c = curve_counts(df, score, **kw)
    term = F.col("pos") * F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    return c.groupBy().agg(F.try_divide(F.sum(term), F.max("P").cast("double"))
                           .alias("average_precision"))
