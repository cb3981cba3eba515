"""Weighted, direction-free edge lists for downstream network tools, and the
significance-filtered network tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairnet.functions import names as N
from pairnet.operators.stats import filter_cutoff, quartile_cascade, scale

EDGE_COLUMNS = (N.PROTEIN1, N.PROTEIN2, N.WEIGHT, N.DIRECTION)


def edge_list(df: DataFrame, weight: str = N.MEAN_CORRECTED, method: str = "max") -> DataFrame:
    """``protein1, protein2, weight, direction``: ids upper-cased, weight
    scaled (``x / max`` by default), direction ``U``. Not de-duplicated."""
    scaled = scale(df, weight, method=method)
    return scaled.select(
        F.upper(F.col(N.ID1)).alias(N.PROTEIN1),
        F.upper(F.col(N.ID2)).alias(N.PROTEIN2),
        F.col(weight).alias(N.WEIGHT),
        F.lit(N.UNDIRECTED).alias(N.DIRECTION),
    )


def weighted_edges(pairs: DataFrame, weight: str = N.MEAN_CORRECTED,
                   cutoff: float = N.EDGE_CUTOFF, method: str = "max") -> DataFrame:
    """Pairs at or above a fixed cut-off, as a scaled edge list."""
    return edge_list(filter_cutoff(pairs, weight, cutoff), weight, method)


def weighted_edges_cascade(pairs: DataFrame, weight: str = N.MEAN_CORRECTED,
                           q: float = N.CASCADE_QUANTILE, rounds: int = N.CASCADE_ROUNDS,
                           method: str = "max") -> DataFrame:
    """Pairs surviving the quartile cascade, as a scaled edge list."""
    kept, _ = quartile_cascade(pairs, weight, q, rounds)
    return edge_list(kept, weight, method)
