"""Column-set operations: exclusion by pattern and a left join that marks
colliding right-side columns with a suffix (Spark keeps duplicate names and
raises on an ambiguous reference, so the suffix is added before the join)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exclude_regex(df: DataFrame, pattern: str) -> DataFrame:
    """All columns whose name does not match ``pattern`` (a full match)."""
    rx = re.compile(pattern)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not rx.fullmatch(c)])


def left_join_suffix(left: DataFrame, right: DataFrame, on: Sequence[str],
                     suffix: str = "_right") -> DataFrame:
    """Left join on ``on``; right columns whose name the left also has get ``suffix``."""
    clash = {c: f"{c}{suffix}" for c in right.columns if c in left.columns and c not in on}
    return left.join(right.withColumnsRenamed(clash), on=list(on), how="left")
