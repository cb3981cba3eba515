"""Tables written in buckets of a key, so that later joins on it need no
shuffle. For tables that are joined on the same key again and again (pairs and
run confidences on the run name)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from pairnet.session import stage_path


def write_bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """``df`` as a table of the session's catalog with ``buckets`` buckets of
    ``key``, sorted by it, under the shared folder; read back.

    The rows are dealt to the buckets first, so that each is one file, written
    by one task. Two tables with the same number of buckets join on ``key``
    without an exchange. A key with a third of the rows makes its bucket that
    large: such a table is better joined unbucketed, where the join's shuffle
    can be split."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key) \
        .option("path", stage_path(spark, name)).mode("overwrite").saveAsTable(table)
    return spark.table(table)
