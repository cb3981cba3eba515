"""NULL group keys, NaN values, large counts, hot keys, quoted empty text."""

import pytest
from pyspark.sql import functions as F

from pairnet.functions import names as N
from pairnet.operators import curves as C
from pairnet.operators import pairs as P
from pairnet.operators import profile as PR
from pairnet.operators import stats as S
from pairnet.operators.ranking import exact_quantiles, prefix_sums
from pairnet.sources.sinks import write_delimited


def test_prefix_sums_branches_keep_null_keys(spark):
    rows = [("a", 1, 5), ("a", 2, 7), (None, 1, 1), (None, 2, 2), ("b", 3, 9)]
    df = spark.createDataFrame(rows, "g string, o int, n long")
    plain = prefix_sums(df, "o", ["n"], ["g"], known_rows=5)
    blocks = prefix_sums(df, "o", ["n"], ["g"], num_blocks=3)
    key = lambda d: sorted(map(tuple, d.collect()), key=repr)
    assert key(plain) == key(blocks) and len(key(blocks)) == 5
    spark.conf.set("pairnet.singleTask.maxRows", "1")
    try:
        got = {r["g"]: r["quantile"] for r in exact_quantiles(df, "n", [0.5], ["g"]).collect()}
    finally:
        spark.conf.unset("pairnet.singleTask.maxRows")
    assert got == {"a": 6.0, "b": 9.0, None: 1.5}


def test_nan_is_no_extreme(spark):
    df = spark.createDataFrame([(0.2,), (0.4,), (float("nan"),), (None,)], "x double")
    assert tuple(S.score_range(df, "x").first()) == (0.2, 0.4)
    scaled = [r["x"] for r in S.scale(df, "x").collect()]
    assert scaled[:2] == [0.5, 1.0] and scaled[2] != scaled[2] and scaled[3] is None
    assert sum(r["count"] for r in PR.histogram(df, "x", 4).collect()) == 2
    described = {r["statistic"]: r["value"] for r in S.describe(df, "x").collect()}
    assert described["max"] == 0.4


def test_auc_of_large_counts(spark, monkeypatch):
    counts = spark.createDataFrame([(0.9, 3_000_000_000, 5_000_000_000, 3_000_000_000, 5_000_000_000),
                                    (0.1, 3_000_000_000, 5_000_000_000, 6_000_000_000, 10_000_000_000)],
                                   "threshold double, pos long, neg long, tp long, fp long") \
        .withColumns({"P": F.lit(6_000_000_000), "N": F.lit(10_000_000_000)})
    monkeypatch.setattr(C, "curve_counts", lambda df, score, **kw: counts)
    assert abs(C.roc_auc(None, "x").first()["roc_auc"] - 0.5) < 1e-9


def test_hot_pair_key_join_is_split(spark):
    n = 20_000
    pairs = spark.range(n).select(
        F.lit("r").alias(N.NAME), F.when(F.col("id") % 3 == 0, "a0").otherwise(F.concat(F.lit("a"), F.col("id") % 97)).alias(N.ID1),
        F.when(F.col("id") % 3 == 0, "b0").otherwise(F.concat(F.lit("b"), F.col("id") % 89)).alias(N.ID2),
        *[(F.col("id") / n).alias(c) for c in (N.BEST, N.MEAN, N.MEAN_CORRECTED, N.BEST_CORRECTED)])
    ids = pairs.select(F.explode(F.array(N.ID1, N.ID2)).alias(N.UNIPROT_ID)).distinct() \
        .withColumn(N.STRING_ID, F.concat(F.lit("9."), N.UNIPROT_ID))
    links = ids.select(F.col(N.STRING_ID).alias(N.PROTEIN1), F.lit("9.b0").alias(N.PROTEIN2), F.lit(500).cast("long").alias(N.COMBINED_SCORE))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
            # A partition is split along its map outputs, so keep several.
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        out = P.compare_scores(pairs, links, ids)
        assert out.count() == n
        rows = out.groupBy().agg(*[F.sum(c) for c in (N.BEST, N.MEAN, N.MEAN_CORRECTED, N.COMBINED_SCORE)])
        rows.collect()
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert "skew=true" in plan


@pytest.mark.parametrize("quote", [None, ""])
def test_empty_text_and_null(spark, tmp_path, quote):
    df = spark.createDataFrame([("a", ""), ("b", None), ("c", "x")], "k string, v string")
    write_delimited(df, str(tmp_path / "t"), quote=quote)
    got = {r["k"]: r["v"] for r in spark.read.option("header", True).option("nullValue", "~null~").schema(df.schema).csv(str(tmp_path / "t")).collect()}
    assert got["b"] is None and got["c"] == "x"
    assert got["a"] == ("" if quote is None else None)
