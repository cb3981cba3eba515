"""Hot keys: one pair with a third of all runs, one hub protein in a third of
all pairs, one link key with a third of all links. Results against pandas;
the hot groups go through partial aggregation / partial group limits."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairnet.functions import names as N
from pairnet.operators import pairs as P
from pairnet.operators import stats as S

ROWS = 3000


@pytest.fixture(scope="module")
def skewed(spark):
    i = F.col("id")
    hot = i % 3 == 0
    pairs = spark.range(ROWS).select(
        F.concat(F.lit("r"), i.cast("string")).alias(N.NAME),
        F.when(hot, F.lit("HUB")).otherwise(F.concat(F.lit("p"), (i % 97).cast("string"))).alias(N.ID1),
        F.when(hot, F.lit("HOTPARTNER")).otherwise(F.concat(F.lit("p"), (i % 89 + 100).cast("string"))).alias(N.ID2),
        ((i * 7919) % 1000 / 1000.0).alias(N.BEST),
        ((i * 104729) % 1000 / 1000.0).alias(N.MEAN),
    ).repartition(6)
    conf = spark.range(ROWS).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias(N.NAME),
                                    (F.col("id") % 10 / 10.0).alias(N.PTM),
                                    (F.col("id") % 7 / 7.0).alias(N.IPTM))
    return pairs, conf


def test_hot_pair_dedupe_and_hub_stats(spark, skewed):
    pairs, conf = skewed
    got = P.confident_pairs(pairs, conf).toPandas()
    pdf = pairs.toPandas().merge(conf.toPandas(), on=N.NAME)
    pdf = pdf[pdf[N.BEST] >= 0.6].sort_values([N.BEST, N.MEAN, N.NAME], ascending=[False, False, True])
    exp = pdf.drop_duplicates([N.ID1, N.ID2], keep="first")
    assert len(got) == len(exp)
    m = got.merge(exp, on=[N.ID1, N.ID2], suffixes=("", "_e"))
    assert (m[N.BEST] == m[N.BEST + "_e"]).all() and (m[N.MEAN] == m[N.MEAN + "_e"]).all()
    st = S.protein_stats(P.confident_pairs(pairs, conf)).toPandas().set_index(N.PROTEIN_ID)
    long = pd.concat([exp[[N.ID1, N.BEST]].rename(columns={N.ID1: "p"}),
                      exp[[N.ID2, N.BEST]].rename(columns={N.ID2: "p"})])
    e = long.groupby("p")[N.BEST].agg(["count", "mean"])
    assert st.loc["HUB", N.INTERACTION_COUNT] == e.loc["HUB", "count"]
    assert st.loc["HUB", N.PROTEIN_AVG] == pytest.approx(e.loc["HUB", "mean"])


def test_hot_link_key(spark):
    links = spark.range(ROWS).select(
        F.when(F.col("id") % 3 == 0, F.lit("9.A")).otherwise(F.concat(F.lit("9.X"), F.col("id").cast("string")))
        .alias(N.PROTEIN1),
        F.when(F.col("id") % 3 == 0, F.lit("9.B")).otherwise(F.lit("9.Y")).alias(N.PROTEIN2),
        (F.col("id") % 1000).alias(N.COMBINED_SCORE))
    ls = P.link_scores(links)
    hot = ls.where((F.col(N.PAIR_KEY1) == "9.a") & (F.col(N.PAIR_KEY2) == "9.b")).collect()
    assert len(hot) == 1 and hot[0][N.COMBINED_SCORE] == max(i % 1000 for i in range(0, ROWS, 3))
    plan = ls._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan


def test_hot_value_in_quantiles(spark):
    from pairnet.operators.ranking import global_quantiles
    import numpy as np

    df = spark.range(ROWS).select(F.when(F.col("id") % 3 == 0, F.lit(0.5))
                                  .otherwise(F.col("id") / ROWS).alias("v"))
    got = global_quantiles(df, "v", [0.25, 0.5, 0.75]).toPandas().set_index("q")["quantile"]
    vals = df.toPandas()["v"].to_numpy()
    for q in (0.25, 0.5, 0.75):
        assert got[q] == pytest.approx(np.percentile(vals, q * 100), abs=1e-12)
