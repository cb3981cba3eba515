"""Plan checks: filters reach the Parquet scan, unused columns are pruned,
the dedupe limits groups before its shuffle, aggregates combine map-side,
the id map is broadcast only under its checked size. (The per-query checks
for Python UDFs and single-partition exchanges run in test_oracle.py.)"""

import pytest

from conftest import SF_SMALL
from pairnet.operators import pairs as P
from pairnet.plans.inputs import Inputs, stage_parquet_inputs
from pairnet.sources import readers as R


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df) -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_confident_filter_pushed_to_scan_and_columns_pruned(spark):
    i = Inputs(spark, SF_SMALL)
    d = stage_parquet_inputs(i)
    df = P.confident_pairs(R.read_pairs(spark, d), R.read_confidences(spark, d))
    s = formatted(df)
    assert "GreaterThanOrEqual(chain_pair_iptm_best,0.6)" in s
    assert "IsNotNull(af3_id1)" in s
    # the gene-name and corrected-score columns are never read
    schemas = [ln for ln in s.splitlines() if ln.startswith("ReadSchema") and "af3_id1" in ln]
    assert schemas and all("Gene" not in ln and "corrected" not in ln for ln in schemas)


def test_dedupe_limits_groups_before_shuffle(spark):
    i = Inputs(spark, SF_SMALL)
    df = P.confident_pairs(i.pairs(), i.conf())
    s = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in s and "Partial" in s


def test_protein_stats_partial_aggregation(spark):
    from pairnet.operators import stats as S
    i = Inputs(spark, SF_SMALL)
    s = plan_of(S.protein_stats(P.confident_pairs(i.pairs(), i.conf())))
    assert "partial_count" in s and "partial_avg" in s


def test_id_map_broadcast_after_size_check(spark):
    i = Inputs(spark, SF_SMALL)
    from pairnet.operators import ids as I
    idmap = I.id_map(P.distinct_proteins(i.pairs()), i.aliases(), i.info())
    df = P.map_pair_ids(P.comparison_pairs(i.pairs()), idmap)
    assert plan_of(df).count("BroadcastHashJoin") >= 2
    spark.conf.set("pairnet.broadcast.maxRows", "10")
    try:
        df2 = P.map_pair_ids(P.comparison_pairs(i.pairs()), idmap)
        # above the limit no hint is given; the size-based rule decides
        assert "broadcast" not in df2._jdf.queryExecution().analyzed().toString().lower()
    finally:
        spark.conf.unset("pairnet.broadcast.maxRows")
