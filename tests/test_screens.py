"""The Bloom screen of links, the hub split of the id lookup, bucketed tables."""

import pytest
from pyspark.sql import functions as F

from pairnet.functions import names as N
from pairnet.operators import pairs as P
from pairnet.operators.joins import hub_keys
from pairnet.operators.screens import bloom_table, filter_blocks, screened
from pairnet.sources.bucketed import write_bucketed


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def numbered(spark, start, end, step=1):
    return spark.range(start, end, step).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"), F.col("id").alias("n"))


@pytest.mark.parametrize("keys", [1, 300, 20_000])
def test_no_key_is_lost(spark, keys):
    """20 000 keys take 10 blocks."""
    rows, own = numbered(spark, 0, 60_000), numbered(spark, 0, keys)
    got = screened(rows, [F.col("k")], own, [F.col("k")])
    assert got.columns == rows.columns
    kept = {r["n"] for r in got.collect()}
    assert set(range(keys)) <= kept
    assert len(kept) - keys < 0.01 * (60_000 - keys) + 5
    table = bloom_table(own, [F.col("k")], filter_blocks(keys))
    assert table.count() == filter_blocks(keys) == -(-keys * 16 // 32768)


def test_null_and_two_part_keys_and_an_empty_filter(spark):
    df = spark.createDataFrame([("a", None, 1), (None, "b", 2), ("a", "b", 3), ("x", "y", 4)], "k string, l string, _words int")
    key = [F.col("k"), F.col("l")]
    got = screened(df, key, df.where("_words < 4"), key)
    assert {1, 2, 3} <= {r["_words"] for r in got.collect()}
    assert screened(df, key, df.limit(0), key).count() == 0


def test_a_large_filter_is_not_built(spark):
    df = numbered(spark, 0, 100)
    assert screened(df, [F.col("k")], df, [F.col("k")], max_bytes=100) is df


def comparison(spark, n=6000, hub=False):
    a = F.when(F.col("id") % 3 == 0, "hub") if hub else F.when(F.lit(False), "")
    pairs = spark.range(n).select(
        F.lit("r").alias(N.NAME), a.otherwise(F.concat(F.lit("a"), F.col("id") % 97)).alias(N.ID1),
        F.concat(F.lit("b"), F.col("id") % 89).alias(N.ID2),
        *[(F.col("id") / n).alias(c) for c in (N.BEST, N.MEAN, N.MEAN_CORRECTED, N.BEST_CORRECTED)])
    ids = pairs.select(F.explode(F.array(N.ID1, N.ID2)).alias(N.UNIPROT_ID)).distinct() \
        .withColumn(N.STRING_ID, F.concat(F.lit("9."), N.UNIPROT_ID))
    return pairs, ids


def test_only_matching_links_are_aggregated(spark):
    pairs, ids = comparison(spark)
    # One link in ten joins a pair (either direction), the rest none.
    i = F.col("id")
    links = spark.range(50_000).select(
        F.concat(F.when(i % 10 == 0, F.lit("9.b")).otherwise(F.lit("9.z")), i % 89).alias(N.PROTEIN1),
        F.concat(F.lit("9.a"), i % 97).alias(N.PROTEIN2), (i % 1000).alias(N.COMBINED_SCORE))
    mapped = P.map_pair_ids(P.comparison_pairs(pairs), ids, keep_norm=True)
    keyed = mapped.withColumns({N.PAIR_KEY1: F.least("_n1", "_n2"), N.PAIR_KEY2: F.greatest("_n1", "_n2")})
    all_links = P.with_pair_keys(links, N.PROTEIN1, N.PROTEIN2)
    key = [N.PAIR_KEY1, N.PAIR_KEY2]
    matching = all_links.join(keyed.select(*key).distinct(), key, "left_semi").count()
    passed = screened(all_links, [F.col(k) for k in key], keyed, [F.col(k) for k in key]).count()
    assert matching <= passed <= matching + 0.01 * 50_000
    assert not P.worth_screening(links)
    spark.conf.set("pairnet.bloom.minBytes", "100")
    try:
        assert P.worth_screening(links)
        got = P.compare_scores(pairs, links, ids)
    finally:
        spark.conf.unset("pairnet.bloom.minBytes")
    assert "mapped-pairs" in str(got.inputFiles())
    plain = keyed.join(P.link_scores(links), key, "left").select(*P.COMPARISON_COLUMNS)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    assert got.where(F.col(N.COMBINED_SCORE).isNotNull()).count() > 0
    # What the aggregate shuffles comes from behind the filter's broadcast.
    scores = P.matching_link_scores(links, keyed)
    plan = plan_of(scores)
    assert plan.index("Exchange hashpartitioning") < plan.index("BroadcastHashJoin")


def test_hubs_of_a_large_map_are_not_shuffled(spark):
    pairs, ids = comparison(spark, hub=True)
    cmp = P.comparison_pairs(pairs)
    key = lambda d: sorted(map(tuple, d.collect()), key=repr)
    whole = key(P.map_pair_ids(cmp, ids, keep_norm=True))
    conf = {"pairnet.broadcast.maxRows": "10", "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        assert hub_keys(cmp, [N.PROTEIN1, N.PROTEIN2]) == ["hub"]
        split = P.map_pair_ids(cmp, ids, keep_norm=True)
        assert key(split) == whole and len(whole) == 6000
        plan = plan_of(split)
        # The hub's pairs meet a broadcast row of the map, the others are shuffled.
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan
        assert "NOT (protein2" in plan or "NOT protein2" in plan
        # Without hubs there is nothing to split.
        plain = P.map_pair_ids(P.comparison_pairs(comparison(spark)[0]), ids)
        assert "BroadcastHashJoin" not in plan_of(plain)
    finally:
        for k in ("pairnet.broadcast.maxRows", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.unset(k)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_bucketed_tables_join_without_a_shuffle(spark):
    i = F.col("id")
    pairs = spark.range(5000).select(
        (i % 700).cast("string").alias(N.NAME), (i % 50).cast("string").alias(N.ID1), (i % 41).cast("string").alias(N.ID2),
        (i % 100 / 100).alias(N.BEST), (i % 90 / 100).alias(N.MEAN))
    conf = spark.range(900).select(i.cast("string").alias(N.NAME), (i / 900).alias(N.PTM), (i / 900).alias(N.IPTM))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = [write_bucketed(t, N.NAME, 6, name) for t, name in ((pairs, "pairs"), (conf, "confidences"))]
        joined = P.join_confidences(*stored)
        assert "SortMergeJoin" in plan_of(joined) and "Exchange" not in plan_of(joined)
        assert "Exchange" in plan_of(P.join_confidences(pairs, conf))
        for got, want in ((joined, P.join_confidences(pairs, conf)), (P.confident_pairs(*stored), P.confident_pairs(pairs, conf))):
            assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
