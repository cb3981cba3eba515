"""Adapters that give the driver's test tables the shape of the pair,
confidence, link, alias and info tables (FIXTURES.md section B).

``lineitem`` plays the pair table: part and supplier keys share one id
domain, so self pairs, reversed pairs and repeated pairs all occur. The
adapters are column expressions over full table scans; nothing is sampled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairnet.functions import names as N


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _s(c: str):
    return F.col(c).cast("string")


def pairs_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair table before the NULL-id filter of the loader."""
    li = table(spark, sf_dir, "lineitem")
    best = F.col("l_quantity") / 50
    mean = best * (1 - F.col("l_discount"))
    return li.select(
        _s("l_orderkey").alias(N.NAME),
        F.when((F.col("l_linenumber") == 7) & (F.col("l_returnflag") == "R"), F.lit(None))
        .otherwise(F.concat(F.lit("q"), _s("l_partkey"))).alias(N.ID1),
        F.concat(F.lit("q"), _s("l_suppkey")).alias(N.ID2),
        best.alias(N.BEST),
        F.when((F.col("l_linenumber") == 6) & (F.col("l_returnflag") == "A"), F.lit(None))
        .otherwise(mean).alias(N.MEAN),
        (best - 0.5).alias(N.BEST_CORRECTED),
        (mean - 0.4).alias(N.MEAN_CORRECTED),
        F.when(F.col("l_partkey") % 4 == 0, F.lit(None))
        .otherwise(F.concat(F.lit("G"), _s("l_partkey"))).alias(N.SOURCE_GENE),
        F.when(F.col("l_suppkey") % 5 == 0, F.lit(None))
        .otherwise(F.concat(F.lit("G"), _s("l_suppkey"))).alias(N.TARGET_GENE),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loader's view: NULL ids dropped."""
    return pairs_raw(spark, sf_dir).where(F.col(N.ID1).isNotNull() & F.col(N.ID2).isNotNull())


def confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    # Runs without a pair: their names are shifted out of the pairs' domain.
    return o.select(
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("x"), _s("o_orderkey")))
        .otherwise(_s("o_orderkey")).alias(N.NAME),
        ((F.col("o_custkey") % 100).cast("double") / 100.0).alias(N.PTM),
        ((F.col("o_orderkey") % 1000).cast("double") / 1000.0).alias(N.IPTM),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    # Links without a pair: their first id is shifted out of the pairs' domain.
    first = F.when(F.col("l_returnflag") == "A", F.lit("9.Q")).otherwise(F.lit("9.X"))
    return li.select(
        F.concat(first, _s("l_suppkey")).alias(N.PROTEIN1),
        F.concat(F.lit("9.Q"), _s("l_partkey")).alias(N.PROTEIN2),
        (F.floor(F.col("l_extendedprice")).cast("bigint") % 1000).alias(N.COMBINED_SCORE),
    )


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded, two-cased, multi-source aliases; some aliases have two targets."""
    p = table(spark, sf_dir, "part")
    key = _s("p_partkey")
    first = p.select(
        F.concat(F.lit("9.Q"), key).alias(N.STRING_ID),
        F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" Q"), key, F.lit(" ")))
        .otherwise(F.concat(F.lit("Q"), key)).alias(N.ALIAS),
        F.when(F.col("p_partkey") % 5 == 0, F.lit("KEGG"))
        .when(F.col("p_partkey") % 5 == 1, F.lit("Ensembl_UniProt"))
        .otherwise(F.lit("UniProt_AC")).alias(N.SOURCE),
    )
    second = p.where(F.col("p_size") > 45).select(
        F.concat(F.lit("9.Q"), (F.col("p_partkey") + 1).cast("string")).alias(N.STRING_ID),
        F.concat(F.lit("q"), key).alias(N.ALIAS),
        F.lit("UniProt_DE").alias(N.SOURCE),
    )
    return first.unionByName(second)


def info(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.concat(F.lit("9.Q"), _s("p_partkey")).alias(N.STRING_ID),
        F.col("p_brand").alias(N.PREFERRED_NAME),
        F.col("p_name").alias(N.ANNOTATION),
    )
