"""End-to-end jobs over the source data layout: the pair and confidence
Parquet files in one folder, the evidence text files (plain or gzipped) under
their organism / data id / version names in another.

Each job is one Spark plan per output; nothing is collected, and outputs are
written by the executors as directories of part files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from pairnet.functions import names as N
from pairnet.operators import export as E
from pairnet.operators import ids as I
from pairnet.operators import pairs as P
from pairnet.operators import stats as S
from pairnet.session import checkpoint
from pairnet.sources import readers as R
from pairnet.sources import sinks as K


def load_data(spark: SparkSession, data_dir: str) -> tuple[DataFrame, DataFrame]:
    """(pairs with NULL ids dropped, confidences)."""
    return R.read_pairs(spark, data_dir), R.read_confidences(spark, data_dir)


@dataclass
class Analysis:
    bias: DataFrame            # per protein, with z-scores, highest mean first
    stats: DataFrame           # per protein: count, mean
    protein_count: DataFrame   # one row: proteins of the confident network
    confident: DataFrame       # one row per confident pair


def run_pipeline(spark: SparkSession, data_dir: str, threshold: float = N.CONFIDENT_IPTM,
                 undirected: bool = False) -> Analysis:
    """Confident pairs -> protein statistics -> bias table."""
    pairs, conf = load_data(spark, data_dir)
    # Written once: four results are built from the first, two from the second.
    confident = checkpoint(P.confident_pairs(pairs, conf, threshold, undirected), "confident")
    stats = checkpoint(S.protein_stats(confident), "stats")
    return Analysis(S.bias_table(stats), stats, P.network_protein_count(confident), confident)


def read_evidence_set(spark: SparkSession, evidence_dir: str, organism: int | str = N.DEFAULT_ORGANISM,
                      version: str = N.DEFAULT_VERSION, partitions: int | None = None,
                      strict: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, aliases, info) by their evidence file names."""
    links, aliases, info = (
        R.read_evidence(spark, evidence_dir, data_id, organism, version, partitions=partitions, strict=strict)
        for data_id in (N.LINKS_DATA_ID, N.ALIASES_DATA_ID, N.INFO_DATA_ID))
    return links, aliases, info


def load_and_map_data(spark: SparkSession, data_dir: str, evidence_dir: str | None = None,
                      organism: int | str = N.DEFAULT_ORGANISM, version: str = N.DEFAULT_VERSION,
                      normalize: bool = True, partitions: int | None = None, strict: bool = False) -> DataFrame:
    """The score comparison: every mapped pair with its evidence score
    (NULL when the evidence has no link for it). ``partitions`` spreads
    evidence files that one task must read."""
    pairs, _ = load_data(spark, data_dir)
    links, aliases, info = read_evidence_set(spark, evidence_dir or data_dir, organism, version, partitions, strict)
    idmap = I.id_map(P.distinct_proteins(pairs), aliases, info, normalize)
    return P.compare_scores(pairs, links, idmap, normalize)


def save_comparison(cmp: DataFrame, csv_path: str, parquet_path: str | None = None) -> DataFrame:
    """Write the comparison as CSV with a header (and as Parquet when asked);
    returns the written table read back (later jobs start from files)."""
    spark = cmp.sparkSession
    if parquet_path:
        K.write_parquet(cmp, parquet_path)
        K.write_csv(spark.read.parquet(parquet_path), csv_path)
        return spark.read.parquet(parquet_path)
    K.write_csv(cmp, csv_path)
    return spark.read.option("header", True).schema(cmp.schema).csv(csv_path)


def network_exports(cmp: DataFrame, out_dir: str, min_score: float = N.CONFIDENT_IPTM,
                    min_link_score: float | None = N.SIGNIFICANT_LINK_SCORE) -> dict[str, str]:
    """The significance-filtered tables for a network viewer, best and mean."""
    out = {}
    for variant, score in (("best", N.BEST), ("mean", N.MEAN)):
        path = f"{out_dir.rstrip('/')}/df_final_comparison_{variant}.csv"
        K.write_csv(P.network_table(cmp, score, min_score, min_link_score), path)
        out[variant] = path
    return out


def size_corrected_edges(spark: SparkSession, data_dir: str, out_path: str | None = None,
                         cutoff: float | None = N.EDGE_CUTOFF, cascade_rounds: int = N.CASCADE_ROUNDS,
                         method: str = "max") -> DataFrame:
    """Weighted undirected edge list of the size-corrected mean score: a fixed
    cut-off, or (``cutoff=None``) the quartile cascade. Written header-less
    when ``out_path`` is given."""
    pairs, _ = load_data(spark, data_dir)
    if cutoff is None:
        edges = E.weighted_edges_cascade(pairs, rounds=cascade_rounds, method=method)
    else:
        edges = E.weighted_edges(pairs, cutoff=cutoff, method=method)
    if out_path:
        K.write_edges(edges, out_path)
    return edges
