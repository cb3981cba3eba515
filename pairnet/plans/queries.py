"""Registered queries: one per operator of the inventory,
each a function ``(spark, sf_dir) -> DataFrame`` over the whole adapter
tables. Double columns are rounded to 6 places at the very end so that the
result compares with an engine that sums in another order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from pairnet.functions import names as N
from pairnet.functions.expr import norm_id, strip_prefix
from pairnet.operators import curves as C
from pairnet.operators import export as E
from pairnet.operators import ids as I
from pairnet.operators import pairs as P
from pairnet.operators import profile as PR
from pairnet.operators import stats as S
from pairnet.operators.reshape import exclude_regex, left_join_suffix
from pairnet.plans.inputs import ORGANISM, Inputs, stage_odd_links, stage_one_gz, stage_parquet_inputs, stage_text_inputs
from pairnet.session import stage_path
from pairnet.sources import readers as R
from pairnet.sources import sinks as K
from pairnet.sources.bucketed import write_bucketed

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def round_half_away(c, places: int):
    """``round(x * 10^p) / 10^p``: the same double arithmetic in any engine,
    so two engines that agree on ``x`` agree bit for bit on the result."""
    scale = float(10 ** places)
    return F.round(c * scale, 0) / scale


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[
        round_half_away(F.col(f"`{f.name}`"), places).alias(f.name)
        if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields])


def query(name: str):
    def deco(fn: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        _REGISTRY[name] = lambda spark, sf_dir: rounded(fn(Inputs(spark, sf_dir)))
        return fn
    return deco


def registry() -> dict[str, Query]:
    return dict(_REGISTRY)


# ---------------------------------------------------------------- shared parts

PAIR_COLS = (N.NAME, N.ID1, N.ID2, N.BEST, N.MEAN, N.BEST_CORRECTED, N.MEAN_CORRECTED)


def _confident(i: Inputs) -> DataFrame:
    return P.confident_pairs(i.pairs(), i.conf())


def _stats(i: Inputs) -> DataFrame:
    return S.protein_stats(_confident(i))


def _proteins(i: Inputs) -> DataFrame:
    return P.distinct_proteins(i.pairs())


def _idmap(i: Inputs) -> DataFrame:
    return I.id_map(_proteins(i), i.aliases(), i.info())


def _cmp(i: Inputs) -> DataFrame:
    return P.compare_scores(i.pairs(), i.links(), _idmap(i))


def _cascade(i: Inputs, rounds: int) -> DataFrame:
    """The score column of what ``rounds`` cut-offs leave."""
    return S.quartile_cascade(i.pairs(), rounds=rounds)[0].select(N.MEAN_CORRECTED)


def _bias(i: Inputs) -> DataFrame:
    return S.bias_table(_stats(i))


# ---------------------------------------------------------------- 2.1 scans

@query("read_pairs")
def q_read_pairs(i):
    return R.read_pairs(i.spark, stage_parquet_inputs(i)).select(*PAIR_COLS)


@query("read_confidences")
def q_read_confidences(i):
    return R.read_confidences(i.spark, stage_parquet_inputs(i))


@query("read_links")
def q_read_links(i):
    d = stage_text_inputs(i, only=[N.LINKS_DATA_ID])
    return R.read_links(i.spark, f"{d}/{R.evidence_file_name(N.LINKS_DATA_ID, ORGANISM)}")


@query("read_aliases")
def q_read_aliases(i):
    d = stage_text_inputs(i, only=[N.ALIASES_DATA_ID])
    return R.read_aliases(i.spark, f"{d}/{R.evidence_file_name(N.ALIASES_DATA_ID, ORGANISM)}")


@query("read_info")
def q_read_info(i):
    d = stage_text_inputs(i, only=[N.INFO_DATA_ID])
    return R.read_info(i.spark, f"{d}/{R.evidence_file_name(N.INFO_DATA_ID, ORGANISM)}")


@query("read_links_gz")
def q_read_links_gz(i):
    d = stage_text_inputs(i, gzip_links=True, only=[N.LINKS_DATA_ID])
    return R.read_links(i.spark, f"{d}/{R.evidence_file_name(N.LINKS_DATA_ID, ORGANISM)}.gz")


@query("read_links_strict")
def q_read_links_strict(i):
    """As ``read_links``, but a malformed row or score would fail the job."""
    d = stage_text_inputs(i, only=[N.LINKS_DATA_ID])
    return R.read_links(i.spark, f"{d}/{R.evidence_file_name(N.LINKS_DATA_ID, ORGANISM)}", strict=True)


@query("read_links_gz_file")
def q_read_links_gz_file(i):
    """One single ``.gz``, parsed once and read from its Parquet copy."""
    return R.read_links_landed(i.spark, stage_one_gz(i))


@query("links_rejected")
def q_links_rejected(i):
    """How many lines of a links file are rows, have a wrong number of fields,
    or a score that is no whole number."""
    return R.reject_counts(R.checked_links(i.spark, stage_odd_links(i)))


@query("links_kept")
def q_links_kept(i):
    return R.kept_links(R.checked_links(i.spark, stage_odd_links(i)))


@query("links_quarantine")
def q_links_quarantine(i):
    """The lines that aren't rows, with the reason."""
    return R.quarantine(R.checked_links(i.spark, stage_odd_links(i)))


@query("read_evidence")
def q_read_evidence(i):
    """Links by data id, gzipped copy picked up, organism prefix removed."""
    d = stage_text_inputs(i, gzip_links=True, only=[N.LINKS_DATA_ID])
    return R.read_evidence(i.spark, d, N.LINKS_DATA_ID, organism=ORGANISM,
                           clean=[N.PROTEIN1, N.PROTEIN2], partitions=8)


@query("strip_prefix")
def q_strip_prefix(i):
    d = stage_text_inputs(i, only=[N.ALIASES_DATA_ID])
    df = R.read_evidence(i.spark, d, N.ALIASES_DATA_ID, organism=ORGANISM)
    return df.select(strip_prefix(N.STRING_ID, ORGANISM).alias(N.STRING_ID), N.ALIAS, N.SOURCE)


@query("rename_string_id")
def q_rename_string_id(i):
    """Info staged with the ``#`` header variant, aliases with the plain one."""
    d = stage_text_inputs(i, alias_header="string_protein_id", info_header="#string_protein_id")
    info = R.read_evidence(i.spark, d, N.INFO_DATA_ID, organism=ORGANISM)
    al = R.read_evidence(i.spark, d, N.ALIASES_DATA_ID, organism=ORGANISM)
    return info.select(N.STRING_ID, F.col(N.PREFERRED_NAME).alias("value"), F.lit("info").alias("file")) \
        .unionByName(al.select(N.STRING_ID, F.col(N.ALIAS).alias("value"), F.lit("aliases").alias("file")))


# ---------------------------------------------------------------- 2.2 sinks

def _read_back_csv(i: Inputs, path: str, like: DataFrame, header: bool = True,
                   sep: str = ",") -> DataFrame:
    r = i.spark.read.option("header", header).option("sep", sep) \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False) \
        .schema(like.schema).option("enforceSchema", not header).csv(path)
    return r


@query("sink_csv")
def q_sink_csv(i):
    cmp = _cmp(i)
    path = K.write_csv(cmp, stage_path(i.spark, "csv"))
    return _read_back_csv(i, path, cmp)


@query("sink_delimited")
def q_sink_delimited(i):
    net = P.network_table(_cmp(i))
    path = K.write_delimited(net, stage_path(i.spark, "tsv"), sep="\t")
    return _read_back_csv(i, path, net, sep="\t")


@query("sink_edges")
def q_sink_edges(i):
    edges = E.weighted_edges(i.pairs())
    path = K.write_edges(edges, stage_path(i.spark, "edges"))
    return _read_back_csv(i, path, edges, header=False)


@query("sink_parquet")
def q_sink_parquet(i):
    path = K.write_parquet(_cmp(i), stage_path(i.spark, "pq"))
    return i.spark.read.parquet(path)


@query("sink_verified")
def q_sink_verified(i):
    """Written with a manifest, read back because it is complete."""
    path = stage_path(i.spark, "verified")
    K.write_verified(_cmp(i), path)
    return i.spark.read.parquet(K.complete(i.spark, path))


@query("sink_manifest")
def q_sink_manifest(i):
    """Rows and NULLs by column of the comparison's CSV, as observed while it
    was written."""
    path = stage_path(i.spark, "manifest")
    K.write_verified(_cmp(i), path, K.write_csv)
    m = K.read_manifest(i.spark, path)
    return i.spark.createDataFrame([(c, m["rows"], n) for c, n in m["nulls"].items()], "column string, rows long, nulls long")


@query("sink_network")
def q_sink_network(i):
    cmp = _cmp(i)
    base = stage_path(i.spark, "network")
    out = None
    for variant, score in (("best", N.BEST), ("mean", N.MEAN)):
        t = P.network_table(cmp, score)
        path = K.write_csv(t, f"{base}/df_final_comparison_{variant}.csv")
        back = _read_back_csv(i, path, t).withColumn("variant", F.lit(variant))
        out = back if out is None else out.unionByName(back)
    return out


# ---------------------------------------------------------------- 2.3 projections

@query("project_pairs")
def q_project_pairs(i):
    return i.pairs().select(F.col(N.ID1).alias(N.PROTEIN1), F.col(N.ID2).alias(N.PROTEIN2),
                            N.BEST, N.MEAN, N.MEAN_CORRECTED, N.BEST_CORRECTED)


@query("replace_column")
def q_replace_column(i):
    """``mean_corrected`` replaced by ``mean_corrected / max`` over the cut-off rows."""
    return S.scale(S.filter_cutoff(i.pairs().select(*PAIR_COLS)), N.MEAN_CORRECTED)


@query("rename_columns")
def q_rename_columns(i):
    return i.aliases().withColumnsRenamed({N.ALIAS: "alias_protein_id", N.STRING_ID: "string_protein_id"})


@query("drop_columns")
def q_drop_columns(i):
    return i.pairs().drop(N.SOURCE_GENE, N.TARGET_GENE, N.NAME)


@query("exclude_regex")
def q_exclude_regex(i):
    return exclude_regex(_cmp(i), r"^chain_pair_iptm_.*_corrected$")


@query("weighted_edges")
def q_weighted_edges(i):
    return E.weighted_edges(i.pairs())


# ---------------------------------------------------------------- 2.4 filters

@query("filter_confident")
def q_filter_confident(i):
    return P.filter_confident(P.join_confidences(i.pairs(), i.conf())).select(
        *PAIR_COLS, N.PTM, N.IPTM)


@query("network_best")
def q_network_best(i):
    return P.network_table(_cmp(i), N.BEST)


@query("network_mean")
def q_network_mean(i):
    return P.network_table(_cmp(i), N.MEAN)


@query("network_best_only")
def q_network_best_only(i):
    return P.network_table(_cmp(i), N.BEST, min_link_score=None)


@query("network_mean_only")
def q_network_mean_only(i):
    return P.network_table(_cmp(i), N.MEAN, min_link_score=None)


@query("filter_nonneg")
def q_filter_nonneg(i):
    return S.filter_cutoff(i.pairs().select(*PAIR_COLS), N.MEAN_CORRECTED, 0.0)


@query("filter_cutoff")
def q_filter_cutoff(i):
    return S.filter_cutoff(i.pairs().select(*PAIR_COLS))


@query("filter_top_quartile")
def q_filter_top_quartile(i):
    return S.filter_top_quantile(i.pairs().select(*PAIR_COLS))


@query("drop_nulls_subset")
def q_drop_nulls_subset(i):
    return P.drop_nulls(i.pairs_raw().select(*PAIR_COLS), [N.ID1, N.ID2])


@query("drop_nulls_all")
def q_drop_nulls_all(i):
    return P.drop_nulls(i.pairs_raw().select(*PAIR_COLS))


@query("alias_source_filter")
def q_alias_source_filter(i):
    return I.alias_source_filter(i.aliases())


@query("ids_needing_lookup")
def q_ids_needing_lookup(i):
    return I.ids_needing_lookup(_proteins(i), I.gene_name_map(i.pairs()))


@query("score_present_mask")
def q_score_present_mask(i):
    return _cmp(i).select(N.PROTEIN1, N.PROTEIN2, N.STRING_ID1, N.STRING_ID2,
                          F.col(N.COMBINED_SCORE).isNotNull().alias("score_present"))


# ---------------------------------------------------------------- 2.5 joins

@query("join_confidences")
def q_join_confidences(i):
    return P.join_confidences(i.pairs(), i.conf()).select(*PAIR_COLS, N.PTM, N.IPTM)


@query("id_alias_join")
def q_id_alias_join(i):
    return I.id_alias_join(_proteins(i), i.aliases(), normalize=True)


@query("id_alias_join_exact")
def q_id_alias_join_exact(i):
    return I.id_alias_join(_proteins(i), i.aliases(), normalize=False)


@query("id_info_join")
def q_id_info_join(i):
    return I.id_info_join(_idmap(i), i.info())


@query("compare_scores")
def q_compare_scores(i):
    return _cmp(i)


@query("compare_scores_screened")
def q_compare_scores_screened(i):
    """The links screened by a Bloom filter of the pair keys, whatever their size."""
    return P.compare_scores(i.pairs(), i.links(), _idmap(i), screen=True)


@query("compare_scores_exact")
def q_compare_scores_exact(i):
    """The notebook form: ids matched and pair keys built without
    normalisation, the id map from the annotated ids."""
    ids = I.annotated_ids(_proteins(i), i.aliases(), i.info(), normalize=False)
    cmp = P.compare_scores(i.pairs(), P.distinct_links(i.links()), ids.select(N.UNIPROT_ID, N.STRING_ID), normalize=False)
    return cmp.select(N.PROTEIN1, N.PROTEIN2, N.BEST, N.MEAN, N.BEST_CORRECTED, N.MEAN_CORRECTED,
                      N.STRING_ID1, N.STRING_ID2, N.COMBINED_SCORE)


@query("left_join_suffix")
def q_left_join_suffix(i):
    """Annotated ids left-joined to the first local match of each missing id;
    the colliding right columns get ``_right`` and are dropped."""
    prot = _proteins(i)
    left = I.annotated_ids(prot, i.aliases(), i.info(), normalize=False)
    mm = I.matched_missing(prot, I.gene_name_map(i.pairs()), i.aliases(), i.info(), normalize=False)
    right = P.keep_first(mm, [N.UNIPROT_ID], [F.col(N.STRING_ID).asc()])
    return exclude_regex(left_join_suffix(left, right, [N.UNIPROT_ID]), r"^.*_right$")


@query("map_pair_ids")
def q_map_pair_ids(i):
    return P.map_pair_ids(P.comparison_pairs(i.pairs()), _idmap(i))


# ---------------------------------------------------------------- 2.6 aggregations

@query("row_counts")
def q_row_counts(i):
    parts = [("pairs", i.pairs()), ("pairs_raw", i.pairs_raw()), ("confidences", i.conf()),
             ("links", i.links()), ("aliases", i.aliases()), ("info", i.info())]
    out = None
    for name, df in parts:
        c = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = c if out is None else out.unionByName(c)
    return out


@query("scored_pair_count")
def q_scored_pair_count(i):
    return _cmp(i).agg(F.count(N.COMBINED_SCORE).alias("scored_pairs"),
                       F.count(F.lit(1)).alias("pairs"))


@query("protein_stats")
def q_protein_stats(i):
    return _stats(i)


@query("protein_mean_std")
def q_protein_mean_std(i):
    return S.protein_mean_std(_stats(i))


@query("score_range")
def q_score_range(i):
    return S.score_range(S.filter_cutoff(i.pairs()), N.MEAN_CORRECTED)


@query("score_percentile")
def q_score_percentile(i):
    return S.score_percentile(i.pairs(), N.MEAN_CORRECTED, 0.75)


@query("describe_score")
def q_describe_score(i):
    return S.describe(i.pairs(), N.MEAN_CORRECTED)


@query("describe_cascade1")
def q_describe_cascade1(i):
    return S.describe(_cascade(i, 1), N.MEAN_CORRECTED)


@query("describe_cascade2")
def q_describe_cascade2(i):
    return S.describe(_cascade(i, 2), N.MEAN_CORRECTED)


@query("describe_cascade3")
def q_describe_cascade3(i):
    return S.describe(_cascade(i, 3), N.MEAN_CORRECTED)


@query("describe_weights")
def q_describe_weights(i):
    """The last survivors' scores over their maximum."""
    return S.describe(S.scale(_cascade(i, 3), N.MEAN_CORRECTED), N.MEAN_CORRECTED)


@query("distinct_pairs")
def q_distinct_pairs(i):
    return P.comparison_pairs(i.pairs())


@query("distinct_links")
def q_distinct_links(i):
    return P.distinct_links(i.links())


@query("dedupe_runs")
def q_dedupe_runs(i):
    """One row per ordered pair of the whole pair table (run rule)."""
    return P.dedupe_runs(i.pairs().select(*PAIR_COLS))


@query("dedupe_first")
def q_dedupe_first(i):
    mm = I.matched_missing(_proteins(i), I.gene_name_map(i.pairs()), i.aliases(), i.info())
    return P.keep_first(mm, [N.UNIPROT_ID], [F.col(N.STRING_ID).asc()])


@query("distinct_proteins")
def q_distinct_proteins(i):
    return _proteins(i)


@query("network_protein_count")
def q_network_protein_count(i):
    return P.network_protein_count(_confident(i))


@query("mapping_coverage")
def q_mapping_coverage(i):
    return I.mapping_coverage(I.gene_name_map(i.pairs()), _proteins(i))


@query("duplicate_ids")
def q_duplicate_ids(i):
    """Ids with more than one evidence id among all alias hits."""
    return I.duplicate_ids(I.id_alias_join(_proteins(i), i.aliases()).distinct())


@query("interaction_counts")
def q_interaction_counts(i):
    return P.interaction_counts(i.pairs())


@query("histogram_iptm")
def q_histogram_iptm(i):
    """Best score, one row per ordered pair, 30 bins."""
    return PR.histogram(P.dedupe_runs(i.pairs().select(*PAIR_COLS)), N.BEST, 30, materialize=True)


@query("histogram_corrected")
def q_histogram_corrected(i):
    """Size-corrected mean score of the whole pair table, 100 000 bins."""
    return PR.histogram(i.pairs_raw(), N.MEAN_CORRECTED, 100_000)


@query("histogram_top_quartile")
def q_histogram_top_quartile(i):
    """First cascade round's survivors, 100 000 bins."""
    return PR.histogram(S.filter_top_quantile(i.pairs()), N.MEAN_CORRECTED, 100_000)


@query("histogram_cascade2")
def q_histogram_cascade2(i):
    """Second cascade round's survivors, 100 000 bins."""
    return PR.histogram(_cascade(i, 2), N.MEAN_CORRECTED, 100_000)


@query("histogram_cascade3")
def q_histogram_cascade3(i):
    """Third cascade round's survivors, 50 000 bins."""
    return PR.histogram(_cascade(i, 3), N.MEAN_CORRECTED, 50_000)


@query("histogram_weights")
def q_histogram_weights(i):
    """The last survivors' scores over their maximum, 50 000 bins."""
    return PR.histogram(S.scale(_cascade(i, 3), N.MEAN_CORRECTED), N.MEAN_CORRECTED, 50_000)


@query("histogram_links")
def q_histogram_links(i):
    return PR.histogram(i.links(), N.COMBINED_SCORE, 30)


@query("histogram_interactions")
def q_histogram_interactions(i):
    return PR.histogram(P.interaction_counts(i.pairs()), "interaction_count", 30, materialize=True)


def _bias_for_box(i: Inputs) -> DataFrame:
    """Bias table with the protein mean quantised to 1e-9, so that a mean
    on a whisker fence is on it whatever order the mean was summed in."""
    b = _bias(i)
    return b.withColumn(N.PROTEIN_AVG, round_half_away(F.col(N.PROTEIN_AVG), 9))


@query("box_stats")
def q_box_stats(i):
    return PR.box_stats(_bias_for_box(i), N.INTERACTION_COUNT, N.PROTEIN_AVG, materialize=True)


@query("box_outliers")
def q_box_outliers(i):
    return PR.box_outliers(_bias_for_box(i), N.INTERACTION_COUNT, N.PROTEIN_AVG, materialize=True)


@query("regression_best")
def q_regression_best(i):
    return PR.regression(P.network_table(_cmp(i), N.BEST), N.COMBINED_SCORE, N.BEST)


@query("regression_mean")
def q_regression_mean(i):
    return PR.regression(P.network_table(_cmp(i), N.MEAN), N.COMBINED_SCORE, N.MEAN)


# ---------------------------------------------------------------- 2.8 sorts / limits

@query("sorted_proteins")
def q_sorted_proteins(i):
    return _proteins(i).orderBy(F.col(N.PROTEIN_ID).asc_nulls_first())


@query("bias_table")
def q_bias_table(i):
    return _bias(i)


@query("bias_top_k")
def q_bias_top_k(i):
    """Top 5 proteins by mean score (to 1e-9; ties by id): a top-k report."""
    return _bias(i).orderBy(round_half_away(F.col(N.PROTEIN_AVG), 9).desc_nulls_first(),
                            F.col(N.PROTEIN_ID)).limit(5)


# ---------------------------------------------------------------- 2.9 set operations

@query("gene_name_long")
def q_gene_name_long(i):
    return I.gene_name_long(i.pairs())


@query("unpivot_pairs")
def q_unpivot_pairs(i):
    return P.unpivot_pairs(_confident(i))


# ---------------------------------------------------------------- 2.10 scalar functions

@query("normalize_ids")
def q_normalize_ids(i):
    return i.aliases().select(N.STRING_ID, N.ALIAS, norm_id(N.ALIAS).alias("alias_key"))


@query("pair_keys")
def q_pair_keys(i):
    return P.with_pair_keys(i.links(), N.PROTEIN1, N.PROTEIN2)


# ---------------------------------------------------------------- 2.11 composed jobs

@query("confident_pairs")
def q_confident_pairs(i):
    return _confident(i)


@query("confident_pairs_bucketed")
def q_confident_pairs_bucketed(i):
    """From tables in buckets of the run name: the join needs no shuffle."""
    return P.confident_pairs(write_bucketed(i.pairs().select(*PAIR_COLS), N.NAME, 16, "pairs"),
                             write_bucketed(i.conf(), N.NAME, 16, "confidences"))


@query("id_map")
def q_id_map(i):
    return _idmap(i)


@query("gene_name_map")
def q_gene_name_map(i):
    return I.gene_name_map(i.pairs())


@query("annotated_ids")
def q_annotated_ids(i):
    return I.annotated_ids(_proteins(i), i.aliases(), i.info(), normalize=False)


@query("matched_missing")
def q_matched_missing(i):
    return I.matched_missing(_proteins(i), I.gene_name_map(i.pairs()), i.aliases(), i.info())


@query("matched_missing_exact")
def q_matched_missing_exact(i):
    """The notebook form: the alias lower-cased, the id as it is."""
    return I.matched_missing(_proteins(i), I.gene_name_map(i.pairs()), i.aliases(), i.info(), normalize=False)


@query("quartile_cascade")
def q_quartile_cascade(i):
    return S.quartile_cascade(i.pairs())[1]


@query("weighted_edges_cascade")
def q_weighted_edges_cascade(i):
    return E.weighted_edges_cascade(i.pairs())


@query("minmax_scale")
def q_minmax_scale(i):
    return S.scale(S.filter_cutoff(i.pairs().select(*PAIR_COLS)), N.MEAN_CORRECTED,
                   method="minmax", out="normalized")


@query("zscore_pairs")
def q_zscore_pairs(i):
    return S.zscore(i.pairs().select(*PAIR_COLS), N.MEAN_CORRECTED)


@query("roc_curve")
def q_roc_curve(i):
    return C.roc_curve(_cmp(i), N.BEST)


@query("roc_auc")
def q_roc_auc(i):
    return C.roc_auc(_cmp(i), N.BEST)


@query("pr_curve")
def q_pr_curve(i):
    return C.pr_curve(_cmp(i), N.BEST)


@query("average_precision")
def q_average_precision(i):
    return C.average_precision(_cmp(i), N.BEST)


@query("roc_auc_mean")
def q_roc_auc_mean(i):
    return C.roc_auc(_cmp(i), N.MEAN)


@query("average_precision_mean")
def q_average_precision_mean(i):
    return C.average_precision(_cmp(i), N.MEAN)


@query("roc_auc_unscored_negative")
def q_roc_auc_unscored_negative(i):
    """Pairs without evidence count as negatives."""
    return C.roc_auc(_cmp(i), N.BEST, unscored="negative")


@query("average_precision_unscored_negative")
def q_average_precision_unscored_negative(i):
    return C.average_precision(_cmp(i), N.BEST, unscored="negative")


@query("confident_pairs_undirected")
def q_confident_pairs_undirected(i):
    """One row per unordered pair."""
    return P.confident_pairs(i.pairs(), i.conf(), undirected=True)
