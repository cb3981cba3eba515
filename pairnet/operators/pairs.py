"""Pair-level operators: confident pairs, dedupe of repeated runs, unpivot,
distinct entities, direction-free keys, the score comparison.

Every ``unique(subset)`` of the source analysis keeps an arbitrary row; here
each one keeps a row by a stated rule (SURVEY 2.13), so results are stable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairnet.functions import names as N
from pairnet.functions.expr import all_not_null, norm_id, pair_key
from pairnet.operators.joins import hub_keys, materialised, split_lookup
from pairnet.operators.screens import screened
from pairnet.session import checkpoint

# Rule for repeated runs of one pair: best desc, mean desc (NULL last),
# then run name, ptm, iptm.
def run_order() -> list[Column]:
    return [
        F.col(N.BEST).desc_nulls_last(),
        F.col(N.MEAN).desc_nulls_last(),
        F.col(N.NAME).asc_nulls_last(),
        F.col(N.PTM).desc_nulls_last(),
        F.col(N.IPTM).desc_nulls_last(),
    ]


def pair_order() -> list[Column]:
    """The run rule for tables without confidences (no ptm / iptm)."""
    return run_order()[:3]


def keep_first(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first by ``order``.

    ``row_number() = 1`` is planned as a per-partition group limit before the
    shuffle and a final one after it, so a key holding a third of all rows
    sends one row per map partition through the shuffle, not all of them.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a NULL in ``subset`` (all columns if None). NaN is kept
    (``na.drop`` would drop it too)."""
    cols = list(subset) if subset is not None else df.columns
    return df.where(all_not_null([F.col(f"`{c}`") for c in cols]))


def join_confidences(pairs: DataFrame, conf: DataFrame) -> DataFrame:
    """Inner join on the run name; a repeated name fans out."""
    return pairs.join(conf, on=N.NAME, how="inner")


def filter_confident(df: DataFrame, threshold: float = N.CONFIDENT_IPTM,
                     score: str = N.BEST) -> DataFrame:
    """``score >= threshold``: NULL fails, NaN passes."""
    return df.where(F.col(score) >= threshold)


def dedupe_runs(df: DataFrame, undirected: bool = False) -> DataFrame:
    """One row per pair of ids by the run rule; ordered pairs by default,
    ``undirected=True`` merges (a,b) with (b,a)."""
    order = run_order() if N.PTM in df.columns else pair_order()
    if undirected:
        k1, k2 = pair_key(N.ID1, N.ID2, normalize=False)
        df = df.withColumns({"_k1": k1, "_k2": k2})
        return keep_first(df, ["_k1", "_k2"], order).drop("_k1", "_k2")
    return keep_first(df, [N.ID1, N.ID2], order)


def confident_pairs(pairs: DataFrame, conf: DataFrame, threshold: float = N.CONFIDENT_IPTM,
                    undirected: bool = False) -> DataFrame:
    """Pairs joined to their run confidences, kept at ``best >= threshold``,
    one row per pair: ``af3_id1, af3_id2, best, mean, ptm, iptm``."""
    j = filter_confident(join_confidences(pairs, conf), threshold)
    return dedupe_runs(j, undirected).select(N.ID1, N.ID2, N.BEST, N.MEAN, N.PTM, N.IPTM)


def unpivot_pairs(df: DataFrame, value: str = N.BEST) -> DataFrame:
    """Long form: one row per (pair, side): ``value, variable, protein_id``.
    A self pair gives two rows."""
    return df.unpivot([value], [N.ID1, N.ID2], "variable", N.PROTEIN_ID)


def protein_ids(df: DataFrame, id1: str = N.ID1, id2: str = N.ID2) -> DataFrame:
    """Both id columns as one ``protein_id`` column, in a single scan."""
    return df.select(F.explode(F.array(F.col(id1), F.col(id2))).alias(N.PROTEIN_ID))


def distinct_proteins(df: DataFrame, id1: str = N.ID1, id2: str = N.ID2) -> DataFrame:
    """Distinct non-NULL ids over both columns."""
    return protein_ids(df, id1, id2).where(F.col(N.PROTEIN_ID).isNotNull()).distinct()


def network_protein_count(df: DataFrame) -> DataFrame:
    """One row: number of distinct proteins in a pair table."""
    return distinct_proteins(df).agg(F.count(F.lit(1)).alias("protein_count"))


def interaction_counts(df: DataFrame) -> DataFrame:
    """Times each protein occurs in a pair (a self pair counts twice).
    Partial aggregation before the shuffle keeps hub proteins cheap."""
    return protein_ids(df).where(F.col(N.PROTEIN_ID).isNotNull()) \
        .groupBy(N.PROTEIN_ID).agg(F.count(F.lit(1)).alias("interaction_count"))


def with_pair_keys(df: DataFrame, a: str, b: str, normalize: bool = True) -> DataFrame:
    k1, k2 = pair_key(a, b, normalize)
    return df.withColumns({N.PAIR_KEY1: k1, N.PAIR_KEY2: k2})


def comparison_pairs(pairs: DataFrame) -> DataFrame:
    """Pair scores to compare: renamed, NULL-free, whole-row distinct."""
    return drop_nulls(pairs.select(
        F.col(N.ID1).alias(N.PROTEIN1), F.col(N.ID2).alias(N.PROTEIN2),
        N.BEST, N.MEAN, N.MEAN_CORRECTED, N.BEST_CORRECTED,
    )).distinct()


def map_pair_ids(df: DataFrame, idmap: DataFrame, a: str = N.PROTEIN1, b: str = N.PROTEIN2,
                 out_a: str = N.STRING_ID1, out_b: str = N.STRING_ID2,
                 keep_norm: bool | None = None) -> DataFrame:
    """Look both ids up in ``idmap(uniprot_id, string_id)``; a pair with an
    unmapped id is dropped. The map is broadcast only after its row count is
    checked. Above the limit both lookups are shuffle joins, but for the pairs
    of hub ids (found by a counted sketch over both columns): these meet the
    hubs' rows of the map, which are broadcast, so a hub in a third of the
    pairs sends none of them to one task.

    ``keep_norm=True/False`` also brings the normalised (or raw) evidence id
    of each side as ``_n1`` / ``_n2``, computed once per map row instead of
    once per pair row (used for the pair key)."""
    cols = [N.UNIPROT_ID, N.STRING_ID]
    if keep_norm is not None:
        m0 = idmap.select(*cols, norm_id(N.STRING_ID, keep_norm).alias("_n"))
    else:
        m0 = idmap.select(*cols)
    m, small = materialised(m0)
    if small:
        m = F.broadcast(m)
    extra_a = [F.col("_n").alias("_n1")] if keep_norm is not None else []
    extra_b = [F.col("_n").alias("_n2")] if keep_norm is not None else []
    left = m.select(F.col(N.UNIPROT_ID).alias("_ua"), F.col(N.STRING_ID).alias(out_a), *extra_a)
    right = m.select(F.col(N.UNIPROT_ID).alias("_ub"), F.col(N.STRING_ID).alias(out_b), *extra_b)
    if small:
        j = df.join(left, F.col(a) == F.col("_ua"), "inner").drop("_ua")
        return j.join(right, F.col(b) == F.col("_ub"), "inner").drop("_ub")
    df = checkpoint(df, "pairs")
    hubs = hub_keys(df, [a, b])
    j = split_lookup(df, left, a, "_ua", hubs).drop("_ua")
    return split_lookup(checkpoint(j, "half-mapped") if hubs else j, right, b, "_ub", hubs).drop("_ub")


def link_scores(links: DataFrame, normalize: bool = True) -> DataFrame:
    """One score per unordered link: ``pair_key1, pair_key2, combined_score``,
    the largest when the two directions disagree."""
    return max_scores(with_pair_keys(links, N.PROTEIN1, N.PROTEIN2, normalize))


def max_scores(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy(N.PAIR_KEY1, N.PAIR_KEY2) \
        .agg(F.max(N.COMBINED_SCORE).alias(N.COMBINED_SCORE))


def distinct_links(links: DataFrame) -> DataFrame:
    return links.select(N.PROTEIN1, N.PROTEIN2, N.COMBINED_SCORE).distinct()


COMPARISON_COLUMNS = (N.PROTEIN1, N.PROTEIN2, N.BEST, N.MEAN, N.MEAN_CORRECTED,
                      N.BEST_CORRECTED, N.STRING_ID1, N.STRING_ID2, N.COMBINED_SCORE)


#: Links that are screened before they are aggregated, by the plan's estimate
#: of their bytes (session conf ``pairnet.bloom.minBytes``); fewer are shuffled
#: faster than a filter is built.
SCREEN_BYTES = 64 << 20


def worth_screening(links: DataFrame) -> bool:
    least = int(links.sparkSession.conf.get("pairnet.bloom.minBytes", str(SCREEN_BYTES)))
    return int(str(links._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= least


def compare_scores(pairs: DataFrame, links: DataFrame, idmap: DataFrame,
                   normalize: bool = True, screen: bool | None = None) -> DataFrame:
    """Predicted pair scores next to the evidence score of the same unordered
    pair of mapped ids; pairs without evidence keep a NULL score.

    Plan: two lookups in the (checked) broadcast id map, the whole-row
    distinct, and a shuffle of both sides on the pair key for the left join.
    ``screen`` (default: where the links are many by their checked size): the
    mapped pairs are written, and a Bloom filter of their keys, sized from
    their count, drops links that match no pair before they are aggregated and
    shuffled; it loses none that matches, so the result is the same. The link
    scores are written in any case: over two plain shuffles AQE can split a
    hot pair key, over an aggregate it cannot.
    """
    mapped = map_pair_ids(comparison_pairs(pairs), idmap, keep_norm=normalize)
    keyed = mapped.select(*COMPARISON_COLUMNS[:-1], F.least("_n1", "_n2").alias(N.PAIR_KEY1),
                          F.greatest("_n1", "_n2").alias(N.PAIR_KEY2))
    if worth_screening(links) if screen is None else screen:
        keyed = checkpoint(keyed, "mapped-pairs")
        scores = matching_link_scores(links, keyed, normalize)
    else:
        scores = link_scores(links, normalize)
    scores = checkpoint(scores, "link-scores")
    return keyed.join(scores, on=[N.PAIR_KEY1, N.PAIR_KEY2], how="left").select(*COMPARISON_COLUMNS)


def matching_link_scores(links: DataFrame, keyed: DataFrame, normalize: bool = True) -> DataFrame:
    """``link_scores`` of the links whose pair key may occur in ``keyed`` (a
    written table): all that do, and a few that don't."""
    key = [F.col(N.PAIR_KEY1), F.col(N.PAIR_KEY2)]
    return max_scores(screened(with_pair_keys(links, N.PROTEIN1, N.PROTEIN2, normalize), key, keyed, key))


def network_table(cmp: DataFrame, score: str = N.BEST, min_score: float = N.CONFIDENT_IPTM,
                  min_link_score: float | None = N.SIGNIFICANT_LINK_SCORE) -> DataFrame:
    """Significant rows of the comparison: ``score >= min_score`` and, unless
    ``min_link_score`` is None, a present link score ``>= min_link_score``."""
    out = cmp
    if min_link_score is not None:
        out = out.where(F.col(N.COMBINED_SCORE).isNotNull()
                        & (F.col(N.COMBINED_SCORE) >= min_link_score))
    return out.where(F.col(score) >= min_score)
