"""Identifier mapping between the pair ids and the evidence ids.

Everything stays a DataFrame: the id map is a two-column table joined by
key, never a driver-side dictionary; "ids not in a list" is an anti join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairnet.functions import names as N
from pairnet.functions.expr import norm_id
from pairnet.operators.joins import scalars
from pairnet.operators.pairs import drop_nulls


def gene_name_long(pairs: DataFrame, source_gene: str = N.SOURCE_GENE,
                   target_gene: str = N.TARGET_GENE) -> DataFrame:
    """``uniprot_id, gene_name`` from both sides of every pair, in one scan."""
    sides = F.array(*[F.struct(F.col(i).alias(N.UNIPROT_ID), F.col(f"`{g}`").alias(N.GENE_NAME))
                      for i, g in ((N.ID1, source_gene), (N.ID2, target_gene))])
    return pairs.select(F.inline(sides))


def gene_name_map(pairs: DataFrame, source_gene: str = N.SOURCE_GENE,
                  target_gene: str = N.TARGET_GENE) -> DataFrame:
    """One gene name per id (the smallest), NULLs dropped."""
    return drop_nulls(gene_name_long(pairs, source_gene, target_gene)) \
        .groupBy(N.UNIPROT_ID).agg(F.min(N.GENE_NAME).alias(N.GENE_NAME))


def ids_needing_lookup(proteins: DataFrame, genes: DataFrame) -> DataFrame:
    """Ids without a gene name (anti join; a NULL on the right does not
    empty the result as ``NOT IN`` would)."""
    return proteins.join(genes, proteins[N.PROTEIN_ID] == genes[N.UNIPROT_ID], "left_anti")


def alias_source_filter(aliases: DataFrame, pattern: str = N.ALIAS_SOURCE_PATTERN) -> DataFrame:
    """Aliases whose source matches ``pattern`` (regex, case-sensitive)."""
    return aliases.where(F.col(N.SOURCE).rlike(pattern))


def _key(c: Column, side: str) -> Column:
    """A join key that is never NULL: a NULL becomes a per-side marker that
    cannot equal any key of the other side, so NULLs still match nothing.
    With a nullable key the optimizer would infer ``isnotnull(<key
    expression>)`` and push it below the distinct of the ids, evaluating the
    normalisation once per pair row instead of once per distinct id."""
    return F.coalesce(c, F.lit(f"\u0000null-{side}"))


def clean_aliases(aliases: DataFrame, normalize: bool = True) -> DataFrame:
    """``string_id, alias_key``: UniProt-sourced aliases with their join key
    (stripped + lower case; the notebook form only lower-cases)."""
    key = _key(norm_id(N.ALIAS) if normalize else F.lower(F.col(N.ALIAS)), "alias")
    # A NULL alias matches nothing: it goes here, before a shuffle would bring all of them together.
    known = alias_source_filter(aliases).where(F.col(N.ALIAS).isNotNull())
    return known.select(N.STRING_ID, key.alias("alias_key"))


def id_alias_join(proteins: DataFrame, aliases: DataFrame, normalize: bool = True) -> DataFrame:
    """``uniprot_id, string_id`` for every alias hit of every id. The script
    form normalises both keys; ``normalize=False`` (notebook form) compares
    the id as is with the lower-cased alias."""
    key = _key(norm_id(N.PROTEIN_ID) if normalize else F.col(N.PROTEIN_ID), "id")
    p = proteins.select(F.col(N.PROTEIN_ID).alias(N.UNIPROT_ID), key.alias("_key"))
    a = clean_aliases(aliases, normalize)
    return p.join(a, p["_key"] == a["alias_key"], "inner").select(N.UNIPROT_ID, N.STRING_ID)


def id_info_join(mapped: DataFrame, info: DataFrame) -> DataFrame:
    """Adds ``preferred_name``, ``annotation``; ids absent from info go."""
    return mapped.join(info.select(N.STRING_ID, N.PREFERRED_NAME, N.ANNOTATION), on=N.STRING_ID)


def id_map(proteins: DataFrame, aliases: DataFrame, info: DataFrame,
           normalize: bool = True) -> DataFrame:
    """``uniprot_id, string_id``, one row per id (the smallest string id
    among alias hits that exist in info)."""
    hits = id_alias_join(proteins, aliases, normalize)
    known = hits.join(info.select(N.STRING_ID), on=N.STRING_ID, how="left_semi")
    return known.groupBy(N.UNIPROT_ID).agg(F.min(N.STRING_ID).alias(N.STRING_ID))


def annotated_ids(proteins: DataFrame, aliases: DataFrame, info: DataFrame,
                  normalize: bool = False) -> DataFrame:
    """``uniprot_id, string_id, string_gene_name, annotation``, one row per
    id (smallest string id); notebook form by default."""
    hits = id_alias_join(proteins, aliases, normalize).distinct()
    full = id_info_join(hits, info)
    best = full.groupBy(N.UNIPROT_ID).agg(
        F.min_by(F.struct(N.STRING_ID, N.PREFERRED_NAME, N.ANNOTATION),
                 F.struct(N.STRING_ID, N.PREFERRED_NAME, N.ANNOTATION)).alias("_r"))
    return best.select(N.UNIPROT_ID, F.col("_r").getField(N.STRING_ID).alias(N.STRING_ID),
                       F.col("_r").getField(N.PREFERRED_NAME).alias("string_gene_name"),
                       F.col("_r").getField(N.ANNOTATION).alias(N.ANNOTATION))


def matched_missing(proteins: DataFrame, genes: DataFrame, aliases: DataFrame, info: DataFrame,
                    normalize: bool = True) -> DataFrame:
    """Ids without a gene name matched locally: distinct (id, string id)
    alias hits that exist in info, with the info columns."""
    need = ids_needing_lookup(proteins, genes)
    hits = id_alias_join(need, aliases, normalize).distinct()
    return id_info_join(hits, info).select(
        N.UNIPROT_ID, N.STRING_ID, F.col(N.PREFERRED_NAME).alias("string_gene_name"), N.ANNOTATION)


def mapping_coverage(mapped: DataFrame, total: DataFrame) -> DataFrame:
    """One row: ``mapped, total, percent`` (NULL percent for an empty total)."""
    m = mapped.agg(F.count(F.lit(1)).alias("mapped"))
    t = scalars(total.agg(F.count(F.lit(1)).alias("total")))["total"]
    return m.select("mapped", t.alias("total"), F.try_divide(F.col("mapped") * 100.0, t).alias("percent"))


def duplicate_ids(df: DataFrame, key: str = N.UNIPROT_ID) -> DataFrame:
    """Ids seen more than once: ``<key>, occurrences, surplus`` (hash
    aggregate instead of a quadratic scan)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("occurrences")) \
        .where(F.col("occurrences") > 1) \
        .withColumn("surplus", F.col("occurrences") - 1)

