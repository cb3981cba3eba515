"""Oracle SQL (DuckDB dialect) for every registered query.

Each string starts from the raw test tables (``lineitem``, ``orders``,
``part``), rebuilds the adapter tables as common table expressions and
states the operator in plain SQL. Double columns are rounded to 6 places,
as the Spark side does, so that summation order does not matter.
"""

from __future__ import annotations


def NORM(x: str) -> str:
    """Stripped, lower-cased text (the Spark side strips any white space)."""
    return f"lower(regexp_replace(CAST({x} AS VARCHAR), '^\\s+|\\s+$', '', 'g'))"


def R6(x: str, places: int = 6) -> str:
    """Rounding by the same double arithmetic as the Spark side."""
    scale = f"{10 ** places}.0"
    return f"(round({x} * {scale}) / {scale})"


PAIR_COLS = ("name, af3_id1, af3_id2, chain_pair_iptm_best, chain_pair_iptm_mean, "
             "chain_pair_iptm_best_corrected, chain_pair_iptm_mean_corrected")
SCORES4 = ("chain_pair_iptm_best", "chain_pair_iptm_mean", "chain_pair_iptm_best_corrected",
           "chain_pair_iptm_mean_corrected")
CMP_DOUBLES = SCORES4
MC = "chain_pair_iptm_mean_corrected"

PRELUDE = f"""
WITH pairs_raw AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS name,
    CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN NULL ELSE 'q' || CAST(l_partkey AS VARCHAR) END AS af3_id1,
    'q' || CAST(l_suppkey AS VARCHAR) AS af3_id2,
    l_quantity / 50 AS chain_pair_iptm_best,
    CASE WHEN l_linenumber = 6 AND l_returnflag = 'A' THEN NULL ELSE (l_quantity / 50) * (1 - l_discount) END AS chain_pair_iptm_mean,
    l_quantity / 50 - 0.5 AS chain_pair_iptm_best_corrected,
    (l_quantity / 50) * (1 - l_discount) - 0.4 AS chain_pair_iptm_mean_corrected,
    CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE 'G' || CAST(l_partkey AS VARCHAR) END AS source_gene,
    CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE 'G' || CAST(l_suppkey AS VARCHAR) END AS target_gene
  FROM lineitem),
pairs AS (SELECT * FROM pairs_raw WHERE af3_id1 IS NOT NULL AND af3_id2 IS NOT NULL),
conf AS (
  SELECT CASE WHEN o_orderstatus = 'P' THEN 'x' ELSE '' END || CAST(o_orderkey AS VARCHAR) AS name,
    CAST(o_custkey % 100 AS DOUBLE) / 100.0 AS ptm, CAST(o_orderkey % 1000 AS DOUBLE) / 1000.0 AS iptm
  FROM orders),
links AS (
  SELECT CASE WHEN l_returnflag = 'A' THEN '9.Q' ELSE '9.X' END || CAST(l_suppkey AS VARCHAR) AS protein1, '9.Q' || CAST(l_partkey AS VARCHAR) AS protein2,
    CAST(floor(l_extendedprice) AS BIGINT) % 1000 AS combined_score
  FROM lineitem),
aliases AS (
  SELECT '9.Q' || CAST(p_partkey AS VARCHAR) AS string_id,
    CASE WHEN p_size % 2 = 0 THEN ' Q' || CAST(p_partkey AS VARCHAR) || ' ' ELSE 'Q' || CAST(p_partkey AS VARCHAR) END AS alias,
    CASE p_partkey % 5 WHEN 0 THEN 'KEGG' WHEN 1 THEN 'Ensembl_UniProt' ELSE 'UniProt_AC' END AS source
  FROM part
  UNION ALL
  SELECT '9.Q' || CAST(p_partkey + 1 AS VARCHAR), 'q' || CAST(p_partkey AS VARCHAR), 'UniProt_DE' FROM part WHERE p_size > 45),
info AS (SELECT '9.Q' || CAST(p_partkey AS VARCHAR) AS string_id, p_brand AS preferred_name, p_name AS annotation FROM part),
proteins AS (
  SELECT DISTINCT protein_id FROM (SELECT af3_id1 AS protein_id FROM pairs UNION ALL SELECT af3_id2 FROM pairs) u
  WHERE protein_id IS NOT NULL),
gene_long AS (SELECT af3_id1 AS uniprot_id, source_gene AS gene_name FROM pairs
              UNION ALL SELECT af3_id2, target_gene FROM pairs),
genes AS (SELECT uniprot_id, min(gene_name) AS gene_name FROM gene_long
          WHERE uniprot_id IS NOT NULL AND gene_name IS NOT NULL GROUP BY uniprot_id),
need AS (SELECT protein_id FROM proteins p WHERE NOT EXISTS (SELECT 1 FROM genes g WHERE g.uniprot_id = p.protein_id)),
aliases_uni AS (SELECT * FROM aliases WHERE regexp_matches(source, 'UniProt')),
hits AS (SELECT p.protein_id AS uniprot_id, a.string_id FROM proteins p JOIN aliases_uni a ON {NORM('p.protein_id')} = {NORM('a.alias')}),
hits_exact AS (SELECT p.protein_id AS uniprot_id, a.string_id FROM proteins p JOIN aliases_uni a ON p.protein_id = lower(a.alias)),
idmap AS (SELECT uniprot_id, min(string_id) AS string_id FROM hits
          WHERE string_id IN (SELECT string_id FROM info) GROUP BY uniprot_id),
annotated AS (
  SELECT uniprot_id, string_id, string_gene_name, annotation FROM (
    SELECT h.uniprot_id, h.string_id, i.preferred_name AS string_gene_name, i.annotation,
      row_number() OVER (PARTITION BY h.uniprot_id ORDER BY h.string_id, i.preferred_name, i.annotation) AS rn
    FROM (SELECT DISTINCT uniprot_id, string_id FROM hits_exact) h JOIN info i ON h.string_id = i.string_id) t
  WHERE rn = 1),
mm AS (
  SELECT h.uniprot_id, h.string_id, i.preferred_name AS string_gene_name, i.annotation
  FROM (SELECT DISTINCT p.protein_id AS uniprot_id, a.string_id FROM need p
        JOIN aliases_uni a ON {NORM('p.protein_id')} = {NORM('a.alias')}) h
  JOIN info i ON h.string_id = i.string_id),
pairs2 AS (
  SELECT DISTINCT af3_id1 AS protein1, af3_id2 AS protein2, chain_pair_iptm_best, chain_pair_iptm_mean,
    chain_pair_iptm_mean_corrected, chain_pair_iptm_best_corrected
  FROM pairs WHERE chain_pair_iptm_best IS NOT NULL AND chain_pair_iptm_mean IS NOT NULL
    AND chain_pair_iptm_mean_corrected IS NOT NULL AND chain_pair_iptm_best_corrected IS NOT NULL),
mapped AS (
  SELECT p.*, m1.string_id AS string_id1, m2.string_id AS string_id2
  FROM pairs2 p JOIN idmap m1 ON p.protein1 = m1.uniprot_id JOIN idmap m2 ON p.protein2 = m2.uniprot_id),
linkscores AS (
  SELECT least({NORM('protein1')}, {NORM('protein2')}) AS pair_key1,
    greatest({NORM('protein1')}, {NORM('protein2')}) AS pair_key2, max(combined_score) AS combined_score
  FROM links GROUP BY 1, 2),
cmp AS (
  SELECT m.protein1, m.protein2, m.chain_pair_iptm_best, m.chain_pair_iptm_mean, m.chain_pair_iptm_mean_corrected,
    m.chain_pair_iptm_best_corrected, m.string_id1, m.string_id2, l.combined_score
  FROM mapped m LEFT JOIN linkscores l
    ON least({NORM('m.string_id1')}, {NORM('m.string_id2')}) = l.pair_key1
   AND greatest({NORM('m.string_id1')}, {NORM('m.string_id2')}) = l.pair_key2),
jc AS (
  SELECT p.name, p.af3_id1, p.af3_id2, p.chain_pair_iptm_best, p.chain_pair_iptm_mean,
    p.chain_pair_iptm_best_corrected, p.chain_pair_iptm_mean_corrected, c.ptm, c.iptm
  FROM pairs p JOIN conf c ON p.name = c.name),
cp AS (
  SELECT af3_id1, af3_id2, chain_pair_iptm_best, chain_pair_iptm_mean, ptm, iptm FROM (
    SELECT *, row_number() OVER (PARTITION BY af3_id1, af3_id2 ORDER BY chain_pair_iptm_best DESC NULLS LAST,
      chain_pair_iptm_mean DESC NULLS LAST, name ASC NULLS LAST, ptm DESC NULLS LAST, iptm DESC NULLS LAST) AS rn
    FROM jc WHERE chain_pair_iptm_best >= 0.6) t
  WHERE rn = 1),
pstats AS (
  SELECT protein_id, count(*) AS confident_interaction_count, avg(chain_pair_iptm_best) AS protein_avg_iptm
  FROM (SELECT af3_id1 AS protein_id, chain_pair_iptm_best FROM cp
        UNION ALL SELECT af3_id2, chain_pair_iptm_best FROM cp) u
  GROUP BY protein_id),
pms AS (SELECT avg(protein_avg_iptm) AS mean_of_protein_means, stddev_samp(protein_avg_iptm) AS std_of_protein_means
        FROM pstats),
bias AS (
  SELECT s.protein_id, s.confident_interaction_count, s.protein_avg_iptm,
    s.protein_avg_iptm - m.mean_of_protein_means AS iptm_diff_from_avg,
    CASE WHEN m.std_of_protein_means = 0 THEN NULL
         ELSE (s.protein_avg_iptm - m.mean_of_protein_means) / m.std_of_protein_means END AS standard_deviation
  FROM pstats s CROSS JOIN pms m),
bias9 AS (SELECT * REPLACE ((round(protein_avg_iptm * 1000000000.0) / 1000000000.0) AS protein_avg_iptm) FROM bias),
cutoffs AS (
  SELECT c1, c2, (SELECT quantile_cont({MC}, 0.75) FROM pairs WHERE {MC} >= c2) AS c3 FROM (
    SELECT c1, (SELECT quantile_cont({MC}, 0.75) FROM pairs WHERE {MC} >= c1) AS c2 FROM (
      SELECT quantile_cont({MC}, 0.75) AS c1 FROM pairs) a) b),
cascade3 AS (SELECT p.* FROM pairs p, cutoffs c WHERE p.{MC} >= c.c1 AND p.{MC} >= c.c2 AND p.{MC} >= c.c3)
"""


def _network(score: str = "chain_pair_iptm_best", with_link: bool = True) -> str:
    link = "combined_score IS NOT NULL AND combined_score >= 400 AND " if with_link else ""
    return f"SELECT * FROM cmp WHERE {link}{score} >= 0.6"


def _edges(src: str) -> str:
    return (f"SELECT upper(af3_id1) AS protein1, upper(af3_id2) AS protein2, "
            f"CASE WHEN mx = 0 THEN NULL ELSE {MC} / mx END AS weight, 'U' AS direction "
            f"FROM (SELECT *, max({MC}) OVER () AS mx FROM ({src}) s) t")


def _hist(src: str, n: int) -> str:
    """Equal-width bins over [min, max], last bin closed, edge-corrected."""
    return f"""
SELECT e.bin, CAST(e.bin AS DOUBLE) * r.step + r.lo AS bin_start,
  CASE WHEN e.bin = {n - 1} THEN r.hi ELSE CAST(e.bin + 1 AS DOUBLE) * r.step + r.lo END AS bin_end,
  coalesce(c.cnt, 0) AS count
FROM (SELECT range AS bin FROM range({n})) e
CROSS JOIN (
  SELECT lo, hi, (hi - lo) / {n} AS step FROM (
    SELECT CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo, CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi
    FROM (SELECT min(x) AS mn, max(x) AS mx FROM (SELECT CAST(x AS DOUBLE) AS x FROM ({src}) s0 WHERE x IS NOT NULL) v) m) m2
) r
LEFT JOIN (
  SELECT bin, count(*) AS cnt FROM (
    SELECT CASE WHEN x >= (CASE WHEN b1 + 1 >= {n} THEN hi ELSE CAST(b1 + 1 AS DOUBLE) * step + lo END)
                     AND b1 < {n - 1} THEN b1 + 1 ELSE b1 END AS bin
    FROM (
      SELECT x, lo, hi, step,
        CASE WHEN x < (CASE WHEN b0 >= {n} THEN hi ELSE CAST(b0 AS DOUBLE) * step + lo END) AND b0 > 0
             THEN b0 - 1 ELSE b0 END AS b1
      FROM (
        SELECT x, lo, hi, step,
          least(greatest(CAST(floor((x - lo) / (hi - lo) * {n}) AS BIGINT), 0), {n - 1}) AS b0
        FROM (SELECT CAST(x AS DOUBLE) AS x FROM ({src}) s1 WHERE x IS NOT NULL) v2,
          (SELECT lo, hi, (hi - lo) / {n} AS step FROM (
             SELECT CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo, CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi
             FROM (SELECT min(x) AS mn, max(x) AS mx FROM (SELECT CAST(x AS DOUBLE) AS x FROM ({src}) s2 WHERE x IS NOT NULL) v3) m3) m4) r2
      ) g0
    ) g1
  ) g2 GROUP BY bin
) c ON e.bin = c.bin
"""


_DEDUPE_RUNS = f"""SELECT {PAIR_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY af3_id1, af3_id2 ORDER BY chain_pair_iptm_best DESC NULLS LAST,
    chain_pair_iptm_mean DESC NULLS LAST, name ASC NULLS LAST) AS rn FROM pairs) t WHERE rn = 1"""

_BOX_FENCES = """
SELECT g, q1, median, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
  SELECT confident_interaction_count AS g, quantile_cont(protein_avg_iptm, 0.25) AS q1,
    quantile_cont(protein_avg_iptm, 0.5) AS median, quantile_cont(protein_avg_iptm, 0.75) AS q3
  FROM bias9 WHERE protein_avg_iptm IS NOT NULL GROUP BY confident_interaction_count) f"""

_CURVE = """
  SELECT threshold, pos, neg,
    sum(pos) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
    sum(neg) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
    P, N
  FROM (
    SELECT threshold, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg FROM (
      SELECT chain_pair_iptm_best AS threshold, CASE WHEN combined_score >= 400 THEN 1 ELSE 0 END AS label
      FROM cmp WHERE chain_pair_iptm_best IS NOT NULL AND combined_score IS NOT NULL) l
    GROUP BY threshold) per,
  (SELECT CAST(sum(CASE WHEN combined_score >= 400 THEN 1 ELSE 0 END) AS BIGINT) AS P,
          CAST(sum(CASE WHEN combined_score >= 400 THEN 0 ELSE 1 END) AS BIGINT) AS N
   FROM cmp WHERE chain_pair_iptm_best IS NOT NULL AND combined_score IS NOT NULL) tot"""


def _describe(src: str) -> str:
    stats = [
        ("count", "CAST(count(x) AS DOUBLE)"),
        ("null_count", "CAST(sum(CASE WHEN x IS NULL THEN 1 ELSE 0 END) AS DOUBLE)"),
        ("mean", "avg(x)"), ("std", "stddev_samp(x)"),
        ("min", "CAST(min(x) AS DOUBLE)"),
        ("25%", "(SELECT max(CASE WHEN k = CAST(round((n - 1) * 0.25) AS BIGINT) THEN x END) FROM ranked)"),
        ("50%", "(SELECT max(CASE WHEN k = CAST(round((n - 1) * 0.5) AS BIGINT) THEN x END) FROM ranked)"),
        ("75%", "(SELECT max(CASE WHEN k = CAST(round((n - 1) * 0.75) AS BIGINT) THEN x END) FROM ranked)"),
        ("max", "CAST(max(x) AS DOUBLE)"),
    ]
    parts = " UNION ALL ".join(
        f"SELECT '{s}' AS statistic, {e} AS value FROM " + ("(SELECT 1) one" if e.startswith("(SELECT") else "v")
        for s, e in stats)
    return (f"SELECT statistic, value FROM (WITH v AS ({src}), "
            f"ranked AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS k, "
            f"(SELECT count(x) FROM v) AS n FROM v WHERE x IS NOT NULL) {parts}) d")


_ROUND2 = f"SELECT p.{MC} AS x FROM pairs p, cutoffs c WHERE p.{MC} >= c.c1 AND p.{MC} >= c.c2"
_WEIGHTS = f"SELECT CASE WHEN mx = 0 THEN NULL ELSE {MC} / mx END AS x FROM (SELECT {MC}, max({MC}) OVER () AS mx FROM cascade3) w"

# key -> (SQL body after the prelude, double columns to round)
_Q: dict[str, tuple[str, tuple[str, ...]]] = {
    # 2.1 scans
    "read_pairs": (f"SELECT {PAIR_COLS} FROM pairs", SCORES4),
    "read_confidences": ("SELECT name, ptm, iptm FROM conf", ("ptm", "iptm")),
    "read_links": ("SELECT protein1, protein2, combined_score FROM links", ()),
    "read_aliases": ("SELECT string_id, alias, source FROM aliases", ()),
    "read_info": ("SELECT string_id, preferred_name, annotation FROM info", ()),
    "read_links_gz": ("SELECT protein1, protein2, combined_score FROM links", ()),
    "read_links_strict": ("SELECT protein1, protein2, combined_score FROM links", ()),
    "read_links_gz_file": ("SELECT protein1, protein2, combined_score FROM links", ()),
    "links_rejected": ("SELECT CASE WHEN combined_score % 50 < 2 THEN 'fields' WHEN combined_score % 50 = 2 THEN 'value' "
                       "ELSE 'kept' END AS reason, count(*) AS lines FROM links GROUP BY 1", ()),
    "links_kept": ("SELECT protein1, protein2, combined_score FROM links WHERE combined_score % 50 > 2", ()),
    "links_quarantine": ("SELECT CASE WHEN combined_score % 50 < 2 THEN 'fields' ELSE 'value' END AS reject_reason, "
                         "protein1 || ' ' || protein2 || CASE combined_score % 50 WHEN 0 THEN '' "
                         "WHEN 1 THEN ' ' || combined_score || ' extra' ELSE ' x' || combined_score END AS raw_line "
                         "FROM links WHERE combined_score % 50 <= 2", ()),
    "read_evidence": ("SELECT regexp_replace(protein1, '^9\\.', '') AS protein1, "
                      "regexp_replace(protein2, '^9\\.', '') AS protein2, combined_score FROM links", ()),
    "strip_prefix": ("SELECT regexp_replace(string_id, '^9\\.', '') AS string_id, alias, source FROM aliases", ()),
    "rename_string_id": ("SELECT string_id, preferred_name AS value, 'info' AS file FROM info "
                         "UNION ALL SELECT string_id, alias AS value, 'aliases' AS file FROM aliases", ()),
    # 2.2 sinks
    "sink_csv": ("SELECT * FROM cmp", CMP_DOUBLES),
    "sink_delimited": (_network(), CMP_DOUBLES),
    "sink_edges": (_edges(f"SELECT * FROM pairs WHERE {MC} >= 0.061"), ("weight",)),
    "sink_parquet": ("SELECT * FROM cmp", CMP_DOUBLES),
    "sink_verified": ("SELECT * FROM cmp", CMP_DOUBLES),
    "sink_manifest": (" UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS \"rows\", count(*) - count({c}) AS nulls FROM cmp"
        for c in ("protein1", "protein2", *SCORES4, "string_id1", "string_id2", "combined_score")), ()),
    "sink_network": (f"SELECT *, 'best' AS variant FROM ({_network()}) b UNION ALL "
                     f"SELECT *, 'mean' AS variant FROM ({_network('chain_pair_iptm_mean')}) m", CMP_DOUBLES),
    # 2.3 projections
    "project_pairs": ("SELECT af3_id1 AS protein1, af3_id2 AS protein2, chain_pair_iptm_best, chain_pair_iptm_mean, "
                      "chain_pair_iptm_mean_corrected, chain_pair_iptm_best_corrected FROM pairs", SCORES4),
    "replace_column": ("SELECT name, af3_id1, af3_id2, chain_pair_iptm_best, chain_pair_iptm_mean, "
                       f"chain_pair_iptm_best_corrected, CASE WHEN mx = 0 THEN NULL ELSE {MC} / mx END AS {MC} "
                       f"FROM (SELECT *, max({MC}) OVER () AS mx FROM pairs WHERE {MC} >= 0.061) t", SCORES4),
    "rename_columns": ("SELECT string_id AS string_protein_id, alias AS alias_protein_id, source FROM aliases", ()),
    "drop_columns": ("SELECT af3_id1, af3_id2, chain_pair_iptm_best, chain_pair_iptm_mean, "
                     "chain_pair_iptm_best_corrected, chain_pair_iptm_mean_corrected FROM pairs", SCORES4),
    "exclude_regex": ("SELECT protein1, protein2, chain_pair_iptm_best, chain_pair_iptm_mean, string_id1, string_id2, "
                      "combined_score FROM cmp", ("chain_pair_iptm_best", "chain_pair_iptm_mean")),
    "weighted_edges": (_edges(f"SELECT * FROM pairs WHERE {MC} >= 0.061"), ("weight",)),
    # 2.4 filters
    "filter_confident": ("SELECT * FROM jc WHERE chain_pair_iptm_best >= 0.6", SCORES4 + ("ptm", "iptm")),
    "network_best": (_network(), CMP_DOUBLES),
    "network_mean": (_network("chain_pair_iptm_mean"), CMP_DOUBLES),
    "network_best_only": (_network(with_link=False), CMP_DOUBLES),
    "network_mean_only": (_network("chain_pair_iptm_mean", with_link=False), CMP_DOUBLES),
    "filter_nonneg": (f"SELECT {PAIR_COLS} FROM pairs WHERE {MC} >= 0", SCORES4),
    "filter_cutoff": (f"SELECT {PAIR_COLS} FROM pairs WHERE {MC} >= 0.061", SCORES4),
    "filter_top_quartile": (f"SELECT {PAIR_COLS} FROM pairs WHERE {MC} >= (SELECT c1 FROM cutoffs)", SCORES4),
    "drop_nulls_subset": (f"SELECT {PAIR_COLS} FROM pairs_raw WHERE af3_id1 IS NOT NULL AND af3_id2 IS NOT NULL",
                          SCORES4),
    "drop_nulls_all": (f"SELECT {PAIR_COLS} FROM pairs_raw WHERE name IS NOT NULL AND af3_id1 IS NOT NULL "
                       "AND af3_id2 IS NOT NULL AND chain_pair_iptm_best IS NOT NULL AND chain_pair_iptm_mean IS NOT NULL "
                       f"AND chain_pair_iptm_best_corrected IS NOT NULL AND {MC} IS NOT NULL", SCORES4),
    "alias_source_filter": ("SELECT string_id, alias, source FROM aliases_uni", ()),
    "ids_needing_lookup": ("SELECT protein_id FROM need", ()),
    "score_present_mask": ("SELECT protein1, protein2, string_id1, string_id2, "
                           "combined_score IS NOT NULL AS score_present FROM cmp", ()),
    # 2.5 joins
    "join_confidences": ("SELECT * FROM jc", SCORES4 + ("ptm", "iptm")),
    "id_alias_join": ("SELECT uniprot_id, string_id FROM hits", ()),
    "id_alias_join_exact": ("SELECT uniprot_id, string_id FROM hits_exact", ()),
    "id_info_join": ("SELECT m.string_id, m.uniprot_id, i.preferred_name, i.annotation "
                     "FROM idmap m JOIN info i ON m.string_id = i.string_id", ()),
    "compare_scores": ("SELECT * FROM cmp", CMP_DOUBLES),
    "compare_scores_screened": ("SELECT * FROM cmp", CMP_DOUBLES),
    "compare_scores_exact": ("""
SELECT m.*, l.combined_score FROM (
  SELECT p.*, a1.string_id AS string_id1, a2.string_id AS string_id2
  FROM pairs2 p JOIN annotated a1 ON p.protein1 = a1.uniprot_id JOIN annotated a2 ON p.protein2 = a2.uniprot_id) m
LEFT JOIN (SELECT least(protein1, protein2) AS k1, greatest(protein1, protein2) AS k2, max(combined_score) AS combined_score
           FROM links GROUP BY 1, 2) l
  ON least(m.string_id1, m.string_id2) = l.k1 AND greatest(m.string_id1, m.string_id2) = l.k2""", CMP_DOUBLES),
    "left_join_suffix": ("SELECT * FROM annotated", ()),
    "map_pair_ids": ("SELECT * FROM mapped", SCORES4),
    # 2.6 aggregations
    "row_counts": ("SELECT 'pairs' AS \"table\", count(*) AS \"rows\" FROM pairs "
                   "UNION ALL SELECT 'pairs_raw', count(*) FROM pairs_raw "
                   "UNION ALL SELECT 'confidences', count(*) FROM conf "
                   "UNION ALL SELECT 'links', count(*) FROM links "
                   "UNION ALL SELECT 'aliases', count(*) FROM aliases "
                   "UNION ALL SELECT 'info', count(*) FROM info", ()),
    "scored_pair_count": ("SELECT count(combined_score) AS scored_pairs, count(*) AS pairs FROM cmp", ()),
    "protein_stats": ("SELECT * FROM pstats", ("protein_avg_iptm",)),
    "protein_mean_std": ("SELECT * FROM pms", ("mean_of_protein_means", "std_of_protein_means")),
    "score_range": (f"SELECT min({MC}) AS min_value, max({MC}) AS max_value FROM pairs WHERE {MC} >= 0.061",
                    ("min_value", "max_value")),
    "score_percentile": (f"SELECT quantile_cont({MC}, 0.75) AS percentile FROM pairs", ("percentile",)),
    "describe_score": (_describe(f"SELECT {MC} AS x FROM pairs"), ("value",)),
    "describe_cascade1": (_describe(f"SELECT {MC} AS x FROM pairs WHERE {MC} >= (SELECT c1 FROM cutoffs)"), ("value",)),
    "describe_cascade2": (_describe(_ROUND2), ("value",)),
    "describe_cascade3": (_describe(f"SELECT {MC} AS x FROM cascade3"), ("value",)),
    "describe_weights": (_describe(_WEIGHTS), ("value",)),
    "distinct_pairs": ("SELECT * FROM pairs2", SCORES4),
    "distinct_links": ("SELECT DISTINCT protein1, protein2, combined_score FROM links", ()),
    "dedupe_runs": (_DEDUPE_RUNS, SCORES4),
    "dedupe_first": ("SELECT uniprot_id, string_id, string_gene_name, annotation FROM ("
                     "SELECT *, row_number() OVER (PARTITION BY uniprot_id ORDER BY string_id) AS rn FROM mm) t "
                     "WHERE rn = 1", ()),
    "distinct_proteins": ("SELECT protein_id FROM proteins", ()),
    "network_protein_count": ("SELECT count(DISTINCT protein_id) AS protein_count FROM "
                              "(SELECT af3_id1 AS protein_id FROM cp UNION ALL SELECT af3_id2 FROM cp) u", ()),
    "mapping_coverage": ("SELECT m.mapped, t.total, CASE WHEN t.total = 0 THEN NULL "
                         "ELSE CAST(m.mapped AS DOUBLE) * 100.0 / t.total END AS percent "
                         "FROM (SELECT count(*) AS mapped FROM genes) m, (SELECT count(*) AS total FROM proteins) t",
                         ("percent",)),
    "duplicate_ids": ("SELECT uniprot_id, count(*) AS occurrences, count(*) - 1 AS surplus FROM "
                      "(SELECT DISTINCT uniprot_id, string_id FROM hits) h GROUP BY uniprot_id HAVING count(*) > 1",
                      ()),
    "interaction_counts": ("SELECT protein_id, count(*) AS interaction_count FROM "
                           "(SELECT af3_id1 AS protein_id FROM pairs UNION ALL SELECT af3_id2 FROM pairs) u "
                           "WHERE protein_id IS NOT NULL GROUP BY protein_id", ()),
    "histogram_iptm": (_hist(f"SELECT chain_pair_iptm_best AS x FROM ({_DEDUPE_RUNS}) d", 30),
                       ("bin_start", "bin_end")),
    "histogram_corrected": (_hist(f"SELECT {MC} AS x FROM pairs_raw", 100_000), ("bin_start", "bin_end")),
    "histogram_top_quartile": (_hist(f"SELECT {MC} AS x FROM pairs WHERE {MC} >= (SELECT c1 FROM cutoffs)", 100_000),
                               ("bin_start", "bin_end")),
    "histogram_cascade2": (_hist(_ROUND2, 100_000), ("bin_start", "bin_end")),
    "histogram_cascade3": (_hist(f"SELECT {MC} AS x FROM cascade3", 50_000), ("bin_start", "bin_end")),
    "histogram_weights": (_hist(_WEIGHTS, 50_000), ("bin_start", "bin_end")),
    "histogram_links": (_hist("SELECT combined_score AS x FROM links", 30), ("bin_start", "bin_end")),
    "histogram_interactions": (_hist(
        "SELECT count(*) AS x FROM (SELECT af3_id1 AS protein_id FROM pairs UNION ALL SELECT af3_id2 FROM pairs) u "
        "WHERE protein_id IS NOT NULL GROUP BY protein_id", 30), ("bin_start", "bin_end")),
    "box_stats": (f"""
SELECT b.confident_interaction_count, count(*) AS n, any_value(f.q1) AS q1, any_value(f.median) AS median,
  any_value(f.q3) AS q3, any_value(f.iqr) AS iqr,
  min(CASE WHEN b.protein_avg_iptm >= f.lo AND b.protein_avg_iptm <= f.hi THEN b.protein_avg_iptm END) AS whisker_low,
  max(CASE WHEN b.protein_avg_iptm >= f.lo AND b.protein_avg_iptm <= f.hi THEN b.protein_avg_iptm END) AS whisker_high,
  CAST(sum(CASE WHEN b.protein_avg_iptm >= f.lo AND b.protein_avg_iptm <= f.hi THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers
FROM bias9 b JOIN ({_BOX_FENCES}) f ON b.confident_interaction_count = f.g
WHERE b.protein_avg_iptm IS NOT NULL
GROUP BY b.confident_interaction_count""", ("q1", "median", "q3", "iqr", "whisker_low", "whisker_high")),
    "box_outliers": (f"""
SELECT b.* FROM bias9 b JOIN ({_BOX_FENCES}) f ON b.confident_interaction_count = f.g
WHERE b.protein_avg_iptm < f.lo OR b.protein_avg_iptm > f.hi""",
                     ("protein_avg_iptm", "iptm_diff_from_avg", "standard_deviation")),
    "regression_best": ("SELECT CAST(regr_count(chain_pair_iptm_best, combined_score) AS BIGINT) AS n, "
                        "regr_slope(chain_pair_iptm_best, combined_score) AS slope, "
                        "regr_intercept(chain_pair_iptm_best, combined_score) AS intercept, "
                        "regr_r2(chain_pair_iptm_best, combined_score) AS r2, "
                        f"corr(combined_score, chain_pair_iptm_best) AS corr FROM ({_network()}) t",
                        ("slope", "intercept", "r2", "corr")),
    "regression_mean": ("SELECT CAST(regr_count(chain_pair_iptm_mean, combined_score) AS BIGINT) AS n, "
                        "regr_slope(chain_pair_iptm_mean, combined_score) AS slope, "
                        "regr_intercept(chain_pair_iptm_mean, combined_score) AS intercept, "
                        "regr_r2(chain_pair_iptm_mean, combined_score) AS r2, "
                        "corr(combined_score, chain_pair_iptm_mean) AS corr "
                        f"FROM ({_network('chain_pair_iptm_mean')}) t", ("slope", "intercept", "r2", "corr")),
    # 2.8 sorts / limits
    "sorted_proteins": ("SELECT protein_id FROM proteins ORDER BY protein_id NULLS FIRST", ()),
    "bias_table": ("SELECT * FROM bias ORDER BY protein_avg_iptm DESC NULLS FIRST",
                   ("protein_avg_iptm", "iptm_diff_from_avg", "standard_deviation")),
    "bias_top_k": ("SELECT * FROM bias ORDER BY round(protein_avg_iptm * 1000000000.0) DESC NULLS FIRST, protein_id LIMIT 5",
                   ("protein_avg_iptm", "iptm_diff_from_avg", "standard_deviation")),
    # 2.9 set operations
    "gene_name_long": ("SELECT * FROM gene_long", ()),
    "unpivot_pairs": ("SELECT chain_pair_iptm_best, 'af3_id1' AS variable, af3_id1 AS protein_id FROM cp "
                      "UNION ALL SELECT chain_pair_iptm_best, 'af3_id2', af3_id2 FROM cp", ("chain_pair_iptm_best",)),
    # 2.10 scalar functions
    "normalize_ids": (f"SELECT string_id, alias, {NORM('alias')} AS alias_key FROM aliases", ()),
    "pair_keys": (f"SELECT protein1, protein2, combined_score, least({NORM('protein1')}, {NORM('protein2')}) AS pair_key1, "
                  f"greatest({NORM('protein1')}, {NORM('protein2')}) AS pair_key2 FROM links", ()),
    # 2.11 composed jobs
    "confident_pairs": ("SELECT * FROM cp", ("chain_pair_iptm_best", "chain_pair_iptm_mean", "ptm", "iptm")),
    "confident_pairs_bucketed": ("SELECT * FROM cp", ("chain_pair_iptm_best", "chain_pair_iptm_mean", "ptm", "iptm")),
    "id_map": ("SELECT * FROM idmap", ()),
    "gene_name_map": ("SELECT * FROM genes", ()),
    "annotated_ids": ("SELECT * FROM annotated", ()),
    "matched_missing": ("SELECT * FROM mm", ()),
    "matched_missing_exact": ("""
SELECT h.uniprot_id, h.string_id, i.preferred_name AS string_gene_name, i.annotation
FROM (SELECT DISTINCT p.protein_id AS uniprot_id, a.string_id FROM need p JOIN aliases_uni a ON p.protein_id = lower(a.alias)) h
JOIN info i ON h.string_id = i.string_id""", ()),
    "quartile_cascade": (f"""
SELECT 1 AS round, c1 AS cutoff, (SELECT count(*) FROM pairs p WHERE p.{MC} >= c1) AS kept FROM cutoffs
UNION ALL SELECT 2, c2, (SELECT count(*) FROM pairs p WHERE p.{MC} >= c1 AND p.{MC} >= c2) FROM cutoffs
UNION ALL SELECT 3, c3, (SELECT count(*) FROM cascade3) FROM cutoffs""", ("cutoff",)),
    "weighted_edges_cascade": (_edges("SELECT * FROM cascade3"), ("weight",)),
    "minmax_scale": (f"SELECT {PAIR_COLS}, CASE WHEN mx - mn = 0 THEN NULL ELSE ({MC} - mn) / (mx - mn) END AS normalized "
                     f"FROM (SELECT *, min({MC}) OVER () AS mn, max({MC}) OVER () AS mx FROM pairs WHERE {MC} >= 0.061) t",
                     SCORES4 + ("normalized",)),
    "zscore_pairs": (f"SELECT {PAIR_COLS}, CASE WHEN sd = 0 THEN NULL ELSE ({MC} - mu) / sd END AS z_score "
                     f"FROM (SELECT *, avg({MC}) OVER () AS mu, stddev_pop({MC}) OVER () AS sd FROM pairs) t",
                     SCORES4 + ("z_score",)),
    "roc_curve": (f"SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, "
                  f"CASE WHEN P = 0 THEN NULL ELSE CAST(tp AS DOUBLE) / P END AS tpr, "
                  f"CASE WHEN N = 0 THEN NULL ELSE CAST(fp AS DOUBLE) / N END AS fpr FROM ({_CURVE}) c",
                  ("threshold", "tpr", "fpr")),
    "pr_curve": (f"SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, "
                 f"CASE WHEN tp + fp = 0 THEN NULL ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS precision, "
                 f"CASE WHEN P = 0 THEN NULL ELSE CAST(tp AS DOUBLE) / P END AS recall FROM ({_CURVE}) c",
                 ("threshold", "precision", "recall")),
    "roc_auc": (f"SELECT CASE WHEN max(P) * max(N) = 0 THEN NULL ELSE "
                f"sum(CAST(neg * (2 * tp - pos) AS DOUBLE)) / (2.0 * max(P) * max(N)) END AS roc_auc FROM ({_CURVE}) c",
                ("roc_auc",)),
    "average_precision": (f"SELECT CASE WHEN max(P) = 0 THEN NULL ELSE "
                          f"sum(pos * (CAST(tp AS DOUBLE) / (tp + fp))) / CAST(max(P) AS DOUBLE) END "
                          f"AS average_precision FROM ({_CURVE}) c", ("average_precision",)),
}

_Q["confident_pairs_undirected"] = ("""
SELECT af3_id1, af3_id2, chain_pair_iptm_best, chain_pair_iptm_mean, ptm, iptm FROM (
  SELECT *, row_number() OVER (PARTITION BY least(af3_id1, af3_id2), greatest(af3_id1, af3_id2)
    ORDER BY chain_pair_iptm_best DESC NULLS LAST, chain_pair_iptm_mean DESC NULLS LAST, name ASC NULLS LAST,
    ptm DESC NULLS LAST, iptm DESC NULLS LAST) AS rn
  FROM jc WHERE chain_pair_iptm_best >= 0.6) t
WHERE rn = 1""", ("chain_pair_iptm_best", "chain_pair_iptm_mean", "ptm", "iptm"))

_MEAN_CURVE = _CURVE.replace("chain_pair_iptm_best", "chain_pair_iptm_mean")
_NEGATIVE_CURVE = _CURVE.replace(" AND combined_score IS NOT NULL", "")
for _key, _curve in (("mean", _MEAN_CURVE), ("unscored_negative", _NEGATIVE_CURVE)):
    for _name in ("roc_auc", "average_precision"):
        _Q[f"{_name}_{_key}"] = (_Q[_name][0].replace(_CURVE, _curve), _Q[_name][1])


def oracle_queries() -> dict[str, str]:
    out = {}
    for key, (body, doubles) in _Q.items():
        if doubles:
            repl = ", ".join(f"{R6(c)} AS {c}" for c in doubles)
            out[key] = f"{PRELUDE}SELECT * REPLACE ({repl}) FROM ({body}) q"
        else:
            out[key] = f"{PRELUDE}SELECT * FROM ({body}) q"
    return out


def double_columns() -> dict[str, tuple[str, ...]]:
    return {k: v[1] for k, v in _Q.items()}
