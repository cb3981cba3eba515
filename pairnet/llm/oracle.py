"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

OP4 = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""

OP9 = r"""
WITH d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (
  SELECT *, [5.0, 2.0, 1.0][(place % 3 + 1)::INT]::DOUBLE AS w, (source_size * 2.0::DOUBLE) AS cap,
         (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM s),
o AS (
  SELECT *, sum(cap) OVER (ORDER BY cap / w, place ROWS UNBOUNDED PRECEDING) - cap AS below,
         sum(w) OVER (ORDER BY cap / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w FROM w),
f AS (SELECT *, cap * open_w <= w * (budget - below) AS is_full FROM o),
t AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN cap ELSE w * ((budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ())
              / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ()) END AS target,
         ('0x' || substr(md5('mix-1:' || coalesce('s' || source, 'n')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM f),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         (row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST))::DOUBLE AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((floor(place * rate + u) - floor((place - 1) * rate + u))::BIGINT * size)::BIGINT AS taken
FROM r
"""


def oracle_queries() -> dict[str, str]:
    return {"op4_exact_dedup": OP4, "op9_source_mix": OP9}
