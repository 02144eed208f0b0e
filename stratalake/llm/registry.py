"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import exact, lines, mixing, neardup, packing, quality, substring, suffix, tiff, toxicity

OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5('20240:' || coalesce(doc_id::VARCHAR, '')) AS place FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS sz, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT source, sz, 3 * sz AS cap, [5, 2, 1][i % 3 + 1]::DOUBLE AS wt, i, sum(sz) OVER () AS total FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / wt, i) AS k,
             coalesce(sum(cap) OVER (ORDER BY cap / wt, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             sum(wt) OVER (ORDER BY cap / wt, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
level AS (SELECT arg_min((total - before) / rest, k) AS level FROM o WHERE (total - before) / rest <= cap / wt),
q AS (SELECT source, sz, least(cap, wt * coalesce(level, 0)) AS target FROM w, level),
r AS (SELECT d.doc_id, d.size, q.sz::BIGINT AS source_size, q.target, floor(q.target + 0.5)::BIGINT AS quota,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id, d.size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size::BIGINT AS size, source_size, round(target, 6) AS target,
       CASE WHEN source_size = 0 THEN 0 ELSE (quota // source_size) * size + greatest(0, least(size, quota % source_size - (upto - size))) END::BIGINT AS taken
FROM r
"""

OP2_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id < c.last AS gone FROM k LEFT JOIN c ON k.key = c.key AND length(k.key) >= 20)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM d),
k AS (SELECT doc_id, pos, word, CASE WHEN count(*) OVER f = 13 THEN md5(string_agg(word, ' ') OVER f) END AS key
      FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
m AS (SELECT key, min(doc_id) AS first FROM k WHERE key IS NOT NULL GROUP BY key),
h AS (SELECT k.*, coalesce(m.first < k.doc_id, false) AS hit FROM k LEFT JOIN m ON k.key = m.key),
c AS (SELECT *, max(hit::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) = 1 AS gone FROM h)
SELECT d.doc_id, count(word) AS n_words, count(word) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM d LEFT JOIN c ON d.doc_id = c.doc_id GROUP BY d.doc_id
"""

OP7_SQL = r"""
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM t
"""

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_line_dedup": lines.op2_line_dedup,
    "op3_substring_dedup": substring.op3_substring_dedup,
    "op4_quality": quality.op4_quality,
    "op5_suffix_dedup": suffix.op5_suffix_dedup,
    "op6_media": tiff.op6_media,
    "op7_exact_dedup": exact.op7_exact_dedup,
    "op8_near_dup": neardup.op8_near_dup,
    "op9_packing": packing.op9_packing,
    "op10_toxicity": toxicity.op10_toxicity,
}
SQL = {"op1_mixing": OP1_SQL, "op2_line_dedup": OP2_SQL, "op3_substring_dedup": OP3_SQL, "op7_exact_dedup": OP7_SQL}
