"""DuckDB SQL of the operators that SQL can express, by brute force."""

from __future__ import annotations

from .secrets import BASE_RULES, RULES, Rule

_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP3_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS shingles FROM w
), e AS (
  SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS shared FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p WHERE 100 * shared >= 80 * (nx + ny - shared) UNION SELECT y, x FROM p WHERE 100 * shared >= 80 * (nx + ny - shared)
), r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.c FROM r JOIN l ON r.doc_id = l.x
), g AS (
  SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1
)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN g USING (doc_id)
"""

OP10_SQL = rf"""
WITH w AS (
  SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents
), v AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)
), f AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first FROM v
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM f WHERE first < doc_id
), a AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w
), k AS (
  SELECT a.doc_id, string_agg(word, ' ' ORDER BY a.p) FILTER (WHERE gone.p IS NULL) AS kept, count(gone.p) AS n FROM a LEFT JOIN gone ON gone.doc_id = a.doc_id AND gone.p = a.p GROUP BY 1
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""


def _spans(number: int, rule: Rule) -> str:
    regex = "'" + rule.pattern.replace("'", "''") + "'"
    before = "list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
    found = f"SELECT row_no, unnest(range(1, len(m) + 1)) AS i, m, g FROM (SELECT row_no, regexp_extract_all(body, {regex}) AS m, string_split_regex(body, {regex}) AS g FROM t WHERE regexp_matches(body, {regex}))"
    return f"SELECT row_no, {number} AS kind_no, '{rule.kind}' AS kind, CAST({before} AS BIGINT) AS start, m[i] AS part FROM ({found}) WHERE length(regexp_extract(m[i], {regex}, {rule.valued})) >= {rule.least}"


_SPAN_LIST = "string_agg(kind || ':' || start || ':' || (start + length(part)), ',' ORDER BY start, kind_no)"

OP5_SQL = f"""
WITH t AS (
  SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS body FROM documents
), s AS (
  {" UNION ALL ".join(_spans(k, rule) for k, rule in enumerate(RULES))}
), a AS (
  SELECT row_no, {", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)},
         {_SPAN_LIST} FILTER (WHERE kind_no < {len(BASE_RULES)}) AS base, {_SPAN_LIST} AS spans FROM s GROUP BY 1
)
SELECT doc_id, {", ".join(f"CAST(coalesce(n_{r.kind}, 0) AS BIGINT) AS n_{r.kind}" for r in BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN a USING (row_no)
"""
