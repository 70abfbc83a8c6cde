"""op10_secret_scan in DuckDB's SQL, written on its own."""

_NAME = r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_KINDS = [
    ("assign", _NAME, 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]{32,}", 0, 32),
    ("opaque", _NAME + "|([A-Za-z0-9+/_-]{20,})", 3, 20),
]


def _matches(k):
    _, pattern, group, _ = _KINDS[k]
    return f"""SELECT rid, doc_id, source, {k} AS kind, regexp_extract_all(t, '{pattern}', 0) AS w,
    regexp_extract_all(t, '{pattern}', {group}) AS v, string_split_regex(t, '{pattern}') AS g FROM base"""


_LEAST = " ".join(f"WHEN {k} THEN {least}" for k, (_, _, _, least) in enumerate(_KINDS))
_TITLE = " ".join(f"WHEN {k} THEN '{name}'" for k, (name, _, _, _) in enumerate(_KINDS))
_SPAN = f"CASE kind {_TITLE} END || ':' || b || ':' || e"

SQL = f"""
WITH base AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_matches(k) for k in range(len(_KINDS)))}),
s AS (SELECT rid, doc_id, source, kind, unnest(w) AS w, unnest(v) AS v, unnest(g[1:len(w)]) AS g, unnest(range(len(w))) AS i FROM m),
p AS (SELECT *, sum(length(g) + length(w)) OVER (PARTITION BY rid, kind ORDER BY i) AS e FROM s),
c AS (
  SELECT rid, doc_id, source, kind, v, CAST(e - length(w) AS BIGINT) AS b, CAST(e AS BIGINT) AS e FROM p
  WHERE length(v) >= CASE kind {_LEAST} END AND (kind < 3 OR (
    regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')
    AND NOT regexp_matches(v, '[0-9a-f]{{32}}') AND NOT regexp_matches(v, 'AKIA[A-Z0-9]{{12}}')))
),
f AS (SELECT v, count(DISTINCT coalesce(source, chr(1))) >= 3 AS copied FROM c GROUP BY v),
j AS (SELECT c.*, f.copied FROM c JOIN f USING (v))
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg({_SPAN}, ',' ORDER BY b, kind) FILTER (kind < 3), '')) AS base_sha256,
  coalesce(string_agg({_SPAN}, ',' ORDER BY b, kind) FILTER (kind < 3 OR NOT copied), '') AS spans,
  count(*) FILTER (kind < 3 AND NOT copied) AS n_live, count(*) FILTER (kind < 3 AND copied) AS n_copied
FROM base d LEFT JOIN j ON j.rid = d.rid GROUP BY d.rid, d.doc_id
"""
