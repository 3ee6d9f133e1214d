"""Small helpers for writing oracle SQL text."""


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


# TXT-1 in SQL: lines numbered, classified, folded with windows.
SQL_SPLIT = r"""
WITH raw AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]')) AS raw,
                    generate_subscripts(regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]'), 1) AS pos FROM documents),
 k AS (SELECT *, CASE WHEN regexp_full_match(raw, '\s*') THEN 'blank' WHEN regexp_matches(raw, '^ {0,3}#{1,6}\s+(.*)$') THEN 'heading'
                 WHEN regexp_matches(raw, '^\s*(?:[-*+]|\d+[.)]|[Rr]\d+\s*[.):])\s+') THEN 'marker' ELSE 'line' END AS kind FROM raw),
 c AS (SELECT *, CASE WHEN kind = 'marker' THEN regexp_replace(raw, '^\s*(?:[-*+]|\d+[.)]|[Rr]\d+\s*[.):])\s+', '') ELSE raw END AS content,
         CASE WHEN kind = 'heading' THEN row(nullif(trim(regexp_replace(trim(regexp_extract(raw, '^ {0,3}#{1,6}\s+(.*)$', 1)), '#+$', '')), '')) END AS head,
         CASE WHEN kind = 'marker' THEN nullif(regexp_replace(regexp_extract(raw, '^\s*[Rr](\d+)\s*[.):]\s+', 1), '^0+(\d)', '\1'), '') END AS label FROM k),
 st AS (SELECT *, kind = 'marker' OR (kind = 'line' AND (lag(kind) OVER w IS NULL OR lag(kind) OVER w IN ('blank', 'heading')
           OR (NOT regexp_matches(raw, '^\s') AND regexp_matches(rtrim(lag(content) OVER w), '[.!?:;]$')))) AS start
        FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
 it AS (SELECT *, sum(start::INT) OVER w AS item, last_value(head IGNORE NULLS) OVER w AS sec FROM st
        WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
 g AS (SELECT doc_id, item, trim(string_agg(trim(regexp_replace(regexp_replace(content, '^\s+', ''), '\s+$', '')), ' ' ORDER BY pos)) AS text,
         arg_min(sec, pos) AS sec, arg_min_null(label, pos) AS label FROM it WHERE kind IN ('marker', 'line') GROUP BY doc_id, item),
 n AS (SELECT doc_id, text, struct_extract_at(sec, 1) AS section, label, row_number() OVER (PARTITION BY doc_id ORDER BY item) AS position,
         count(*) OVER d AS n, count(label) OVER d AS labelled, count(DISTINCT label) OVER d AS labels
       FROM g WHERE text <> '' WINDOW d AS (PARTITION BY doc_id))
SELECT doc_id, 'R' || CASE WHEN labelled = n AND labels = n THEN label ELSE CAST(position AS VARCHAR) END AS req_id, text, section,
  CAST(position AS INT) AS position FROM n
UNION ALL SELECT doc_id, 'R1', trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), NULL, 1 FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM n) AND trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) <> ''"""
