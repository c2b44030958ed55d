"""DuckDB SQL of the contract queries that SQL can express."""

from __future__ import annotations

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH u AS (
  SELECT page_id,
    coalesce({_LOW.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
  END AS rule FROM u
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

_WORDS = "regexp_extract_all(" + _LOW.format("coalesce(text, '')") + r", '[0-9a-z\x{80}-\x{10FFFF}]+')"

OP6 = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark
), i AS (SELECT * FROM b WHERE len(w) > 0),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM i)
), sizes AS (SELECT DISTINCT size FROM win),
spot AS (
  SELECT row, size, s, array_to_string(w[s:s + size - 1], ' ') AS win
  FROM (SELECT row, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size)
), hit AS (SELECT row, size, s, item FROM spot JOIN win USING (size, win)),
places AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(s, s + size)) AS p FROM hit) GROUP BY row),
items AS (SELECT row, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (row) LEFT JOIN items USING (row)
"""

_UNESCAPE = r"replace(replace(replace(replace(replace({0}, '<\/turn>', '</turn>'), '<\turn ', '<turn '), '-\l', '<'), '-\g', '>'), '\\', '\')"
_ESCAPE = r"replace(replace(replace({0}, '\', '\\'), '</turn>', '<\/turn>'), '<turn ', '<\turn ')"
_CONFLICT = "(" + _UNESCAPE + " <> {0} OR contains({0}, '</turn>') OR contains({0}, '<turn ')"
_ROLE_ESCAPE = r"replace(replace(replace({0}, '\', '\\'), '<', '-\l'), '>', '-\g')"

OP8 = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), e AS (
  SELECT *,
    CASE WHEN {_CONFLICT.format("role")} OR contains(role, '<') OR contains(role, '>')) THEN {_ROLE_ESCAPE.format("role")} ELSE role END AS r,
    CASE WHEN {_CONFLICT.format("text")}) THEN {_ESCAPE.format("text")} ELSE text END AS t
  FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (sum(length(r) + length(t) + 14) + count(*) - 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
