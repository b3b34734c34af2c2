"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

# Words are the runs of characters other than space and U+0009 to U+000D.
OP1 = r"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), split AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
  FROM base
), wins AS (
  SELECT rid, unnest(range(1, greatest(len(w) - 1, 1))) AS i, w FROM split
), keyed AS (
  SELECT rid, i, list_slice(w, i, i + 2) AS k FROM wins
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM keyed) WHERE n > 1
), rep AS (
  SELECT rid, count(DISTINCT i + d) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS d) GROUP BY rid
), m AS (
  SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper,
         CAST(length(regexp_replace(t, '[\x09-\x0D\x20-@\[-`{-~]', '', 'g')) AS BIGINT) AS n_letters
  FROM split s LEFT JOIN rep USING (rid)
), v AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    (100 * n_symbols > 10 * word_chars) AS symbols, (100 * n_upper > 50 * word_chars) AS upper_case,
    (word_chars > 20 * n_words) AS long_words, (100 * n_dup_lines > 30 * n_lines) AS dup_lines,
    (100 * n_letters < 60 * word_chars) AS few_letters
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR symbols OR upper_case OR long_words OR dup_lines OR few_letters) AS kept
FROM v
"""
