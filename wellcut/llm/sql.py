"""SQL for DuckDB over the same tables, where SQL can express a query."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP7 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {WORDS} AS ws FROM documents),
tri AS (SELECT r, unnest(list_transform(range(1, len(ws) - 1), lambda i: struct_pack(i := i, k := ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) AS x FROM d),
often AS (SELECT r, x.k AS k FROM tri GROUP BY 1, 2 HAVING count(*) > 1),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT tri.r, unnest([x.i, x.i + 1, x.i + 2]) AS p FROM tri JOIN often o ON o.r = tri.r AND o.k = x.k) GROUP BY 1),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS BIGINT) AS n_lines,
  CAST(len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_distinct,
  CAST(coalesce(hit.n, 0) AS BIGINT) AS n_repeat_words, CAST(length(regexp_replace(t, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper, CAST(length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS BIGINT) AS n_letters
  FROM d LEFT JOIN hit USING (r)),
f AS (SELECT *, n_lines - n_distinct AS n_dup_lines,
  CAST(CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END + CASE WHEN 100 * n_symbols > 20 * n_words THEN 4 ELSE 0 END
  + CASE WHEN n_letters > 0 AND 2 * n_upper > n_letters THEN 8 ELSE 0 END + CASE WHEN word_chars > 20 * n_words OR word_chars < 2 * n_words THEN 16 ELSE 0 END
  + CASE WHEN 10 * (n_lines - n_distinct) > 3 * n_lines THEN 32 ELSE 0 END AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, (failed & 31) = 0 AS kept, failed FROM f
"""

ORACLE_SQL: dict[str, str] = {
    "op7_quality_rules": OP7,
}
