"""DuckDB SQL for the corpus operators that SQL can express on whole tables."""

#: Lines as rows; a pair at most one edit apart agrees in its first or its second half (the longer line's halves).
_LINE_DEDUP = """
WITH l AS (
  SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10)))))::BIGINT AS no, unnest(string_split(text, chr(10))) AS line
  FROM documents
), named AS (
  SELECT * FROM l WHERE trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> ''
), firsts AS (
  SELECT line, min((doc_id, no)) AS pos, length(line) AS n FROM named GROUP BY line
), halves AS (  -- of a line of its own length, and of one from which a character is missing
  SELECT line, pos, n AS m, 0 AS side, left(line, n // 2) AS half FROM firsts WHERE n >= 20
  UNION ALL SELECT line, pos, n, 1, substr(line, n // 2 + 1) FROM firsts WHERE n >= 20
  UNION ALL SELECT line, pos, n + 1, 0, left(line, (n + 1) // 2) FROM firsts WHERE n >= 20
  UNION ALL SELECT line, pos, n + 1, 1, substr(line, (n + 1) // 2) FROM firsts WHERE n >= 20
), near AS (
  SELECT DISTINCT a.line FROM halves a JOIN halves b ON a.m = b.m AND a.side = b.side AND a.half = b.half
  WHERE b.pos < a.pos AND levenshtein(a.line, b.line) <= 1
), exact AS (
  SELECT doc_id, no FROM named JOIN firsts USING (line) WHERE (doc_id, no) <> pos
), gone AS (
  SELECT doc_id, no FROM exact UNION SELECT doc_id, no FROM named JOIN near USING (line)
), kept AS (
  SELECT l.doc_id, count(*) FILTER (g.no IS NOT NULL) AS n_removed, string_agg(l.line, chr(10) ORDER BY l.no) FILTER (g.no IS NULL) AS text
  FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.no = l.no GROUP BY l.doc_id
), counted AS (SELECT doc_id, count(*) AS n_lines FROM named GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
  CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN counted c USING (doc_id)
"""

SQL: dict[str, str] = {"op5_line_dedup": _LINE_DEDUP}
