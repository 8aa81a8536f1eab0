"""DuckDB statements for the pN_ queries that SQL can express over whole tables."""

_P3_LINES = r"""
WITH site_of AS (SELECT result_id, site FROM ingest_results WHERE site IS NOT NULL),
t AS (SELECT DISTINCT 'blocks' AS tab, site, block_id AS row_id, result_id AS doc, text FROM blocks JOIN site_of USING (result_id) WHERE text IS NOT NULL
      UNION ALL SELECT 'ingest_results', site, result_id, result_id, source_text FROM ingest_results WHERE site IS NOT NULL AND source_text IS NOT NULL),
l AS (SELECT tab, site, row_id, doc, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM t),
k AS (SELECT tab, site, row_id, doc, line_no, regexp_replace(lower(line), '[^\p{L}]+', '', 'g') AS letters FROM l),
m AS (SELECT * FROM k WHERE length(letters) >= 12),
n AS (SELECT site, count(DISTINCT result_id) AS site_n FROM site_of GROUP BY site),
f AS (SELECT tab, site, letters FROM m JOIN n USING (site) GROUP BY tab, site, letters, site_n HAVING count(DISTINCT doc) >= 4 AND count(DISTINCT doc) >= 0.2 * site_n)
"""

ORACLE: dict[str, str] = {
    "p3_found": _P3_LINES + "SELECT DISTINCT tab, row_id, CAST(line_no AS INTEGER) AS line_no FROM m JOIN f USING (tab, site, letters)",
    "p3_clean": _P3_LINES
    + r""", every AS (SELECT 'blocks' AS tab, site, block_id AS row_id, text FROM blocks LEFT JOIN site_of USING (result_id) UNION ALL SELECT 'ingest_results', site, result_id, source_text FROM ingest_results),
e AS (SELECT *, row_number() OVER () AS rn FROM every),
x AS (SELECT rn, tab, site, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM e),
y AS (SELECT x.rn, x.line, x.line_no FROM x LEFT JOIN f ON f.tab = x.tab AND f.site = x.site AND f.letters = regexp_replace(lower(x.line), '[^\p{L}]+', '', 'g') WHERE f.letters IS NULL),
z AS (SELECT rn, string_agg(line, chr(10) ORDER BY line_no) AS kept FROM y GROUP BY rn)
SELECT tab, row_id, CASE WHEN text IS NOT NULL THEN coalesce(kept, '') END AS text FROM e LEFT JOIN z USING (rn)""",
    "p5_found": "SELECT DISTINCT 'blocks' AS tab, block_id AS row_id FROM blocks WHERE length(text) > 2000 "
    "UNION SELECT 'ingest_results', result_id FROM ingest_results WHERE length(markdown) > 6000",
}
