"""DuckDB statements that give the same rows as the queries, written apart from them.

The folds blocks, merged_blocks, markdown_out, link_markers and ingest_gate have none: their blocks carry state from line to
line and are tested on literal cases instead.
"""

WS = r"[\t\n\v\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
IN = WS[1:-1]
NOT_WS = WS.replace("[", "[^", 1)
STOP = "the a an and or but of to in on at by for with as is was were that this it he she they mr mrs ms"


def trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def norm(x: str) -> str:
    return trim(f"regexp_replace(translate({x}, chr(160) || '‘’“”', ' ''''\"\"'), '[ \\t]+', ' ', 'g')")


LINES = f"""
WITH src AS (SELECT result_id AS doc_id, string_split(source_text, chr(10)) AS a FROM ingest_results WHERE source_text IS NOT NULL),
raw AS (SELECT doc_id, unnest(a) AS t, unnest(range(len(a))) AS idx FROM src),
l0 AS (SELECT doc_id, CAST(floor(idx / 40) AS INTEGER) AS pg, CAST(idx % 40 AS INTEGER) AS ln, t, regexp_matches(t, '{NOT_WS}') AS txt FROM raw),
lines AS (SELECT *, length(t) - length(regexp_replace(t, '^{WS}+', '')) AS ind, {norm('t')} AS norm FROM l0 QUALIFY bool_or(txt) OVER (PARTITION BY doc_id, pg))
"""
MARGIN = """, ic AS (SELECT doc_id, ind, count(*) AS n FROM lines WHERE txt GROUP BY doc_id, ind),
margin AS (SELECT doc_id, ind AS margin FROM ic QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, ind) = 1)"""
DOUBLE = """, ds0 AS (SELECT doc_id, pg, txt, txt AND coalesce(NOT lead(txt) OVER (PARTITION BY doc_id, pg ORDER BY ln), false) AS gap FROM lines),
ds AS (SELECT doc_id, pg, count(*) FILTER (txt) AS nonblank, count(*) FILTER (gap) AS alternating FROM ds0 GROUP BY doc_id, pg)"""
INLINE = "^" + WS + r"{0,8}([0-9]{1,4})" + WS + r"{0,3}[A-Za-z\"“(]"
STACKED = "^" + WS + r"{0,10}([0-9]{1,4})" + WS + "*$"
CAND = f"""
, c0 AS (SELECT *, (SELECT NULL) AS z, first_value(CASE WHEN txt THEN t END IGNORE NULLS) OVER (PARTITION BY doc_id, pg ORDER BY ln ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM lines),
cand AS (SELECT doc_id, pg, ln, CAST(CASE WHEN regexp_matches(t, '{INLINE}') THEN regexp_extract(t, '{INLINE}', 1) ELSE regexp_extract(t, '{STACKED}', 1) END AS INTEGER) AS note FROM c0
  WHERE regexp_matches(t, '{INLINE}') OR (regexp_matches(t, '{STACKED}') AND regexp_matches(nx, '[A-Za-z][A-Za-z]') AND NOT regexp_matches(nx, '{STACKED}')))"""
LEAD = "[.·]{4,}" + WS + "*([0-9]{1,4})" + WS + "*$"
NUMB = r"^([IVXLC]{1,6}|[A-Z]|[0-9]{1,2})\." + WS + "+(.+)$"


def heads(table: str, x: str) -> str:
    """CTEs that end in ``hd``: the rows of table with the level and text of headings (level null for others)."""
    return f""", h0 AS (SELECT *, {trim(x)} AS ht, {trim(f"regexp_replace({trim(x)}, '{WS}+[0-9]{{1,4}}$', '')")} AS hb FROM {table}),
h1 AS (SELECT *, {trim(f"regexp_extract(hb, '{NUMB}', 2)")} AS hn, regexp_replace(hb, '[^A-Za-z]', '', 'g') AS hl FROM h0),
h2 AS (SELECT *, list_filter(regexp_split_to_array(hn, '{WS}+'), lambda w: regexp_matches(w, '[A-Za-z]')) AS hw,
  (ht <> '' AND NOT regexp_matches(ht, '{LEAD}') AND hb <> '' AND len(regexp_split_to_array(hb, '{WS}+')) <= 14 AND NOT regexp_matches(hb, '[;:,\\-\\x{{00ad}}‐]$')) AS fits FROM h1),
h3 AS (SELECT *, fits AND regexp_matches(hb, '{NUMB}') AND regexp_matches(hn, '^[A-Z]') AND NOT regexp_matches(hn, '\\.$')
    AND (hn = upper(hn) OR (len(hw) >= 2 AND len(list_filter(hw, lambda w: regexp_matches(w, '^[A-Z]'))) / len(hw) >= 0.6)) AS is_n,
  fits AND length(hl) >= 4 AND hb = upper(hb) AND NOT regexp_matches(hb, '\\.$') AND NOT regexp_matches(hb, '[$%]') AND NOT regexp_matches(hb, '[0-9]{{3}}')
    AND length(hb) - length(replace(hb, ',', '')) < 2 AND length(hl) / length(hb) > 0.6 AS is_c FROM h2),
hd AS (SELECT *, CASE WHEN is_n THEN CASE WHEN hn = upper(hn) THEN 2 ELSE 3 END WHEN is_c THEN 2 END AS hlevel, CASE WHEN is_n THEN hn WHEN is_c THEN hb END AS htext FROM h3)"""


STRIPPED = r"regexp_replace(markdown, '\A---\r?\n(?s:.*?)\r?\n---\r?\n?', '')"
BODY = rf"regexp_replace({STRIPPED}, '\n## Notes\n(?s:.*)', '')"
BLOCKS = f"""
WITH bx AS (SELECT result_id AS doc_id, regexp_split_to_array({BODY}, '\\n{{2,}}') AS a FROM ingest_results WHERE markdown IS NOT NULL),
b0 AS (SELECT doc_id, unnest(a) AS raw, CAST(unnest(range(len(a))) AS INTEGER) AS seq FROM bx),
b1 AS (SELECT doc_id, seq, {trim('raw')} AS t FROM b0),
b AS (SELECT doc_id, seq, CASE WHEN regexp_matches(t, '^%%page [0-9]+%%$') THEN 'page' WHEN regexp_matches(t, '^#{{1,6}} ') THEN 'heading' WHEN t LIKE '> %' THEN 'quote'
    WHEN regexp_matches(t, '^- .* — [0-9]+$') THEN 'contents' WHEN regexp_matches(t, '^\\[\\^[0-9]+\\]:') THEN 'note' ELSE 'paragraph' END AS kind,
  CASE WHEN regexp_matches(t, '^#{{1,6}} ') THEN length(regexp_extract(t, '^(#{{1,6}}) ', 1)) END AS level,
  CASE WHEN regexp_matches(t, '^%%page [0-9]+%%$') THEN regexp_extract(t, '[0-9]+') ELSE regexp_replace(t, '^(?:#{{1,6}}|>) +', '') END AS text FROM b1 WHERE t <> '')
"""
IDS = f"""
, p0 AS (SELECT doc_id, seq, text, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(text), '\\[\\^[0-9]+\\]', ' ', 'g'), '[^\\p{{L}}\\p{{N}}\\-{IN}]', ' ', 'g'), '{WS}+'), lambda w: w <> '') AS w FROM b WHERE kind = 'paragraph'),
p1 AS (SELECT *, list_filter(w, lambda x: NOT list_contains(string_split('{STOP}', ' '), x)) AS m FROM p0),
p2 AS (SELECT *, regexp_replace(substr(array_to_string((CASE WHEN len(m) >= 2 THEN m ELSE w END)[1:5], '-'), 1, 60), '-+$', '') AS b0 FROM p1),
p3 AS (SELECT doc_id, seq, text, CASE WHEN b0 = '' THEN 'para' ELSE b0 END AS base FROM p2),
ids AS (SELECT doc_id, seq, text, CASE WHEN row_number() OVER o = 1 THEN base ELSE base || '-' || row_number() OVER o END AS para_id FROM p3 WINDOW o AS (PARTITION BY doc_id, base ORDER BY seq))
"""
PAGES = ", pp AS (SELECT doc_id, seq, kind, last_value(CASE WHEN kind = 'page' THEN CAST(text AS INTEGER) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS page FROM b)"
SECTIONS = f"""
, s0 AS (SELECT *, kind = 'heading' AND level IN (2, 3) AS hd, CASE WHEN kind <> 'page' THEN length(text) + 1 ELSE 0 END AS ln FROM b),
s1 AS (SELECT *, sum(CASE WHEN hd THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS part FROM s0),
s2 AS (SELECT doc_id, part, sum(ln) - 1 AS chars FROM s1 GROUP BY doc_id, part),
s3 AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY doc_id ORDER BY part) = 1 OR chars >= 800 THEN 1 ELSE 0 END AS o FROM s2),
s4 AS (SELECT *, sum(o) OVER (PARTITION BY doc_id ORDER BY part ROWS UNBOUNDED PRECEDING) AS grp FROM s3),
s5 AS (SELECT doc_id, grp, sum(chars + 1) - 1 AS total, max(grp) OVER (PARTITION BY doc_id) AS groups FROM s4 GROUP BY doc_id, grp),
s6 AS (SELECT doc_id, max(CASE WHEN grp = 1 AND total < 800 AND groups > 1 THEN 1 ELSE 0 END) AS sh FROM s5 GROUP BY doc_id),
s7 AS (SELECT s1.*, greatest(s4.grp - s6.sh, 1) AS sec_ord FROM s1 JOIN s4 USING (doc_id, part) JOIN s6 USING (doc_id)),
s8 AS (SELECT doc_id, sec_ord, coalesce(arg_min(CASE WHEN hd THEN text END, CASE WHEN hd THEN seq END), 'Front matter') AS title,
  CAST(arg_min(CASE WHEN kind = 'page' THEN text END, CASE WHEN kind = 'page' THEN seq END) AS INTEGER) AS page, sum(ln) - 1 AS n_chars,
  sum(CASE WHEN kind <> 'page' THEN len(list_filter(regexp_split_to_array(text, '{WS}+'), lambda w: w <> '')) ELSE 0 END) AS words, min(seq) AS first_seq, max(seq) AS last_seq FROM s7 GROUP BY doc_id, sec_ord),
s9 AS (SELECT *, substr(regexp_replace({trim(f"regexp_replace(lower(title), '[^A-Za-z0-9_\\-{IN}]', '', 'g')")}, '{WS}+', '-', 'g'), 1, 80) AS sl FROM s8),
s10 AS (SELECT *, CASE WHEN sl = '' THEN 'section' ELSE sl END AS base FROM s9),
secs AS (SELECT doc_id, sec_ord, CASE WHEN row_number() OVER o = 1 THEN base ELSE base || '-' || row_number() OVER o END AS slug, title, page, n_chars, words, first_seq, last_seq FROM s10 WINDOW o AS (PARTITION BY doc_id, base ORDER BY sec_ord))
"""
DEFS = r"""
WITH m AS (SELECT result_id AS doc_id, markdown FROM ingest_results WHERE markdown IS NOT NULL),
dl AS (SELECT doc_id, unnest(string_split(markdown, chr(10))) AS x, unnest(range(len(string_split(markdown, chr(10))))) AS pos FROM m),
d AS (SELECT doc_id, CAST(regexp_extract(x, '^\[\^([0-9]+)\]:', 1) AS INTEGER) AS number, regexp_extract(x, '^\[\^[0-9]+\]:[ \t]*(.+)$', 1) AS text, pos FROM dl WHERE regexp_matches(x, '^\[\^[0-9]+\]:[ \t]*.+$')),
defs AS (SELECT doc_id, number, arg_max(text, pos) AS text FROM d GROUP BY doc_id, number),
rx AS (SELECT doc_id, regexp_extract_all(BODY, '\[\^[0-9]+\]:?') AS a FROM m),
r0 AS (SELECT doc_id, unnest(list_filter(a, lambda x: x NOT LIKE '%:')) AS x, unnest(range(len(list_filter(a, lambda x: x NOT LIKE '%:')))) AS pos FROM rx),
refs AS (SELECT doc_id, pos, CAST(regexp_extract(x, '[0-9]+') AS INTEGER) AS number FROM r0)
""".replace("BODY", BODY)


def words_of(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array(lower(regexp_replace({x}, '\\[\\^[0-9]+\\]:?', '', 'g')), '{WS}+'), lambda w: regexp_replace(w, '[^a-z0-9]', '', 'g')), lambda w: w <> '')"


# The engine has no look-around, so a repair takes the neighbouring sign along; two passes catch matches that share one.
def fix(x: str) -> str:
    for pattern, to in ((r"0 ([0-9])/([0-9]{2})/([0-9]{4})", r"0\2/\3/\4"), (r"([0-9]{1,2}) ?: ?([0-9]{2})", r"\2:\3"), ("in tum", "in turn"), ("UnUed States", "United States")):
        groups = pattern.count("([")
        one = rf"regexp_replace(X, '(^|[^A-Za-z0-9_]){pattern}($|[^A-Za-z0-9_])', '\1{to}\{groups + 2}', 'g')"
        x = one.replace("X", one.replace("X", x, 1), 1)
    return x


WORDS = f"""
WITH w AS (SELECT result_id AS doc_id, {words_of('source_text')} AS s, {words_of(STRIPPED)} AS o, {words_of(fix('source_text'))} AS f FROM ingest_results)
"""
CHECKS = f"""
WITH m AS (SELECT result_id AS doc_id, markdown, {STRIPPED} AS body FROM ingest_results WHERE markdown IS NOT NULL),
q AS (SELECT *, string_split(body, chr(10)) AS l, regexp_extract_all(markdown, '\\[\\^([0-9]+)\\]', 1) AS refs, regexp_extract_all(chr(10) || markdown, '\\n\\[\\^([0-9]+)\\]:', 1) AS defs FROM m),
n AS (SELECT doc_id, len(list_filter(l, lambda x: regexp_matches(x, '^{WS}*[0-9]{{1,4}}{WS}*$'))) AS n1, CASE WHEN contains(markdown, chr(12)) THEN 1 ELSE 0 END AS n2,
  len(list_filter(refs, lambda x: NOT list_contains(defs, x))) AS n3, len(list_filter(l, lambda x: regexp_matches(x, '^#{{1,6}}{WS}'))) AS n4, CASE WHEN regexp_matches(markdown, '\\n{{4,}}') THEN 1 ELSE 0 END AS n5 FROM q),
checks AS (SELECT doc_id, 'no bare page-number lines' AS name, n1 = 0 AS ok, n1 AS n FROM n UNION ALL SELECT doc_id, 'no form feeds', n2 = 0, n2 FROM n UNION ALL SELECT doc_id, 'every reference has a note', n3 = 0, n3 FROM n
  UNION ALL SELECT doc_id, 'document has headings', n4 > 0, n4 FROM n UNION ALL SELECT doc_id, 'no runs of blank lines', n5 = 0, n5 FROM n)
"""
CATALOG = "SELECT ord, id, title, concat_ws(' · ', nullif(authors, ''), nullif(published_at, '')) AS byline FROM registry WHERE coalesce(ingested, true)"
SAFE = (
    "turn turned turning modern concerning the from and government governmental attorney internal external alternate alternative "
    "return returned returning journal journalist eternal paternal fraternal burn burned learn learned"
)
PAGE_TEXT = ", pt AS (SELECT doc_id, pg, string_agg(t, ' ' ORDER BY ln) AS x FROM lines GROUP BY doc_id, pg)"


def matches(pattern: str, name: str, confidence: str, rule: int) -> str:
    """Matches with their places: the parts between the matches are what is left when each match becomes one sign."""
    return f"""SELECT doc_id, pg, x, {rule} AS rule, '{name}' AS pattern, '{confidence}' AS confidence, regexp_extract_all(x, '{pattern}') AS hits, string_split(regexp_replace(x, '{pattern}', chr(1), 'g'), chr(1)) AS gaps FROM pt"""


_SUSPECTS = " UNION ALL ".join(
    [
        matches(r"\b\w*[a-z]rn[a-z]\w*", "possible rn/m confusion", "possible", 0),
        matches(r"\b[A-Za-z]*[0-9][A-Za-z]+\b", "digit inside a word", "likely", 1),
        matches(r"[A-Za-z]{2,}[;!\\|][A-Za-z]{2,}", "stray punctuation inside a word", "likely", 2),
        matches(r"(?i)\b(?:tum|modem|conceming|thc|fl-om|arid|bo th|ofthe|inthe)\b", "known OCR artefact", "likely", 3),
        matches(r"\b[a-z]{1,2}[A-Z][a-z]", "case break inside a word", "possible", 4),
    ]
)
FOUND = f"""{PAGE_TEXT}, sm AS ({_SUSPECTS}),
su AS (SELECT doc_id, pg, x, rule, pattern, confidence, hits, gaps, unnest(hits) AS match, unnest(range(1, len(hits) + 1)) AS i FROM sm),
sp AS (SELECT doc_id, pg AS page, rule, pattern, confidence, match, x, CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS INTEGER) AS place
  FROM su WHERE NOT list_contains(string_split('{SAFE}', ' '), lower(match))),
found AS (SELECT doc_id, page, rule, pattern, place, match, trim(regexp_replace(substr(x, greatest(place - 40, 0) + 1, place - greatest(place - 40, 0) + length(match) + 40), '{WS}+', ' ', 'g')) AS context, confidence FROM sp),
rg AS (SELECT doc_id, pattern, match, count(*) AS n, arg_min(page, (page, rule, place)) AS page, arg_min(context, (page, rule, place)) AS context, min(confidence) AS confidence, min((page, rule, place)) AS seen FROM found GROUP BY doc_id, pattern, match),
rk AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE confidence WHEN 'certain' THEN 0 WHEN 'likely' THEN 1 ELSE 2 END, n DESC, seen) AS INTEGER) AS rank, pattern, match, n, page, context, confidence FROM rg)
"""


def fitted(x: str) -> str:
    """A quote for a card: at most 420 characters."""
    cut = f"substr({x}, 1, 420)"
    stop = f"length(regexp_extract({cut}, '(?s)^(.*[.?!]) ', 1))"
    return f"CASE WHEN length({x}) <= 420 THEN {x} WHEN {stop} > 210 THEN substr({cut}, 1, {stop}) ELSE substr({cut}, 1, length({cut}) - strpos(reverse({cut}), ' ')) || '…' END"


# Repairs one after the other, counting matches and true changes.
_FIXES = (
    (r"\b0 ([0-9])/([0-9]{2})/([0-9]{4})\b", r"0\1/\2/\3", None),
    (r"\b([0-9]{1,2}) ?: ?([0-9]{2})\b", r"\1:\2", r"\b[0-9]{1,2}(?: : ?| ?: )[0-9]{2}\b"),
    (r"\bin tum\b", "in turn", None),
    (r"\bUnUed States\b", "United States", None),
)
FIXED = "WITH t0 AS (SELECT result_id AS doc_id, source_text AS x FROM ingest_results WHERE source_text IS NOT NULL)" + "".join(
    f", t{k + 1} AS (SELECT doc_id, regexp_replace(x, '{p}', '{to}', 'g') AS x, {'m + ' if k else ''}len(regexp_extract_all(x, '{p}')) AS m, {'c + ' if k else ''}len(regexp_extract_all(x, '{narrow or p}')) AS c FROM t{k})"
    for k, (p, to, narrow) in enumerate(_FIXES)
)

# The notes of every page. A page's own facts (its printed number, the lines left, its candidates, their longest run, the
# openers that have a text) come first; then the expected number runs through the pages of a document.
_OPENER = f"regexp_matches(t, '{INLINE}') OR regexp_matches(t, '{STACKED}')"
SPLIT = f"""
, e0 AS (SELECT *, count(*) OVER p AS size, row_number() OVER (PARTITION BY doc_id, pg ORDER BY ln) - 1 AS place FROM lines WINDOW p AS (PARTITION BY doc_id, pg)),
e1 AS (SELECT doc_id, pg, arg_max(place, place) FILTER (txt AND place >= size - 4) AS foot, arg_max(t, place) FILTER (txt AND place >= size - 4) AS foot_t, arg_min(place, place) FILTER (txt AND place < 3) AS head, arg_min(t, place) FILTER (txt AND place < 3) AS head_t FROM e0 GROUP BY doc_id, pg),
e2 AS (SELECT doc_id, pg, CASE WHEN regexp_matches(foot_t, '^{WS}*[0-9]{{1,4}}{WS}*$') THEN foot WHEN regexp_matches(head_t, '^{WS}*[0-9]{{1,4}}{WS}*$') THEN head END AS taken,
  CASE WHEN regexp_matches(foot_t, '^{WS}*[0-9]{{1,4}}{WS}*$') THEN CAST({trim('foot_t')} AS INTEGER) WHEN regexp_matches(head_t, '^{WS}*[0-9]{{1,4}}{WS}*$') THEN CAST({trim('head_t')} AS INTEGER) END AS printed FROM e1),
e3 AS (SELECT doc_id, pg, printed, t, txt, norm, row_number() OVER (PARTITION BY doc_id, pg ORDER BY place) - 1 AS place, count(*) OVER (PARTITION BY doc_id, pg) AS size FROM e0 JOIN e2 USING (doc_id, pg) WHERE taken IS NULL OR place <> taken),
e4 AS (SELECT *, regexp_matches(t, '{INLINE}') AS inl, regexp_matches(t, '{STACKED}') AS stk, first_value(CASE WHEN txt THEN t END IGNORE NULLS) OVER (PARTITION BY doc_id, pg ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM e3),
e5 AS (SELECT *, CASE WHEN inl THEN CAST(regexp_extract(t, '{INLINE}', 1) AS INTEGER) WHEN stk THEN CAST(regexp_extract(t, '{STACKED}', 1) AS INTEGER) END AS number,
  inl OR (stk AND regexp_matches(nx, '[A-Za-z][A-Za-z]') AND NOT regexp_matches(nx, '{STACKED}')) AS is_c,
  CASE WHEN inl THEN {norm(f"regexp_replace(t, '^{WS}{{0,8}}[0-9]{{1,4}}{WS}{{0,3}}', '')")} WHEN stk THEN '' ELSE norm END AS said FROM e4),
e6 AS (SELECT *, sum(CASE WHEN inl OR stk THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, pg ORDER BY place ROWS UNBOUNDED PRECEDING) AS opener FROM e5),
np AS (SELECT doc_id, pg, opener, min(place) AS place, arg_min(number, place) AS number, {norm("string_agg(said, ' ' ORDER BY place) FILTER (txt AND said <> '')")} AS text FROM e6 WHERE opener > 0 GROUP BY doc_id, pg, opener),
pn AS (SELECT doc_id, pg, list({{'place': place, 'number': number}}) FILTER (text <> '') AS parsed FROM np GROUP BY doc_id, pg),
c1 AS (SELECT *, CASE WHEN number = lag(number) OVER o + 1 THEN 0 ELSE 1 END AS nw FROM e5 WHERE is_c WINDOW o AS (PARTITION BY doc_id, pg ORDER BY place)),
c2 AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id, pg ORDER BY place) AS run FROM c1),
c3 AS (SELECT doc_id, pg, min(place) AS place, count(*) AS n FROM c2 GROUP BY doc_id, pg, run),
c4 AS (SELECT doc_id, pg, place AS run_at, n AS run_n FROM c3 QUALIFY row_number() OVER (PARTITION BY doc_id, pg ORDER BY n DESC, place) = 1),
c5 AS (SELECT doc_id, pg, number, min(place) AS place FROM c1 GROUP BY doc_id, pg, number),
c6 AS (SELECT *, list(number) OVER (PARTITION BY doc_id, pg) AS every FROM c5),
c7 AS (SELECT doc_id, pg, list({{'number': number, 'place': place, 'next': list_contains(every, number + 1)}} ORDER BY number) AS c FROM c6 GROUP BY doc_id, pg),
pages0 AS (SELECT doc_id, pg, any_value(printed) AS printed, any_value(size) AS size, row_number() OVER (PARTITION BY doc_id ORDER BY pg) AS k FROM e3 GROUP BY doc_id, pg),
pages AS (SELECT p.*, coalesce(c, []) AS c, run_at, run_n, coalesce(parsed, []) AS parsed FROM pages0 p LEFT JOIN c7 USING (doc_id, pg) LEFT JOIN c4 USING (doc_id, pg) LEFT JOIN pn USING (doc_id, pg))
"""


def _start(expected: str) -> str:
    exact = f"list_filter(p.c, lambda x: x.number = {expected})[1]"
    near = f"list_filter(p.c, lambda x: x.number > {expected} AND x.number <= {expected} + 6)[1]"
    return (
        f"CASE WHEN {exact}.next OR {exact}.place > p.size * 0.55 THEN {exact}.place WHEN {near}.next OR {near}.place > p.size * 0.55 THEN {near}.place "
        "WHEN p.run_n >= 3 AND p.run_at > p.size * 0.4 THEN p.run_at END"
    )


FOLD = SPLIT.rstrip() + f""",
fold AS (SELECT p.doc_id, p.pg, p.k, p.printed, CAST({_start('1')} AS BIGINT) AS start, 1 AS expected, p.parsed FROM pages p WHERE p.k = 1
  UNION ALL SELECT p.doc_id, p.pg, p.k, p.printed, CAST({_start('x.e')} AS BIGINT), x.e, p.parsed
  FROM (SELECT doc_id, k, coalesce(list_max(list_transform(list_filter(parsed, lambda n: n.place >= start), lambda n: n.number)) + 1, expected) AS e FROM fold) x JOIN pages p ON p.doc_id = x.doc_id AND p.k = x.k + 1),
page_body AS (SELECT doc_id, pg, any_value(e2.printed) AS printed, coalesce(string_agg(t, chr(10) ORDER BY place) FILTER (start IS NULL OR place < start), '') AS body, coalesce(string_agg(t, chr(10) ORDER BY place) FILTER (place >= start), '') AS notes
  FROM e2 LEFT JOIN e3 USING (doc_id, pg) LEFT JOIN fold USING (doc_id, pg) GROUP BY doc_id, pg),
own AS (SELECT n.doc_id, n.pg, n.place, n.number, n.text FROM np n JOIN fold USING (doc_id, pg) WHERE n.place >= fold.start AND n.text <> ''),
pnotes AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pg, place) - 1 AS INTEGER) AS seq, number, text, pg AS page FROM own)
"""
RECURSIVE = LINES.replace("WITH", "WITH RECURSIVE", 1)
MARKED = "CASE kind WHEN 'heading' THEN repeat('#', CAST(level AS INTEGER)) || ' ' || text WHEN 'quote' THEN '> ' || text WHEN 'page' THEN '%%page ' || text || '%%' ELSE text END"
ASKED = ", asked AS (SELECT DISTINCT result_id AS doc_id, paragraph AS para_id FROM share_quotes JOIN ingest_results ON report = report_id)"
SECTION_TEXTS = f""", st AS (SELECT s7.doc_id, sec_ord, string_agg({MARKED}, chr(10) || chr(10) ORDER BY seq) AS text FROM s7 GROUP BY s7.doc_id, sec_ord),
sect AS (SELECT doc_id, CAST(row_number() OVER o AS INTEGER) AS i, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS n, slug, title, page, lag(slug) OVER o AS prev, lead(slug) OVER o AS next, text FROM secs JOIN st USING (doc_id, sec_ord) WINDOW o AS (PARTITION BY doc_id ORDER BY sec_ord))"""
PREVIEW = f""", v0 AS (SELECT doc_id, para_id, {trim(f"regexp_replace(regexp_replace(text, '\\[\\^[0-9]+\\]', '', 'g'), '{WS}+', ' ', 'g')")} AS c FROM ids),
v1 AS (SELECT *, substr(c, 1, 280) AS cut FROM v0),
v2 AS (SELECT *, CASE WHEN contains(cut, ' ') AND length(cut) - strpos(reverse(cut), ' ') > 168 THEN length(cut) - strpos(reverse(cut), ' ') ELSE 280 END AS k FROM v1),
previews AS (SELECT doc_id, para_id, CASE WHEN length(c) <= 280 THEN c ELSE {trim('substr(cut, 1, k)')} || '…' END AS quote FROM v2)"""


def escaped(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;')"


ORACLE: dict[str, str] = {
    "doc_lines": LINES + "SELECT doc_id, count(*) AS n_lines, count(*) FILTER (txt) AS n_nonblank FROM lines GROUP BY doc_id",
    "normalise_lines": LINES + "SELECT doc_id, pg, ln, norm FROM lines",
    "doc_margin": LINES + MARGIN + " SELECT doc_id, margin FROM margin",
    "double_spaced_pages": LINES + DOUBLE + " SELECT doc_id, pg, nonblank, alternating, nonblank >= 4 AND alternating >= 0.6 * nonblank AS is_double FROM ds",
    "collapse_spacing": LINES
    + DOUBLE
    + """, w AS (SELECT l.*, d.doc_id IS NOT NULL AS wide FROM lines l LEFT JOIN (SELECT doc_id, pg FROM ds WHERE nonblank >= 4 AND alternating >= 0.6 * nonblank) d USING (doc_id, pg)),
i AS (SELECT *, sum(CASE WHEN txt THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, pg ORDER BY ln) AS island FROM w),
g AS (SELECT *, count(*) OVER (PARTITION BY doc_id, pg, island, txt) AS n, min(ln) OVER (PARTITION BY doc_id, pg, island, txt) AS f FROM i)
SELECT doc_id, pg, ln, CASE WHEN wide AND NOT txt THEN '' ELSE t END AS t FROM g WHERE NOT wide OR txt OR (n > 1 AND ln = f)""",
    "printed_pages": LINES
    + f""", e AS (SELECT *, count(*) OVER (PARTITION BY doc_id, pg) AS n, row_number() OVER (PARTITION BY doc_id, pg ORDER BY ln) AS k FROM lines),
f AS (SELECT doc_id, pg, arg_max(t, k) FILTER (k > n - 4) AS foot, arg_min(t, k) FILTER (k <= 3) AS head FROM e WHERE txt GROUP BY doc_id, pg)
SELECT doc_id, pg, coalesce(CASE WHEN regexp_matches(foot, '^{WS}*[0-9]{{1,4}}{WS}*$') THEN CAST({trim('foot')} AS INTEGER) END, CASE WHEN regexp_matches(head, '^{WS}*[0-9]{{1,4}}{WS}*$') THEN CAST({trim('head')} AS INTEGER) END) AS printed FROM f""",
    "note_candidates": LINES + CAND + " SELECT doc_id, pg, ln, note FROM cand",
    "longest_note_run": LINES
    + CAND
    + """, n AS (SELECT *, CASE WHEN note = lag(note) OVER o + 1 THEN 0 ELSE 1 END AS nw FROM cand WINDOW o AS (PARTITION BY doc_id, pg ORDER BY ln)),
r AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id, pg ORDER BY ln) AS run FROM n), k AS (SELECT doc_id, pg, min(ln) AS start_ln, count(*) AS run_len FROM r GROUP BY doc_id, pg, run)
SELECT doc_id, pg, start_ln, run_len FROM k QUALIFY row_number() OVER (PARTITION BY doc_id, pg ORDER BY run_len DESC, start_ln) = 1""",
    "heading_lines": LINES + heads("lines", "norm") + " SELECT doc_id, pg, ln, hlevel AS level, htext AS text FROM hd WHERE hlevel IS NOT NULL",
    "contents_entries": LINES
    + f""", s AS (SELECT doc_id, pg, ln, norm, regexp_matches(norm, '{LEAD}') AS leads FROM lines WHERE txt QUALIFY count(*) FILTER (regexp_matches(norm, '{LEAD}')) OVER (PARTITION BY doc_id, pg) >= 3),
e AS (SELECT *, coalesce(sum(CASE WHEN leads THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, pg ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS entry FROM s),
j AS (SELECT doc_id, pg, entry, string_agg(regexp_replace(norm, '{LEAD}', ''), ' ' ORDER BY ln) AS x, max(CASE WHEN leads THEN regexp_extract(norm, '{LEAD}', 1) END) AS page FROM e GROUP BY doc_id, pg, entry),
k AS (SELECT doc_id, pg, entry, {trim(f"regexp_replace({norm('x')}, '[.·\\s]+$', '')")} AS text, page FROM j WHERE page IS NOT NULL)
SELECT doc_id, pg, entry, text, page FROM k WHERE text <> ''""",
    "quote_lines": LINES
    + MARGIN
    + heads("lines", "norm")
    + f""", q AS (SELECT doc_id, pg, ln, txt AND hlevel IS NULL AND NOT regexp_matches(norm, '{LEAD}') AND ind >= margin + 5 AS deep FROM hd JOIN margin USING (doc_id))
SELECT doc_id, pg, ln FROM q WINDOW o AS (PARTITION BY doc_id, pg ORDER BY ln) QUALIFY deep AND (coalesce(lag(deep) OVER o, false) OR coalesce(lead(deep) OVER o, false))""",
    "suspect_matches": LINES + FOUND + "SELECT doc_id, page, pattern, place, match, context, confidence FROM found",
    "ranked_suspects": LINES + FOUND + "SELECT * FROM rk WHERE rank <= 200",
    "review_queue": LINES
    + FOUND
    + r"""SELECT doc_id, rank, '| ' || confidence || ' | ' || pattern || ' | `' || match || '` | ' || page || ' | ' || replace(context, '|', '\\|') || ' |' AS line FROM rk WHERE rank <= 200
UNION ALL SELECT result_id, -3, 'Pages: ' || pages || '  ·  Footnotes: ' || footnotes || '  ·  Auto-fixes applied: ' || auto_fixes FROM ingest_results
UNION ALL SELECT result_id, -2, '' FROM ingest_results UNION ALL SELECT result_id, -1, '| Confidence | Pattern | Text | Page | Context |' FROM ingest_results
UNION ALL SELECT result_id, 0, '| --- | --- | --- | --- | --- |' FROM ingest_results""".replace("\\\\", "\\"),
    "auto_fix": FIXED + " SELECT doc_id, x AS fixed, CAST(m AS INTEGER) AS n_matches, CAST(c AS INTEGER) AS n_changed FROM t4",
    "split_pages": RECURSIVE + FOLD + "SELECT doc_id, pg, printed, body, notes FROM page_body",
    "page_notes": RECURSIVE + FOLD + "SELECT * FROM pnotes",
    "endnotes": RECURSIVE
    + FOLD
    + """, f AS (SELECT doc_id, number, text, min(seq) AS seq FROM pnotes GROUP BY doc_id, number, text), g AS (SELECT doc_id, number, string_agg(text, ' ' ORDER BY seq) AS text, min(seq) AS first FROM f GROUP BY doc_id, number)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first) AS INTEGER) AS ord, number, text FROM g""",
    "card_quotes": BLOCKS
    + IDS
    + f""", pr AS (SELECT report_id AS report, ids.* FROM ids JOIN ingest_results ON doc_id = result_id),
m AS (SELECT quote_id, doc_id, seq, para_id, text, para_id = paragraph AS named, coalesce(match_text, '') <> '' AND contains(text, match_text) AS holds FROM share_quotes q JOIN pr USING (report)),
h AS (SELECT quote_id, arg_min({{'d': doc_id, 'p': para_id, 't': text}}, (doc_id, seq)) FILTER (named) AS a, arg_min({{'d': doc_id, 'p': para_id, 't': text}}, (doc_id, seq)) FILTER (holds) AS b FROM m GROUP BY quote_id),
o AS (SELECT quote_id, CASE WHEN a IS NOT NULL THEN 'id' WHEN b IS NOT NULL THEN 'phrase' ELSE 'none' END AS how, coalesce(a, b) AS hit, {trim(f"regexp_replace(coalesce(quote_text, coalesce(a, b).t), '{WS}+', ' ', 'g')")} AS line FROM share_quotes LEFT JOIN h USING (quote_id)),
f AS (SELECT *, {fitted('line')} AS q FROM o), w AS (SELECT *, CASE WHEN regexp_matches(q, '["“”]$') THEN q ELSE '“' || q || '”' END AS quote FROM f)
SELECT quote_id, how, hit.d AS doc_id, hit.p AS para_id, quote, CASE WHEN length(quote) > 320 THEN 34 WHEN length(quote) > 220 THEN 40 WHEN length(quote) > 130 THEN 48 ELSE 56 END AS size FROM w""",
    "section_texts": BLOCKS + SECTIONS + SECTION_TEXTS + " SELECT doc_id, i, n, slug, title, page, prev, next, text FROM sect",
    "section_of": BLOCKS
    + SECTIONS
    + SECTION_TEXTS
    + """, ask AS (SELECT DISTINCT doc_id, unnest([a, b, 'no-such-section']) AS slug FROM (SELECT doc_id, min(slug) AS a, max(slug) AS b FROM secs GROUP BY doc_id)), s AS (SELECT * FROM sect WHERE slug <> 'full')
SELECT ask.doc_id, ask.slug, CASE WHEN i IS NULL THEN 404 ELSE 200 END AS status, i, n, title, prev, next, text FROM ask LEFT JOIN s USING (doc_id, slug)""",
    "document_passage": BLOCKS
    + IDS
    + PREVIEW
    + ASKED
    + f""" SELECT asked.doc_id, asked.para_id, quote AS description, {STRIPPED} AS text FROM asked JOIN ingest_results ON asked.doc_id = result_id LEFT JOIN previews ON previews.doc_id = asked.doc_id AND previews.para_id = asked.para_id WHERE markdown IS NOT NULL""",
    "entries_only": f"SELECT result_id AS doc_id, CASE WHEN strpos(markdown, chr(10) || '---' || chr(10)) = 0 THEN markdown ELSE regexp_replace(substr(markdown, strpos(markdown, chr(10) || '---' || chr(10)) + 5), '^{WS}+', '') END AS entries FROM ingest_results",
    "sidenote_body": DEFS
    + f""", bd AS (SELECT doc_id, {BODY} AS body FROM m), sx AS (SELECT doc_id, regexp_extract_all(body, '\\[\\^([0-9]+)\\]', 1) AS r, string_split(regexp_replace(body, '\\[\\^[0-9]+\\]', chr(1), 'g'), chr(1)) AS g FROM bd),
ge AS (SELECT doc_id, unnest(g) AS gap, unnest(range(1, len(g) + 1)) AS i, unnest(list_concat(r, [NULL])) AS number FROM sx),
gd AS (SELECT ge.*, text AS note, sum(CASE WHEN text IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY ge.doc_id ORDER BY i) AS k FROM ge LEFT JOIN defs ON defs.doc_id = ge.doc_id AND defs.number = CAST(ge.number AS INTEGER)),
gp AS (SELECT *, 'sn-' || number || '-' || k AS name FROM gd)
SELECT doc_id, string_agg(gap || CASE WHEN number IS NULL THEN '' WHEN note IS NULL THEN '[^' || number || ']' ELSE '<label class="sidenote-toggle" for="' || name || '" aria-label="Note ' || number || '"><sup>' || number || '</sup></label><input class="sidenote-checkbox" id="' || name
  || '" type="checkbox" /><span class="sidenote"><sup>' || number || '</sup> ' || {escaped('note')} || '</span>' END, '' ORDER BY i) AS body, CAST(count(DISTINCT number) FILTER (note IS NOT NULL) AS INTEGER) AS used FROM gp GROUP BY doc_id""",
    "queue_by_pattern": "SELECT pattern_label, confidence, count(*) AS n, sum(seen_count) AS seen FROM suspects GROUP BY ALL",
    "front_matter": r"""
WITH f AS (SELECT result_id AS doc_id, string_split(regexp_extract(markdown, '\A---\r?\n((?s:.*?))\r?\n---\r?\n?', 1), chr(10)) AS a FROM ingest_results WHERE markdown IS NOT NULL),
x AS (SELECT doc_id, unnest(a) AS x FROM f)
SELECT doc_id, split_part(x, ': ', 1) AS key, regexp_replace(regexp_replace(substr(x, strpos(x, ': ') + 2), '^"', ''), '"$', '') AS value FROM x WHERE contains(x, ': ')""",
    "markdown_blocks": BLOCKS + "SELECT doc_id, seq, kind, level, text FROM b",
    "paragraph_ids": BLOCKS + IDS + "SELECT doc_id, seq, para_id FROM ids",
    "paragraph_pages": BLOCKS + PAGES + " SELECT doc_id, seq, page FROM pp WHERE kind = 'paragraph'",
    "overview": BLOCKS + SECTIONS + "SELECT * FROM secs",
    "section_nav": BLOCKS
    + SECTIONS
    + "SELECT doc_id, row_number() OVER o AS i, count(*) OVER (PARTITION BY doc_id) AS n, lag(slug) OVER o AS prev, slug, lead(slug) OVER o AS next FROM secs WINDOW o AS (PARTITION BY doc_id ORDER BY sec_ord)",
    "resolve": BLOCKS
    + IDS
    + SECTIONS
    + """, asked AS (SELECT DISTINCT result_id AS doc_id, paragraph AS para_id FROM share_quotes JOIN ingest_results ON report = report_id),
held AS (SELECT ids.doc_id, para_id, slug FROM ids JOIN secs ON ids.doc_id = secs.doc_id AND seq BETWEEN first_seq AND last_seq)
SELECT asked.doc_id, asked.para_id, slug, CASE WHEN slug IS NULL THEN 200 ELSE 302 END AS status FROM asked LEFT JOIN held USING (doc_id, para_id)""",
    "notes_resolution": DEFS
    + """, rc AS (SELECT doc_id, number, count(*) AS n FROM refs GROUP BY doc_id, number)
SELECT doc_id, number, CASE WHEN text IS NULL THEN 'missing' WHEN n IS NULL THEN 'orphan' ELSE 'used' END AS status, coalesce(n, 0) AS n_refs FROM defs FULL JOIN rc USING (doc_id, number)""",
    "sidenotes": DEFS
    + """, k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k, number, text FROM refs JOIN defs USING (doc_id, number))
SELECT doc_id, k, number, 'sn-' || number || '-' || k AS anchor, text FROM k""",
    "orphan_notes": DEFS + "SELECT doc_id, number, text FROM defs WHERE NOT EXISTS (SELECT 1 FROM refs WHERE refs.doc_id = defs.doc_id AND refs.number = defs.number)",
    "word_multiset": WORDS + "SELECT doc_id, coalesce(len(s), 0) AS source_words, coalesce(len(o), 0) AS output_words FROM w",
    "lossless": WORDS
    + """, v AS (SELECT DISTINCT doc_id, unnest(list_concat(s, f)) AS x FROM w WHERE s IS NOT NULL), u AS (SELECT doc_id, unnest(o) AS x FROM w),
n AS (SELECT doc_id, count(*) AS num FROM u ANTI JOIN v USING (doc_id, x) GROUP BY doc_id)
SELECT w.doc_id, CASE WHEN s IS NOT NULL THEN coalesce(num, 0) END AS num, len(o) AS den, CASE WHEN s IS NULL THEN NULL WHEN len(o) = 0 THEN false ELSE coalesce(num, 0) < len(o) * 0.001 END AS ok FROM w LEFT JOIN n USING (doc_id) WHERE o IS NOT NULL""",
    "foreign_words": WORDS
    + """, v AS (SELECT DISTINCT doc_id, unnest(list_concat(s, f)) AS x FROM w WHERE s IS NOT NULL), u AS (SELECT doc_id, unnest(o) AS x, unnest(range(len(o))) AS pos FROM w WHERE s IS NOT NULL),
a AS (SELECT * FROM u ANTI JOIN v USING (doc_id, x)), t AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) <= 5)
SELECT doc_id, string_agg(x, ' ' ORDER BY pos) AS words FROM t GROUP BY doc_id""",
    "retention": WORDS
    + "SELECT doc_id, coalesce(len(o), 0) AS num, coalesce(len(s), 0) AS den, coalesce(len(s), 0) > 0 AND coalesce(len(o), 0) > 0.9 * len(s) AND coalesce(len(o), 0) < 1.05 * len(s) AS ok FROM w",
    "structural_checks": CHECKS + "SELECT doc_id, name, ok, CAST(n AS INTEGER) AS n FROM checks",
    "html_text": f"""
WITH t AS (SELECT doc_id, text, regexp_replace(text, '<[^>]+>', '', 'g') AS bare, {trim(f"regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '{WS}+', ' ', 'g')")} AS shown FROM documents WHERE text IS NOT NULL),
u AS (SELECT *, {trim(f"regexp_replace(replace(replace(replace(replace(replace(bare, '&quot;', chr(34)), '&#39;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '{WS}+', ' ', 'g')")} AS plain FROM t)
SELECT doc_id, length(shown) AS n_chars, len(list_filter(regexp_split_to_array(plain, '{WS}+'), lambda w: w <> '')) AS words, plain, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;') AS escaped FROM u""",
    "catalog": CATALOG,
    "catalog_count": f"SELECT count(*) AS n FROM ({CATALOG})",
    "renamed_reports": """WITH a(old_id, new_id) AS (VALUES ('old-boiler-room', 'crevalby-boiler-room-001')), i AS (SELECT id FROM registry UNION ALL SELECT old_id FROM a)
SELECT id, coalesce(new_id, id) AS now_id, new_id IS NOT NULL AS moved FROM i LEFT JOIN a ON id = old_id""",
    "sitemap": BLOCKS
    + SECTIONS
    + f""", c AS ({CATALOG}), loc AS (SELECT * FROM (VALUES ('/', 1.0), ('/reports', 0.9), ('/about', 0.5), ('/changelog', 0.3)) v(path, priority) UNION ALL SELECT '/reports/' || id, 0.8 FROM c
UNION ALL SELECT '/reports/' || report_id || '/' || slug, 0.6 FROM secs JOIN ingest_results ON doc_id = result_id WHERE report_id IN (SELECT id FROM c))
SELECT DISTINCT 'https://reports.example' || path AS loc, CAST(priority AS DOUBLE) AS priority FROM loc""",
    "card_manifest": r"""WITH k AS (SELECT DISTINCT report || '/' || paragraph AS k FROM share_quotes WHERE report IS NOT NULL AND paragraph IS NOT NULL)
SELECT string_agg(k, chr(10) ORDER BY k) AS keys, CAST(count(*) AS INTEGER) AS n FROM k""",
    "resolve_url": r"""
WITH u AS (SELECT DISTINCT url, regexp_extract(url, '^([a-z]+)://([^/?#]*)([^?#]*)(\?[^#]*)?', ['scheme', 'host', 'path', 'query']) AS p FROM documents WHERE url IS NOT NULL),
o AS (SELECT *, len(list_filter(['/archive-one', '/pages', '/search', '/feed.xml'], lambda x: p.path = x OR starts_with(p.path, x || '/'))) > 0 AS old FROM u)
SELECT url, CASE WHEN starts_with(p.host, 'old.') THEN 503 WHEN starts_with(p.host, 'www.') THEN 301 WHEN old THEN 301 ELSE 200 END AS status,
CASE WHEN starts_with(p.host, 'old.') THEN NULL WHEN starts_with(p.host, 'www.') THEN p.scheme || '://' || substr(p.host, 5) || p.path || p.query WHEN old THEN p.scheme || '://old.' || p.host || p.path || p.query END AS location FROM o""",
    "json_ld": """
WITH r AS (SELECT id, title, authors, published_at, source_url, 'https://reports.example/reports/' || id AS url FROM registry)
SELECT id, '{"@context":"https://schema.org","@type":"Report"' || coalesce(',"name":' || to_json(title), '') || ',"url":' || to_json(url) || coalesce(',"author":{"@type":"Organization","name":' || to_json(authors) || '}', '')
  || coalesce(',"datePublished":' || to_json(published_at), '') || coalesce(',"isBasedOn":' || to_json(source_url), '') || '}' AS report,
'{"@type":"BreadcrumbList","itemListElement":[{"@type":"ListItem","position":1,"name":"Reports","item":"https://reports.example/reports"},{"@type":"ListItem","position":2' || coalesce(',"name":' || to_json(title), '') || ',"item":' || to_json(url) || '}]}' AS breadcrumb FROM r""",
    "verdict": CHECKS
    + ", "
    + WORDS.strip()[len("WITH ") :]
    + """, v AS (SELECT DISTINCT doc_id, unnest(list_concat(s, f)) AS x FROM w WHERE s IS NOT NULL), u AS (SELECT doc_id, unnest(o) AS x FROM w),
nn AS (SELECT doc_id, count(*) AS num FROM u ANTI JOIN v USING (doc_id, x) GROUP BY doc_id),
every AS (SELECT doc_id, ok FROM checks
  UNION ALL SELECT w.doc_id, len(o) > 0 AND coalesce(num, 0) < len(o) * 0.001 FROM w LEFT JOIN nn USING (doc_id) WHERE s IS NOT NULL AND o IS NOT NULL
  UNION ALL SELECT doc_id, len(s) > 0 AND len(o) > 0.9 * len(s) AND len(o) < 1.05 * len(s) FROM w WHERE s IS NOT NULL AND o IS NOT NULL)
SELECT doc_id, bool_and(ok) AS ok, count(*) FILTER (NOT ok) AS failed FROM every GROUP BY doc_id""",
    "verify": CHECKS
    + ", "
    + WORDS.strip()[len("WITH ") :]
    + """, v AS (SELECT DISTINCT doc_id, unnest(list_concat(s, f)) AS x FROM w WHERE s IS NOT NULL), u AS (SELECT doc_id, unnest(o) AS x FROM w),
nn AS (SELECT doc_id, count(*) AS num FROM u ANTI JOIN v USING (doc_id, x) GROUP BY doc_id),
every AS (SELECT doc_id, ok FROM checks
  UNION ALL SELECT w.doc_id, len(o) > 0 AND coalesce(num, 0) < len(o) * 0.001 FROM w LEFT JOIN nn USING (doc_id) WHERE s IS NOT NULL AND o IS NOT NULL
  UNION ALL SELECT doc_id, len(s) > 0 AND len(o) > 0.9 * len(s) AND len(o) < 1.05 * len(s) FROM w WHERE s IS NOT NULL AND o IS NOT NULL),
each AS (SELECT report_id, bool_and(ok) AS ok, count(*) FILTER (NOT ok) AS failed FROM every JOIN ingest_results ON doc_id = result_id WHERE report_id IN (SELECT id FROM registry WHERE coalesce(ingested, true)) GROUP BY report_id, doc_id)
SELECT report_id, bool_and(ok) AS ok, CAST(sum(failed) AS BIGINT) AS failed, count(*) AS volumes FROM each GROUP BY ROLLUP (report_id)""",
    "passage_preview": BLOCKS
    + IDS
    + PAGES
    + f""", card AS (SELECT DISTINCT result_id AS doc_id, paragraph AS para_id FROM share_quotes JOIN ingest_results ON report = report_id),
q0 AS (SELECT doc_id, seq, para_id, {trim(f"regexp_replace(regexp_replace(text, '\\[\\^[0-9]+\\]', '', 'g'), '{WS}+', ' ', 'g')")} AS c FROM ids),
q1 AS (SELECT *, substr(c, 1, 280) AS cut FROM q0),
q2 AS (SELECT *, CASE WHEN contains(cut, ' ') AND length(cut) - strpos(reverse(cut), ' ') > 168 THEN length(cut) - strpos(reverse(cut), ' ') ELSE 280 END AS k FROM q1)
SELECT q2.doc_id, q2.para_id, CASE WHEN length(c) <= 280 THEN c ELSE {trim('substr(cut, 1, k)')} || '…' END AS quote, page, card.doc_id IS NOT NULL AS has_card
FROM q2 LEFT JOIN pp ON q2.doc_id = pp.doc_id AND q2.seq = pp.seq LEFT JOIN card ON q2.doc_id = card.doc_id AND q2.para_id = card.para_id""",
}
