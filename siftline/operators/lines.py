"""Checks that follow lines, items, keys and labels through a document: SQL over the rows (doc_id, line_no, line).

The rows are made without a shuffle (``sources.tables``): {lines}, {around} (with
neighbours) and {prose} (outside fences).  Windows are partitioned by document
and see only the lines that they are about: headings, items, keys.
"""

from __future__ import annotations

#: Lines outside fences come from ``prose_lines``; for DuckDB, they are told by the parity of the fence lines above.
_FENCES = "prose AS (SELECT doc_id, line_no, line FROM {prose} src)"

QUERIES: dict[str, str] = {}

QUERIES["lines_duplicate_words"] = (
    "WITH "
    + _FENCES
    + r""",
cleaned AS (SELECT doc_id, line_no, REGEX_REPLACE(line, '`[^`]*`', ' ') AS line FROM prose),
tokens AS (SELECT doc_id, line_no, REGEX_ALL(line, '([A-Za-z]+(?:''[A-Za-z]+)?|[^A-Za-z \t]+)', 1) AS words FROM cleaned),
repeats AS (SELECT doc_id, line_no, REPEATED(words) AS word FROM tokens WHERE ITEMS(words) > 1)
SELECT doc_id, line_no, word, count(*) AS n FROM repeats
WHERE REGEX_MATCH(word, '^[a-z]') AND word NOT IN ('that', 'is', 'blah', 'yada', 'ha', 'bye', 'had', 'no', 'very')
GROUP BY doc_id, line_no, word"""
)

QUERIES["lines_heading_levels"] = (
    "WITH "
    + _FENCES
    + r""",
headings AS (SELECT doc_id, line_no, length(line) - length(REGEX_REPLACE(line, '^#+', '')) AS level, trim(lower(REGEX_REPLACE(line, '^#+[ \t]*|[ \t]*#*[ \t]*$', ''))) AS title FROM prose WHERE REGEX_MATCH(line, '^#{1,6}(?:[ \t]|$)')),
steps AS (SELECT doc_id, line_no, level, title, lag(level) OVER (PARTITION BY doc_id ORDER BY line_no) AS before, lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS line_before, count(*) OVER (PARTITION BY doc_id, level, title) AS same FROM headings)
SELECT doc_id, count(*) AS n_headings, CAST(sum(CASE WHEN level - before > 1 THEN 1 ELSE 0 END) AS BIGINT) AS skips, CAST(sum(CASE WHEN before IS NULL AND level > 1 THEN 1 ELSE 0 END) AS BIGINT) AS no_root, CAST(sum(CASE WHEN line_before = line_no - 1 THEN 1 ELSE 0 END) AS BIGINT) AS adjacent, CAST(sum(CASE WHEN same > 1 THEN 1 ELSE 0 END) AS BIGINT) AS duplicates, CAST(sum(CASE WHEN title = '' THEN 1 ELSE 0 END) AS BIGINT) AS empty FROM steps GROUP BY doc_id"""
)

QUERIES["lines_ordered_lists"] = (
    "WITH "
    + _FENCES
    + r""",
items AS (SELECT doc_id, line_no, TRY_CAST(nullif(regexp_extract(line, '^[ \t]*([0-9]+)[.)][ \t]', 1), '') AS BIGINT) AS n, CASE WHEN REGEX_MATCH(line, '^[ \t]*$') THEN 1 ELSE 0 END AS blank FROM prose),
numbered AS (SELECT doc_id, line_no, n, lag(n) OVER (PARTITION BY doc_id ORDER BY line_no) AS before, lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS line_before FROM items WHERE n IS NOT NULL)
SELECT doc_id, count(*) AS n_items, CAST(sum(CASE WHEN n > before + 1 AND line_no - line_before <= 2 THEN 1 ELSE 0 END) AS BIGINT) AS gaps, CAST(sum(CASE WHEN n = before THEN 1 ELSE 0 END) AS BIGINT) AS duplicates, CAST(sum(CASE WHEN n < before AND n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS decreases, CAST(sum(CASE WHEN n = 1 AND before > 1 AND line_no - line_before <= 3 THEN 1 ELSE 0 END) AS BIGINT) AS restarts FROM numbered GROUP BY doc_id"""
)

QUERIES["lines_link_labels"] = (
    "WITH "
    + _FENCES
    + r""",
uses AS (SELECT doc_id, EXPLODE(REGEX_ALL(line, '\[[^\]]+\]\[([^\]]+)\]', 1)) AS label FROM prose),
defs AS (SELECT doc_id, regexp_extract(line, '^ {0,3}\[([^\]^][^\]]*)\]:', 1) AS label FROM prose WHERE REGEX_MATCH(line, '^ {0,3}\[[^\]^][^\]]*\]:')),
used AS (SELECT doc_id, lower(trim(label)) AS label, count(*) AS n_used, min(label) AS spelled FROM uses GROUP BY doc_id, lower(trim(label))),
defined AS (SELECT doc_id, lower(trim(label)) AS label, count(*) AS n_defined, min(label) AS spelled FROM defs GROUP BY doc_id, lower(trim(label)))
SELECT coalesce(u.doc_id, d.doc_id) AS doc_id, coalesce(u.label, d.label) AS label, CASE WHEN d.label IS NULL THEN 'undefined' WHEN u.label IS NULL THEN 'unused' WHEN d.n_defined > 1 THEN 'duplicate' WHEN u.spelled <> d.spelled THEN 'case_mismatch' ELSE 'ok' END AS kind FROM used u FULL OUTER JOIN defined d ON u.doc_id = d.doc_id AND u.label = d.label"""
)

QUERIES["lines_footnotes"] = (
    "WITH "
    + _FENCES
    + r""",
uses AS (SELECT doc_id, EXPLODE(REGEX_ALL(REGEX_REPLACE(line, '^\[\^[^\]]+\]:', ''), '\[\^([^\]]+)\]', 1)) AS label FROM prose),
defs AS (SELECT doc_id, regexp_extract(line, '^\[\^([^\]]+)\]:', 1) AS label FROM prose WHERE REGEX_MATCH(line, '^\[\^[^\]]+\]:')),
used AS (SELECT doc_id, label, count(*) AS n FROM uses GROUP BY doc_id, label),
defined AS (SELECT doc_id, label, count(*) AS n FROM defs GROUP BY doc_id, label)
SELECT coalesce(u.doc_id, d.doc_id) AS doc_id, coalesce(u.label, d.label) AS label, CASE WHEN d.label IS NULL THEN 'missing_definition' WHEN u.label IS NULL THEN 'orphan_definition' WHEN d.n > 1 THEN 'duplicate_definition' ELSE 'ok' END AS kind FROM used u FULL OUTER JOIN defined d ON u.doc_id = d.doc_id AND u.label = d.label"""
)

QUERIES["lines_anchor_links"] = (
    "WITH "
    + _FENCES
    + r""",
slugs AS (SELECT DISTINCT doc_id, REGEX_REPLACE(REGEX_REPLACE(trim(lower(REGEX_REPLACE(line, '^#+[ \t]*|[ \t]*#*[ \t]*$', ''))), '[^a-z0-9 _-]', ''), ' ', '-') AS slug FROM prose WHERE REGEX_MATCH(line, '^#{1,6}[ \t]')),
links AS (SELECT doc_id, EXPLODE(REGEX_ALL(line, '\]\(#([^)]+)\)', 1)) AS slug FROM prose)
SELECT l.doc_id, l.slug, count(*) AS n, s.slug IS NULL AS undefined FROM links l LEFT JOIN slugs s ON l.doc_id = s.doc_id AND l.slug = s.slug GROUP BY l.doc_id, l.slug, s.slug"""
)

QUERIES["lines_table_columns"] = (
    "WITH "
    + _FENCES
    + r""",
cells AS (SELECT doc_id, line_no, REGEX_COUNT(REGEX_REPLACE(trim(line), '^\||\|$|\\\|', ''), '\|') + 1 AS n, CASE WHEN REGEX_MATCH(line, '^[ \t]*\|?(?:[ \t]*:?-+:?[ \t]*\|)+') THEN 1 ELSE 0 END AS is_rule FROM prose WHERE REGEX_MATCH(line, '^[ \t]*\|')),
islands AS (SELECT doc_id, line_no, n, is_rule, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM cells),
headed AS (SELECT doc_id, island, line_no, n, is_rule, first_value(n) OVER (PARTITION BY doc_id, island ORDER BY line_no) AS header FROM islands)
SELECT doc_id, island, count(*) AS n_rows, max(header) AS n_columns, CAST(sum(CASE WHEN n <> header THEN 1 ELSE 0 END) AS BIGINT) AS ragged_rows, max(is_rule) = 0 AS no_delimiter FROM headed GROUP BY doc_id, island"""
)

QUERIES["lines_blank_around"] = r"""WITH marked AS (SELECT doc_id, line_no, line, above, below FROM {around} src)
SELECT doc_id, CAST(sum(CASE WHEN REGEX_MATCH(line, '^#{1,6} ') AND trim(above) <> '' THEN 1 ELSE 0 END) AS BIGINT) AS heading_no_blank_before, CAST(sum(CASE WHEN REGEX_MATCH(line, '^#{1,6} ') AND trim(below) <> '' AND NOT REGEX_MATCH(below, '^#') THEN 1 ELSE 0 END) AS BIGINT) AS heading_no_blank_after, CAST(sum(CASE WHEN REGEX_MATCH(line, '^(?:```|~~~)[A-Za-z]') AND trim(above) <> '' THEN 1 ELSE 0 END) AS BIGINT) AS fence_no_blank_before, CAST(sum(CASE WHEN REGEX_MATCH(line, '^(?:```|~~~)$') AND trim(below) <> '' THEN 1 ELSE 0 END) AS BIGINT) AS fence_no_blank_after, CAST(sum(CASE WHEN REGEX_MATCH(line, '^(?:=+|-+)$') AND trim(above) <> '' AND length(trim(line)) <> length(trim(above)) THEN 1 ELSE 0 END) AS BIGINT) AS underline_length FROM marked GROUP BY doc_id"""

_DEPTH = "REGEX_COUNT(regexp_extract({0}, '^((?:[ ]{{0,3}}>)*)', 1), '>')"
QUERIES["lines_quote_depth"] = f"""WITH steps AS (SELECT doc_id, {_DEPTH.format('line')} AS depth, CASE WHEN above IS NOT NULL THEN {_DEPTH.format('coalesce(above, line)')} END AS before FROM {{around}} src)
SELECT doc_id, CAST(max(depth) AS BIGINT) AS max_depth, CAST(sum(CASE WHEN depth - before > 1 THEN 1 ELSE 0 END) AS BIGINT) AS jumps, max(depth) > 3 AS too_deep FROM steps GROUP BY doc_id"""

QUERIES["lines_repeated"] = r"""WITH counted AS (SELECT doc_id, trim(line) AS line, count(*) AS n FROM {lines} src WHERE length(trim(line)) > 20 GROUP BY doc_id, trim(line))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS repeated, max(n) AS most FROM counted GROUP BY doc_id"""

QUERIES["lines_identical_sentences"] = r"""WITH split AS (SELECT doc_id, REGEX_ALL(line, '([^.!?]+[.!?]*)', 1) AS sentences FROM {lines} src),
places AS (SELECT doc_id, NEIGHBOURS(sentences) AS pair FROM split WHERE ITEMS(sentences) > 1),
pairs AS (SELECT doc_id, trim(split_part(pair, chr(1), 1)) AS a, trim(split_part(pair, chr(1), 2)) AS b FROM places)
SELECT doc_id, CAST(sum(CASE WHEN a = b THEN 1 ELSE 0 END) AS BIGINT) AS exact_repeat, CAST(sum(CASE WHEN a <> b AND lower(a) = lower(b) THEN 1 ELSE 0 END) AS BIGINT) AS case_repeat, count(*) AS n_pairs FROM pairs GROUP BY doc_id"""

QUERIES["lines_sentence_lengths"] = r"""WITH sentences AS (SELECT doc_id, EXPLODE(REGEX_ALL(line, '([^.!?]+[.!?]*)', 1)) AS sentence FROM {lines} src),
sized AS (SELECT doc_id, REGEX_COUNT(sentence, '[^ \t]+') AS n FROM sentences),
mean AS (SELECT doc_id, median(n) AS mid, count(*) AS n_sentences FROM sized GROUP BY doc_id)
SELECT m.doc_id, m.n_sentences, CAST(sum(CASE WHEN s.n < 3 THEN 1 ELSE 0 END) AS BIGINT) AS short_sentence, CAST(sum(CASE WHEN s.n > 40 THEN 1 ELSE 0 END) AS BIGINT) AS long_sentence, CAST(sum(CASE WHEN s.n > 3 * m.mid THEN 1 ELSE 0 END) AS BIGINT) AS outlier_sentence FROM sized s JOIN mean m ON s.doc_id = m.doc_id GROUP BY m.doc_id, m.n_sentences"""

QUERIES["lines_sections_and_keys"] = r"""WITH marked AS (SELECT doc_id, line_no, line, CASE WHEN REGEX_MATCH(line, '^\[[^\]]+\][ \t]*$') THEN 1 ELSE 0 END AS is_section FROM {lines} src),
placed AS (SELECT doc_id, line_no, line, is_section, sum(is_section) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM marked WHERE REGEX_MATCH(line, '^\[[^\]]+\][ \t]*$|^[ \t]*[A-Za-z_][A-Za-z0-9_.-]*[ \t]*[=:]')),
keys AS (SELECT doc_id, CAST(section AS BIGINT) AS section, trim(regexp_extract(line, '^[ \t]*([A-Za-z_][A-Za-z0-9_.-]*)[ \t]*[=:]', 1)) AS name FROM placed WHERE is_section = 0),
sections AS (SELECT doc_id, CAST(0 AS BIGINT) AS section, trim(line) AS name FROM placed WHERE is_section = 1)
SELECT doc_id, section, name, count(*) AS n FROM (SELECT * FROM keys UNION ALL SELECT * FROM sections) x WHERE name <> '' GROUP BY doc_id, section, name HAVING count(*) > 1"""

QUERIES["lines_csv_columns"] = r"""WITH rows_ AS (SELECT doc_id, line_no, REGEX_COUNT(REGEX_REPLACE(line, '"[^"]*"', ''), ',') + 1 AS n, REGEX_COUNT(REGEX_REPLACE(head, '"[^"]*"', ''), ',') + 1 AS header FROM {around} src WHERE trim(line) <> ''),
headed AS (SELECT doc_id, n, header FROM rows_)
SELECT doc_id, count(*) AS n_rows, max(header) AS n_columns, CAST(sum(CASE WHEN n <> header THEN 1 ELSE 0 END) AS BIGINT) AS inconsistent FROM headed GROUP BY doc_id"""

QUERIES["lines_paren_depth"] = r"""WITH steps AS (SELECT doc_id, line_no, REGEX_COUNT(line, '[(]') - REGEX_COUNT(line, '[)]') AS step FROM {lines} src WHERE REGEX_MATCH(line, '[()]')),
depth AS (SELECT doc_id, line_no, sum(step) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS depth FROM steps)
SELECT doc_id, CAST(max(depth) AS BIGINT) AS deepest, CAST(min(depth) AS BIGINT) AS lowest, min(depth) < 0 AS unmatched_close FROM depth GROUP BY doc_id"""

QUERIES["lines_comments_near"] = r"""WITH hits AS (SELECT doc_id, line_no, CASE WHEN REGEX_MATCH(line, '(?i)user(?:name)?[ \t]*[:=]') THEN 1 ELSE 0 END AS has_user, CASE WHEN REGEX_MATCH(line, '(?i)pass(?:word)?[ \t]*[:=]|"password"') THEN 1 ELSE 0 END AS has_pass FROM {lines} src WHERE REGEX_MATCH(line, '(?i)user(?:name)?[ \t]*[:=]|pass(?:word)?[ \t]*[:=]|"password"')),
near AS (SELECT doc_id, line_no, has_pass, max(has_user) OVER (PARTITION BY doc_id ORDER BY line_no RANGE BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS user_near FROM hits)
SELECT doc_id, CAST(sum(has_pass) AS BIGINT) AS passwords, CAST(sum(has_pass * user_near) AS BIGINT) AS pairs FROM near GROUP BY doc_id"""

# shares that should add up: items of one list with one share each, and lines that list three or more
QUERIES["lines_percent_groups"] = r"""WITH shares AS (SELECT doc_id, line_no, REGEX_MATCH(line, '^[ \t]*(?:[-*+]|[0-9]+[.)])[ \t]+') AS bullet, REGEX_COUNT(line, '[,;]') AS seps, EXPLODE(REGEX_ALL(line, '(?:^|[^A-Za-z0-9_.])([0-9]{1,3}(?:[.][0-9]+)?)[ \t]*%', 1)) AS share FROM {lines} src WHERE contains(line, '%')),
summed AS (SELECT doc_id, line_no, bullet, seps, count(*) AS n, sum(CAST(share AS DOUBLE)) AS total FROM shares GROUP BY doc_id, line_no, bullet, seps),
islands AS (SELECT doc_id, line_no, total, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM summed WHERE bullet AND n = 1),
groups_ AS (SELECT doc_id, 'bullet_list' AS kind, min(line_no) AS first_line, count(*) AS n, sum(total) AS total FROM islands GROUP BY doc_id, island HAVING count(*) >= 2
UNION ALL SELECT doc_id, 'inline' AS kind, line_no AS first_line, n, total FROM summed WHERE NOT bullet AND n >= 3 AND seps >= n - 1)
SELECT doc_id, kind, first_line, n, round(total, 4) AS total, CASE WHEN abs(total - 100) <= 1.0 THEN 'sums_to_100' WHEN total > 100 THEN 'above' ELSE 'below' END AS verdict FROM groups_"""
