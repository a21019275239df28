"""DuckDB SQL for the queries of this subpackage that SQL can express, written from their contracts."""

from __future__ import annotations

from .repetition import COVERAGE, LINE_COVERAGE

_WORD = r"[^\x20\x09-\x0D]+"


def repetition_sql() -> str:
    """Words of whole texts, windows of them by position, and the characters that repeated windows and lines cover."""
    windows = ", ".join(
        f"g{n} AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c, row_number() OVER (PARTITION BY r, g ORDER BY i) AS k FROM (SELECT r, i, array_to_string(ws[i:i + {n - 1}], ' ') AS g FROM spots WHERE i + {n - 1} <= len(ws)))" for n in COVERAGE
    )
    covered = ", ".join(
        f"v{n} AS (SELECT r, sum(length(ws[i])) AS chars FROM spots JOIN (SELECT DISTINCT r, i + j AS i FROM g{n}, range({n}) AS t(j) WHERE k > 1) USING (r, i) GROUP BY r)" for n in COVERAGE
    )
    shares = ", ".join(f"coalesce(v{n}.chars, 0) / greatest(word_chars, 1) AS coverage_{n}" for n in COVERAGE)
    joins = " ".join(f"LEFT JOIN v{n} ON v{n}.r = base.r" for n in COVERAGE)
    limits = " AND ".join(f"coverage_{n} <= {most}" for n, most in COVERAGE.items())
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
worded AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS ws FROM texts),
spots AS (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM worded),
{windows},
{covered},
inside AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + j AS i FROM g5, range(5) AS t(j) WHERE c > 1) GROUP BY r),
split AS (SELECT r, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM texts),
later AS (SELECT r, line, row_number() OVER (PARTITION BY r, line ORDER BY i) AS k FROM split WHERE regexp_matches(line, '{_WORD}')),
lines AS (SELECT r, count(*) AS n, sum(list_sum(list_transform(regexp_extract_all(line, '{_WORD}'), lambda x: length(x)))) AS chars FROM later WHERE k > 1 GROUP BY r),
base AS (SELECT doc_id, r, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM worded),
measured AS (SELECT base.*, coalesce(lines.n, 0) AS n_dup_lines, coalesce(inside.n, 0) AS n_repeat_words, {shares}, coalesce(lines.chars, 0) / greatest(word_chars, 1) AS line_coverage
  FROM base LEFT JOIN inside ON inside.r = base.r LEFT JOIN lines ON lines.r = base.r {joins}),
judged AS (SELECT * EXCLUDE (r), n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured)
SELECT *, NOT base_failed AND line_coverage <= {LINE_COVERAGE} AND {limits} AS kept FROM judged
"""


def jaccard_sql(n: int = 4, percent: int = 85) -> str:
    """Sets of word n-grams, links of sets that share some, and the least key that links reach."""
    return f"""
WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + {n - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {n - 1}, least(len(ws), 1)) + 1)) AS i FROM worded)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= {percent} * (p.n + q.n - c)),
reached AS (SELECT x, y FROM links UNION SELECT reached.x, links.y FROM reached JOIN links ON reached.y = links.x)
SELECT doc_id, coalesce(sizes.n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS low FROM reached GROUP BY x) USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_repetition_rules": repetition_sql(), "op6_jaccard_join": jaccard_sql()}
