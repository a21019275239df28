"""One SQL text for two engines.

Operators over records are written once in the common subset of Spark SQL and
DuckDB.  The few functions that differ are macros: ``EPOCH(x)``, ``SHA256(x)``,
``REGEX_COUNT(x, 'p')``, ``REGEX_REPLACE(x, 'p', 'r')``, ``REGEX_MATCH(x, 'p')``
and ``{table}`` for a table's name; ``upper(x)`` is DuckDB's in both.
"""

from __future__ import annotations

import re
import sys

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table


def _capitals() -> dict[str, str]:
    """The letters that DuckDB's ``upper`` changes, each to one letter; Spark's own writes some as several (ß as SS)."""
    out = {"ß": "ẞ"}
    for c in map(chr, range(sys.maxunicode + 1)):
        one = next((x for x in (c.upper(), c.title()) if len(x) == 1), c)
        if one != c:
            out.setdefault(c, one)
    return out


_CAPITALS = _capitals()

SPARK = {
    "upper": f"translate({{0}}, '{''.join(_CAPITALS)}', '{''.join(_CAPITALS.values())}')",
    "EPOCH": "unix_timestamp({0})",
    "SHA256": "sha2(CAST({0} AS STRING), 256)",
    "REGEX_COUNT": "CAST(regexp_count({0}, {1}) AS BIGINT)",
    "REGEX_REPLACE": "regexp_replace({0}, {1}, {2})",
    "REGEX_MATCH": "regexp({0}, {1})",
    "REGEX_ALL": "regexp_extract_all({0}, {1}, {2})",
    "EXPLODE": "explode({0})",
    "ITEMS": "size({0})",
    "REPEATED": "explode(transform(filter(sequence(1, size({0}) - 1), i -> lower(element_at({0}, i)) = lower(element_at({0}, i + 1))), i -> lower(element_at({0}, i))))",
    "JOINED": "array_join(transform(array_sort(collect_list(struct({0} AS n, {1} AS s))), x -> x.s), '')",
    "LIST": "collect_list({0})",
    "SORTED": "array_sort({0})",
    "AT": "element_at({0}, CAST({1} AS INT))",
    "AWAY": "transform({0}, x -> abs(x - {1}))",
    "SERIES": "sequence({0}, {1})",
    "JSON_KEYS": "coalesce(json_object_keys({0}), array())",
    "JSON_GET": "get_json_object({0}, concat('$.', {1}))",
    "JSON_VALID": "(try_parse_json({0}) IS NOT NULL)",
    "NEIGHBOURS": "explode(transform(sequence(1, size({0}) - 1), i -> concat(element_at({0}, i), chr(1), element_at({0}, i + 1))))",
}
DUCKDB = {
    "EPOCH": "CAST(floor(epoch({0})) AS BIGINT)",
    "SHA256": "sha256(CAST({0} AS VARCHAR))",
    "REGEX_COUNT": "CAST(len(regexp_extract_all({0}, {1})) AS BIGINT)",
    "REGEX_REPLACE": "regexp_replace({0}, {1}, {2}, 'g')",
    "REGEX_MATCH": "regexp_matches({0}, {1})",
    "REGEX_ALL": "regexp_extract_all({0}, {1}, {2})",
    "EXPLODE": "unnest({0})",
    "ITEMS": "len({0})",
    "REPEATED": "unnest(list_transform(list_filter(generate_series(1, len({0}) - 1), lambda i: lower({0}[i]) = lower({0}[i + 1])), lambda i: lower({0}[i])))",
    "JOINED": "string_agg({1}, '' ORDER BY {0})",
    "LIST": "list({0})",
    "SORTED": "list_sort({0})",
    "AT": "list_element({0}, CAST({1} AS INT))",
    "AWAY": "list_transform({0}, lambda x: abs(x - {1}))",
    "SERIES": "generate_series({0}, {1})",
    "JSON_KEYS": "CASE WHEN json_valid({0}) THEN json_keys({0}) ELSE [] END",
    "JSON_GET": "CASE WHEN json_valid({0}) THEN json_extract_string({0}, '$.' || {1}) END",
    "JSON_VALID": "json_valid({0})",
    "NEIGHBOURS": "unnest(list_transform(generate_series(1, len({0}) - 1), lambda i: {0}[i] || chr(1) || {0}[i + 1]))",
}


def _arguments(sql: str, at: int) -> tuple[list[str], int]:
    """The arguments of a call whose bracket opens at ``at``, and where it ends; quotes and brackets nest."""
    out, depth, begin, quoted = [], 0, at + 1, False
    for i in range(at, len(sql)):
        c = sql[i]
        if c == "'":
            quoted = not quoted
        elif not quoted and c == "(":
            depth += 1
        elif not quoted and c == ")":
            depth -= 1
            if not depth:
                return [*out, sql[begin:i].strip()], i + 1
        elif not quoted and c == "," and depth == 1:
            out.append(sql[begin:i].strip())
            begin = i + 1
    raise ValueError("a bracket is not closed")


def expand(sql: str, macros: dict[str, str]) -> str:
    """Replace macros from the innermost call outwards."""
    pattern = re.compile(r"\b(" + "|".join(macros) + r")\(")
    while found := list(pattern.finditer(sql)):
        m = found[-1]
        arguments, end = _arguments(sql, m.end() - 1)
        sql = sql[: m.start()] + macros[m[1]].format(*arguments) + sql[end:]
    return sql


def quote(text: str) -> str:
    """A literal for DuckDB."""
    return "'" + text.replace("'", "''") + "'"


def spark_quote(text: str) -> str:
    """A literal for Spark SQL, where backslashes escape."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def run(spark: SparkSession, folder: str, sql: str, frames: dict[str, DataFrame] | None = None) -> DataFrame:
    """Run a common SQL text on the tables of a folder and on ``frames``; nothing is registered in the session."""
    frames = frames or {}
    names = set(re.findall(r"\{([a-z]+)\}", sql))

    def literal(m: re.Match) -> str:  # braces of patterns are doubled, since Spark fills names in by format()
        return spark_quote(m[0][1:-1].replace("''", "'")).replace("{", "{{").replace("}", "}}")

    text = re.sub(r"'(?:[^']|'')*'", literal, expand(sql, SPARK))
    return spark.sql(text, **{n: frames[n] if n in frames else table(spark, folder, n) for n in names})


def oracle(sql: str, frames: dict[str, str] | None = None) -> str:
    """The text for DuckDB; ``frames`` are queries."""
    frames = frames or {}
    return re.sub(r"\{([a-z]+)\}", lambda m: f"({frames[m[1]]})" if m[1] in frames else m[1], expand(sql, DUCKDB))
