"""Queries and their DuckDB counterparts by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from ..functions import dialect
from ..functions import rules as compiler
from ..operators import agent_records, chunks, code_rules, config_rules, fences, guarded_rules, instructions, parsed, records, state, text
from ..operators import lines as line_checks
from ..sources.tables import lines, lines_around, prose_lines, table

Query = Callable[[SparkSession, str], DataFrame]


def _check(spark: SparkSession, sf_dir: str, check: text.Check) -> DataFrame:
    return text.apply(check, text.probed(table(spark, sf_dir, "documents")))


def _record(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return dialect.run(spark, sf_dir, sql)


_LINE_FRAMES = {"lines": lines, "around": lines_around, "prose": prose_lines}


def _line_frames(spark: SparkSession, sf_dir: str, sql: str) -> dict[str, DataFrame]:
    """The frames of lines that a text names."""
    documents = text.probed(table(spark, sf_dir, "documents"))
    return {name: make(documents) for name, make in _LINE_FRAMES.items() if f"{{{name}}}" in sql}


def _lines(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return dialect.run(spark, sf_dir, sql, _line_frames(spark, sf_dir, sql))


LINES_SQL = f"SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM ({text.probed_sql()}) probed"
#: The same frames from windows over lines.
LINE_FRAMES_SQL = {
    "lines": LINES_SQL,
    "around": f"SELECT doc_id, line_no, line, lag(line) OVER w AS above, lead(line) OVER w AS below, first_value(CASE WHEN trim(line) <> '' THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS head FROM ({LINES_SQL}) l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)",
    "prose": f"SELECT doc_id, line_no, line FROM (SELECT *, sum(is_fence) OVER (PARTITION BY doc_id ORDER BY line_no) % 2 AS inside FROM (SELECT *, CASE WHEN regexp_matches(line, '^[ \\t]*(?:```|~~~)') THEN 1 ELSE 0 END AS is_fence FROM ({LINES_SQL}) l) m) f WHERE inside = 0 AND is_fence = 0",
}


def _agent(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return agent_records.query(spark, sf_dir, name, **_line_frames(spark, sf_dir, agent_records.OPERATORS[name]))


def _machine(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return state.fold(state.as_events(table(spark, sf_dir, "events")), state.MACHINES[name])


#: Rules are registered twenty at a time: one pass over the documents each.
ALL_RULES = [*config_rules.RULES, *code_rules.CODE_RULES, *guarded_rules.RULES]
RULE_GROUPS = {f"rules_{i // 20 + 1:02d}": ALL_RULES[i : i + 20] for i in range(0, len(ALL_RULES), 20)}


#: The places of what checks count, where a check counts the text as it is; letters of a script are only counted.
TEXT_RULES = [compiler.Rule(f"{c.name}.{k}", patterns, "", comments=None) for c in text.CHECKS if not c.clean and not c.only and c.name != "script_mismatch" for k, patterns in c.counts.items() if "-" not in patterns]
TEXT_GROUPS = {f"findings_{i // 25 + 1:02d}": TEXT_RULES[i : i + 25] for i in range(0, len(TEXT_RULES), 25)}


def _findings(spark: SparkSession, sf_dir: str, group: list[compiler.Rule]) -> DataFrame:
    return compiler.scan(group, text.probed(table(spark, sf_dir, "documents")))


def _rules(spark: SparkSession, sf_dir: str, group: list[compiler.Rule]) -> DataFrame:
    documents = text.probed(table(spark, sf_dir, "documents"), [r.probe for r in group])
    return compiler.scan(group, documents)


def _chunks(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    out = chunks.fold(chunks.chunked(table(spark, sf_dir, "documents")), name)
    return out.drop("sha256") if name == "chunks_lines" else out


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as they are: a parser reads a whole text, which prose before a probe would only break."""
    return table(spark, sf_dir, "documents").select("doc_id", "text")


PARSED: dict[str, Query] = {
    "parsed_json": lambda spark, sf_dir: parsed.json_scan(_texts(spark, sf_dir), "doc_id", "text"),
    "parsed_json_recovery": lambda spark, sf_dir: parsed.json_recovery(_texts(spark, sf_dir), "doc_id", "text"),
    "parsed_schema_repair": lambda spark, sf_dir: parsed.schema_repair(table(spark, sf_dir, "events"), "event_id", "props", {"page": "string"}),
    "fenced_blocks": lambda spark, sf_dir: fences.extract(text.probed(table(spark, sf_dir, "documents"))),
    "parsed_event_props": lambda spark, sf_dir: parsed.json_scan(table(spark, sf_dir, "events"), "event_id", "props"),
    "parsed_tags": lambda spark, sf_dir: parsed.tag_balance(table(spark, sf_dir, "pages"), "page_id", "html"),
    "parsed_tag_probes": lambda spark, sf_dir: parsed.tag_balance(_texts(spark, sf_dir), "doc_id", "text"),
    "parsed_python": lambda spark, sf_dir: parsed.python_findings(_texts(spark, sf_dir), "doc_id", "text"),
    "parsed_cache_keys": lambda spark, sf_dir: parsed.cache_keys(table(spark, sf_dir, "events"), "event_id", "event_type", "props", "value"),
    "parsed_routes": lambda spark, sf_dir: parsed.routed(table(spark, sf_dir, "events"), "user_id", parsed.BACKENDS),
    "parsed_bootstrap": lambda spark, sf_dir: parsed.bootstrap_bands(table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id"), "source", "quality"),
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["lines_duplicate_words"](spark, sf_dir)


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {f"text_{c.name}": partial(_check, check=c) for c in text.CHECKS}
    out |= {name: partial(_record, sql=sql) for name, sql in records.QUERIES.items()}
    out |= {name: partial(_lines, sql=sql) for name, sql in line_checks.QUERIES.items()}
    out |= {name: partial(_rules, group=group) for name, group in RULE_GROUPS.items()}
    out |= {name: partial(_findings, group=group) for name, group in TEXT_GROUPS.items()}
    out |= {name: partial(_chunks, name=name) for name in chunks.MACHINES}
    out |= {name: partial(_agent, name=name) for name in agent_records.OPERATORS}
    out |= PARSED
    out["instruction_clause_conflicts"] = lambda spark, sf_dir: instructions.conflicts(table(spark, sf_dir, "conversations"))
    return out | {name: partial(_machine, name=name) for name in state.MACHINES}


def oracle_sql() -> dict[str, str]:
    out = {f"text_{c.name}": text.oracle(c) for c in text.CHECKS}
    out |= {name: compiler.scan_sql(group, text.probed_sql([r.probe for r in group])) for name, group in RULE_GROUPS.items()}
    out |= {name: compiler.scan_sql(group, text.probed_sql()) for name, group in TEXT_GROUPS.items()}
    out |= {name: dialect.oracle(sql, LINE_FRAMES_SQL) for name, sql in line_checks.QUERIES.items()}
    out |= chunks.ORACLES | state.ORACLES
    out["fenced_blocks"] = fences.oracle(text.probed_sql())
    out["parsed_json"] = "SELECT doc_id, 'invalid' AS status, 0 AS duplicate_keys, 0 AS lossy_numbers, 0 AS depth FROM documents WHERE NOT coalesce(json_valid(text), false)"
    out["parsed_cache_keys"] = "SELECT event_id, sha256('{\"context_hash\":\"' || sha256('null') || '\",\"model\":' || to_json(event_type) || ',\"prompt\":' || to_json(props) || ',\"temperature\":' || CAST(round(value, 4) AS VARCHAR) || '}') AS cache_key FROM events"
    out |= {name: agent_records.oracle(name, **LINE_FRAMES_SQL) for name in agent_records.OPERATORS}
    for name, sql in records.QUERIES.items():
        for spark_words, duckdb_words in records.DUCKDB_SPELLING.items():
            sql = sql.replace(spark_words, duckdb_words)
        out[name] = dialect.oracle(sql)
    return out
