"""Fenced blocks as CommonMark reads them: a fold over the lines of a document, without a shuffle.

A fence opens with three or more backticks or tildes behind three blanks at
most; it closes with at least as many of the same character and nothing else, or
at the end of the text.  The info of a backtick fence holds no backtick.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPENS = r"^ {0,3}(`{3,}|~{3,})[ \t]*([^\r]*?)[ \t\r]*$"
CLOSES = r"^ {0,3}(`{3,}|~{3,})[ \t\r]*$"
_FENCE = "start_line int, marker string, info string, end_line int, terminated boolean"


def extract(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of (key, start_line, end_line, fence_char, fence_len, lang, n_body_lines, body_sha256, terminated).

    Lines count from 1; ``lang`` is the first word of the info.  A block that never closes ends with the last line.  Null
    and empty texts have no block; repeated rows each have theirs; texts are read whole.
    """
    held = documents.select(F.col(key), F.split(F.col(text), "\n", -1).alias("_lines"))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("open"), F.lit("").alias("marker"), F.lit("").alias("info"), F.array().cast(f"array<struct<{_FENCE.replace(' int', ':int').replace(' string', ':string').replace(' boolean', ':boolean')}>>").alias("found"))

    def step(acc: Column, line: Column) -> Column:
        at = acc["at"] + 1
        mark, info = F.regexp_extract(line, OPENS, 1), F.regexp_extract(line, OPENS, 2)
        opens = (acc["open"] == 0) & (mark != "") & ~((F.substring(mark, 1, 1) == "`") & info.contains("`"))
        end = F.regexp_extract(line, CLOSES, 1)
        closes = (acc["open"] > 0) & (end != "") & (F.substring(end, 1, 1) == F.substring(acc["marker"], 1, 1)) & (F.length(end) >= F.length(acc["marker"]))
        block = F.struct(acc["open"].alias("start_line"), acc["marker"].alias("marker"), acc["info"].alias("info"), at.alias("end_line"), F.lit(True).alias("terminated"))
        return F.struct(
            at.alias("at"),
            F.when(closes, 0).when(opens, at).otherwise(acc["open"]).alias("open"),
            F.when(opens, mark).otherwise(acc["marker"]).alias("marker"),
            F.when(opens, info).otherwise(acc["info"]).alias("info"),
            F.when(closes, F.array_append(acc["found"], block)).otherwise(acc["found"]).alias("found"),
        )

    def finish(acc: Column) -> Column:
        block = F.struct(acc["open"].alias("start_line"), acc["marker"].alias("marker"), acc["info"].alias("info"), acc["at"].alias("end_line"), F.lit(False).alias("terminated"))
        return F.when(acc["open"] > 0, F.array_append(acc["found"], block)).otherwise(acc["found"])

    placed = held.select(key, "_lines", F.explode(F.aggregate("_lines", start, step, finish)).alias("_x"))
    n_body = F.col("_x.end_line") - F.col("_x.start_line") - F.col("_x.terminated").cast("int")
    body = F.when(n_body > 0, F.array_join(F.slice("_lines", F.col("_x.start_line") + 1, n_body), "\n")).otherwise(F.lit(""))
    return placed.select(
        key,
        "_x.start_line",
        "_x.end_line",
        F.substring("_x.marker", 1, 1).alias("fence_char"),
        F.length("_x.marker").alias("fence_len"),
        F.regexp_extract("_x.info", r"^([^ \t]*)", 1).alias("lang"),
        n_body.alias("n_body_lines"),
        F.sha2(body, 256).alias("body_sha256"),
        "_x.terminated",
    )


def oracle(documents: str) -> str:
    """The same from DuckDB, line by line; ``documents`` is a query of (doc_id, text)."""
    opens, closes = OPENS.replace("'", "''"), CLOSES.replace("'", "''")
    mark, end = f"regexp_extract(d.lines[r.pos + 1], '{opens}', 1)", f"regexp_extract(d.lines[r.pos + 1], '{closes}', 1)"
    does_open = f"(r.open = 0 AND {mark} <> '' AND NOT ({mark}[1] = '`' AND contains(regexp_extract(d.lines[r.pos + 1], '{opens}', 2), '`')))"
    does_close = f"(r.open > 0 AND {end} <> '' AND {end}[1] = r.marker[1] AND length({end}) >= length(r.marker))"
    return f"""WITH RECURSIVE docs AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM ({documents}) t WHERE text IS NOT NULL),
r AS (SELECT doc_id, 0 AS pos, 0 AS open, '' AS marker, '' AS info, 0 AS closed_from, '' AS closed_marker, '' AS closed_info FROM docs
UNION ALL SELECT d.doc_id, r.pos + 1, CASE WHEN {does_close} THEN 0 WHEN {does_open} THEN r.pos + 1 ELSE r.open END, CASE WHEN {does_open} THEN {mark} ELSE r.marker END, CASE WHEN {does_open} THEN regexp_extract(d.lines[r.pos + 1], '{opens}', 2) ELSE r.info END,
  CASE WHEN {does_close} THEN r.open ELSE 0 END, r.marker, r.info FROM r JOIN docs d ON r.doc_id = d.doc_id WHERE r.pos < len(d.lines)),
blocks AS (SELECT doc_id, closed_from AS start_line, pos AS end_line, closed_marker AS marker, closed_info AS info, true AS terminated FROM r WHERE closed_from > 0
UNION ALL SELECT r.doc_id, r.open, r.pos, r.marker, r.info, false FROM r JOIN docs d ON r.doc_id = d.doc_id AND r.pos = len(d.lines) WHERE r.open > 0)
SELECT b.doc_id, start_line, end_line, marker[1] AS fence_char, CAST(length(marker) AS INTEGER) AS fence_len, regexp_extract(info, '^([^ \\t]*)', 1) AS lang, CAST(end_line - start_line - terminated::INT AS INTEGER) AS n_body_lines,
  sha256(array_to_string(d.lines[start_line + 1:end_line - terminated::INT], chr(10))) AS body_sha256, terminated FROM blocks b JOIN docs d ON b.doc_id = d.doc_id"""
