"""Tables and the row shapes that operators work on, as lazily built DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What ends a line for operators that follow universal newlines.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents_from_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Text files of a tree as documents: path and text; bytes that are not UTF-8 become U+FFFD."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("text"))


def json_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSONL log; lines that do not parse are kept in ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def lines(documents: DataFrame, key: str = "doc_id", text: str = "text", universal: bool = False) -> DataFrame:
    """Rows of (key, line_no from 1, line). No shuffle: lines stay with the split that their document was read in."""
    parts = F.split(F.col(text), LINE_BREAK if universal else "\n", -1)
    return documents.select(F.col(key), F.posexplode(parts).alias("_at", "line")).select(key, (F.col("_at") + 1).alias("line_no"), "line")


def lines_around(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of (key, line_no, line, above, below, head): each line with its neighbours (null at the ends) and the document's
    first line that is not blank.  No shuffle and no window: a document is one array of lines."""
    held = documents.select(F.col(key), F.split(F.col(text), "\n", -1).alias("_lines"))
    head = F.get(F.filter("_lines", lambda x: F.trim(x) != ""), F.lit(0))
    each = F.transform("_lines", lambda x, i: F.struct(x.alias("line"), F.get("_lines", i - 1).alias("above"), F.get("_lines", i + 1).alias("below")))
    placed = held.select(key, head.alias("head"), F.posexplode(each).alias("_at", "_x"))
    return placed.select(key, (F.col("_at") + 1).alias("line_no"), "_x.line", "_x.above", "_x.below", "head")


#: A line that opens or closes a fence.
FENCE_LINE = r"(?md)^[ \t]*(?:```|~~~)[^\n]*$"


def prose_lines(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of (key, line_no, line) for the lines outside fences, where any fence line opens or closes.

    A text is cut at its fence lines; every second piece is prose, whose first line follows from the line breaks of the
    pieces before it.  No shuffle and no window.
    """
    pieces = F.split(F.col(text), FENCE_LINE, -1)
    held = documents.select(F.col(key), pieces.alias("_pieces"))
    breaks = F.transform("_pieces", lambda x: F.length(x) - F.length(F.translate(x, "\n", "")))
    cut = held.withColumn("_breaks", breaks)
    # a document without a fence is one piece; pieces are few, so sums of those before are cheap
    before = F.transform("_pieces", lambda x, i: F.struct(x.alias("piece"), i.alias("i"), F.aggregate(F.slice("_breaks", 1, i), F.lit(0), lambda a, b: a + b).alias("breaks"), F.element_at("_breaks", i + 1).alias("own"), (F.size("_pieces") - 1).alias("last")))
    prose = cut.select(key, F.explode(F.filter(before, lambda x: x["i"] % 2 == 0)).alias("_x"))
    # a piece that follows a fence begins with that line's break, one that precedes a fence ends with a break
    each = prose.select(key, "_x.i", "_x.breaks", "_x.own", "_x.last", F.posexplode(F.split("_x.piece", "\n", -1)).alias("_at", "line"))
    kept = each.where(((F.col("i") == 0) | (F.col("_at") > 0)) & ((F.col("i") == F.col("last")) | (F.col("_at") < F.col("own"))))
    return kept.select(key, (F.col("breaks") + F.col("_at") + 1).alias("line_no"), "line")
