"""The queries that SQL can express agree with DuckDB, on the given tables and on awkward ones."""

import duckdb
import pytest

from siftline.llm import jaccard, oracles, queries, repetition


def rows_of(df, columns):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in (r[c] for c in columns)) for r in df.collect()), key=str)


def expected(con, sql, columns):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in (row[names.index(c)] for c in columns)) for row in cursor.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_tables(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    ours = queries.queries()[name](spark, sf)
    columns = sorted(ours.columns)
    assert rows_of(ours, columns) == expected(con, oracles.oracle_sql()[name], columns)


@pytest.mark.parametrize("name, run", [("op5_repetition_rules", repetition.repetition_rules), ("op6_jaccard_join", lambda df: jaccard.jaccard_components(df, n=4, percent=85))])
def test_awkward_texts(spark, name, run):
    line = "the quick brown fox jumps over the lazy dog and runs away"
    texts = [None, "", " \n\t", "one", "ONE", "one two three", "Größe ✓ #$ | #\nline a\nline a\n\nline a", line, line.upper(), (line + "\n") * 4, line + " " + line, "a b c d e " * 9, "\x0bx\x0cy z", line + "\r\n" + line + "\r\n"]
    rows = [(i, t) for i, t in enumerate(texts)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    ours = run(spark.createDataFrame(rows, "doc_id long, text string"))
    columns = sorted(ours.columns)
    assert rows_of(ours, columns) == expected(con, oracles.oracle_sql()[name], columns)
