"""Every query with SQL of its own agrees with DuckDB; the entry module keeps the driver's contract."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from siftline.plans import registry

ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v if isinstance(v, (int, bool, type(None))) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_duckdb(spark, sf, duck, name):
    ours = registry.queries()[name](spark, sf)
    columns = sorted(ours.columns)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in ours.collect()), key=str)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in cursor.fetchall()), key=str)
    assert found == expected


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_a_long_line_is_read_once(spark):
    """``no_blank_before`` took the square of a line's length: minutes for this one."""
    import time

    from siftline.operators import text

    check = next(c for c in text.CHECKS if c.name == "rule_spacing")
    rows = [(1, "ab " * 200_000), (2, "a\n***\n \t\n___\n x \n***  \n\n***\r\nb\n----\nc\n\x0b\n***\n"), (3, "x" * 300_000 + "\n***"), (4, ""), (5, None)]
    began = time.time()
    counts = [r["no_blank_before"] for r in text.apply(check, spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]
    assert time.time() - began < 30
    slow = list(check.counts["no_blank_before"])[0]
    plain = spark.createDataFrame(rows[1:2], "doc_id long, text string").selectExpr("regexp_count(text, r'" + slow + "') AS n").first()["n"]
    assert counts == [0, plain, 1, 0, None] and plain > 0
