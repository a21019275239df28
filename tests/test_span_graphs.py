"""span_graph against its SQL: repeated spans, cycles that roots reach, null ids, and more rows than Spark's recursion allows."""

import random

import duckdb
import pytest

from siftline.operators import agent_records, span_graphs


def compared(spark, rows, kinds):
    spans = spark.createDataFrame(rows, "trace_id {}, span_id {}, parent_id {}".format(*kinds))
    ours = agent_records.apply(spark, "span_graph", spans=spans)
    c = duckdb.connect()
    sql_kinds = ["VARCHAR" if k == "string" else "BIGINT" for k in kinds]
    c.execute("CREATE TABLE t (trace_id %s, span_id %s, parent_id %s)" % tuple(sql_kinds))
    if rows:
        c.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    found = c.sql(agent_records.oracle("span_graph").replace(f"({agent_records.dialect.oracle(agent_records.INPUTS['spans'])})", "t"))
    assert ours.columns == found.columns
    assert sorted(map(str, map(tuple, ours.collect()))) == sorted(map(str, found.fetchall()))


@pytest.mark.parametrize("chunk", [3, 500_000])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_as_its_sql(spark, monkeypatch, chunk, kind):
    monkeypatch.setattr(span_graphs, "CHUNK", chunk)
    rng = random.Random(5)
    name = (lambda x: x) if kind == "long" else (lambda x: None if x is None else f"s{x}")
    rows = []
    for trace in [None, *range(60)]:
        for _ in range(rng.randint(1, 9)):  # few ids, so that spans repeat; repeats on cycles would multiply the SQL's paths
            rows.append((name(trace), name(rng.choice([None, 1, 2, 3, 4, 5, 6, 7, 8])), name(rng.choice([None, None, 1, 3, 5, 7, 99]))))
    own = {}
    for t, s, p in rows:
        own.setdefault((t, s), (t, s, p))
    rows = [*own.values(), *[(name(t), name(2), None) for t in range(5)]]
    rows += [(name(70), name(k), name(k - 1) if k else None) for k in range(60)]  # deeper than the walk
    rows += [(name(71), name(1), None), (name(71), name(1), name(2)), (name(71), name(2), name(1))]  # a cycle below a root
    compared(spark, rows, (kind, kind, kind))
    compared(spark, [], (kind, kind, kind))


def test_more_rows_than_a_recursion_may_have(spark):
    few = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "100")
    try:
        rows = [(t, s, s - 1 if s else None) for t in range(50) for s in range(5)]
        compared(spark, rows, ("long", "int", "int"))
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", few)
