"""Functions of the common SQL text mean the same to both engines."""

import duckdb

from siftline.functions import dialect
from siftline.operators import agent_records


def test_upper_is_that_of_duckdb_for_every_code_point(spark):
    sql = "SELECT c, upper(t) AS t FROM {points}"
    series = "SELECT c, chr(CAST(c AS INT)) AS t FROM range(1, 1114112) r(c) WHERE c NOT BETWEEN 55296 AND 57343"
    expected = dict(duckdb.sql(dialect.oracle(sql, {"points": series})).fetchall())
    points = spark.createDataFrame([(" ".join(map(chr, range(a, min(a + 4096, 0x110000)))), a) for a in range(1, 0x110000, 4096) if not 0xD000 <= a < 0xF000], "t string, c int")
    for r in dialect.run(spark, "", sql, {"points": points}).collect():
        assert r["t"] == " ".join(expected[c] for c in range(r["c"], min(r["c"] + 4096, 0x110000))), hex(r["c"])


def test_prompt_pins_agree_on_letters_without_one_capital(spark, tmp_path):
    rows = [(5 * k, 0, "user", t) for k, t in enumerate(["Straße", "ﬁn ŉ ǰ", "ᾳ ᾼ ᾷ", "ABC", "", None, "i ı ǆ ς"])]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    found = {tuple(r) for r in agent_records.query(spark, str(tmp_path), "prompt_pins").collect()}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert found == set(c.sql(agent_records.oracle("prompt_pins")).fetchall())
