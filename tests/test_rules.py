"""Each rule flags its probe, leaves clean text alone, and stays silent where consent is given."""

from collections import Counter

import duckdb

from siftline.functions.rules import Rule, _all_findings, scan, scan_sql
from siftline.plans.registry import ALL_RULES as RULES
from siftline.plans.registry import RULE_GROUPS

CLEAN = "A plain paragraph about rivers and towns.\nIt has two lines and no settings at all."


def found(spark, rules, text):
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return Counter(r["rule"] for r in scan(rules, rows).collect())


def flagged(rules, texts):
    """Names of the rules that flag their own text, by DuckDB; that Spark finds the same is tested with the queries."""
    con = duckdb.connect()
    out = []
    for rule, text in zip(rules, texts, strict=True):
        con.execute("CREATE OR REPLACE TABLE t AS SELECT 1 AS doc_id, ?::VARCHAR AS text", [text])
        if con.execute(scan_sql([rule], "SELECT * FROM t")).fetchall():
            out.append(rule.name)
    return out


def test_probes_are_flagged():
    assert flagged(RULES, [r.probe for r in RULES]) == [r.name for r in RULES]


def test_clean_counterparts_are_left_alone(spark):
    rules = [r for r in RULES if r.clean]
    assert len(rules) > 150 and flagged(rules, [r.clean for r in rules]) == []
    rows = spark.createDataFrame([(i, r.clean) for i, r in enumerate(rules[:40])], "doc_id long, text string")
    hits = {(r["doc_id"], r["rule"]) for r in scan(rules[:40], rows).collect()}
    assert [r.name for i, r in enumerate(rules[:40]) if (i, r.name) in hits] == []


def test_findings_are_located(spark):
    rule = Rule("r", (r"(?m)^open = yes$", r"bad\s+thing"), "", needed=("password",))
    text = "a\nopen = yes\n\n  x bad thing, bad\nthing\n# a comment\nopen = yes"
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    out = sorted((r["line_no"], r["col"], r["kind"], r["detail"]) for r in scan([rule], rows).collect())
    assert out == [(0, 0, "missing", ""), (2, 1, "found", "open = yes"), (4, 5, "found", "bad thing"), (4, 16, "found", "bad"), (7, 1, "found", "open = yes")]


def test_guards_and_consent_in_comments(spark):
    rule = Rule("r", (r"(?m)open = yes",), "", unless=("guarded",))
    for text, n in (("open = yes", 1), ("open = yes\nguarded", 0), ("open = yes  # open-door-ok\nopen = yes", 1), ("# open-door-ok\nopen = yes", 0), ("open = yes\n// open-door-allowed", 0), ("open = yes\nit is ok", 1), ("open = yes\nnot-allowed", 1), ("# guarded\nopen = yes", 1)):
        assert found(spark, [rule], text)["r"] == n, text


def test_clean_text_is_left_alone():
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT 1 AS doc_id, ?::VARCHAR AS text", [CLEAN])
    assert con.execute(scan_sql(RULES, "SELECT * FROM t")).fetchall() == []


def test_consent_gate_comment_and_absence(spark):
    rule = Rule("r", (r"(?m)^open = yes$",), "open = yes", gate="server", needed=("password",), consent="open-ok")
    assert found(spark, [rule], "server\nopen = yes") == {"r": 2}
    assert found(spark, [rule], "server\nopen = yes\npassword x") == {"r": 1}
    assert found(spark, [rule], "server\n# open-ok\nopen = yes") == {}
    assert found(spark, [rule], "open = yes") == {}
    assert found(spark, [rule], "server\n# open = yes\npassword") == {}


def test_null_and_empty_documents(spark):
    rows = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert scan(RULES[:3], rows).collect() == []


def test_alike_rules_are_matched_once(spark):
    """Rules that differ in names only share their matches, all of one kind of comments share its removal, and each rule
    finds what it finds alone."""
    group = RULE_GROUPS["rules_14"]
    assert _all_findings(group).count("regexp_replace(_text") == len({r.comments for r in group})
    texts = [r.probe for r in group] + ["eval $x\n# eval $y\n'eval $z'\n; eval `q`", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    together = sorted(map(tuple, scan(group, rows).collect()))
    assert {x[1] for x in together} == {r.name for r in group}
    for r in group[::4]:
        assert [x for x in together if x[1] == r.name] == sorted(map(tuple, scan([r], rows).collect()))
