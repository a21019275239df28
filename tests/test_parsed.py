"""Parsers, routing and resampling on hand-made inputs."""

import json
import random
from collections import Counter

import pytest

from siftline.operators import parsed
from siftline.plans import registry


def test_json():
    assert [parsed.scan_json(t) for t in parsed.JSON_PROBES[:3]] == [("valid", 1, 0, 1), ("valid", 0, 1, 1), ("invalid", 0, 0, 0)]
    assert parsed.scan_json('{"ok": [[]]}')[3] == 3 and parsed.scan_json(None)[0] == "invalid"
    assert parsed.recover_json("[1, 2") == ("recovered", "[1, 2]") and parsed.recover_json('{"a": 1}') == ("complete", '{"a": 1}')
    assert parsed.recover_json('{"k": {"x": [1, {"y": "z')[1] == '{"k": {"x": [1, {"y": "z"}]}}'
    assert parsed.recover_json('{"a": 1, "b')[1] == '{"a": 1}' and parsed.recover_json(None) == ("lost", None)


def test_tags():
    assert [parsed.balance_tags(t) for t in parsed.XML_PROBES] == [(0, 0, 0), (0, 1, 1), (1, 0, 0), (0, 1, 0), (0, 0, 0)]


def test_python_tree():
    found = [{k for k, _ in parsed.scan_python(t)} for t in parsed.PYTHON_PROBES]
    assert found == [{"eval_exec"}, {"bare_except"}, {"mutable_default"}, {"shell_true"}, {"blocking_in_async"}, {"syntax_error"}, {"no_timeout", "yaml_load", "pickle_load"}, set()]
    assert parsed.scan_python("eval('1')") == []


def test_routes_follow_weights_and_stay():
    routes = [parsed.route(str(i), parsed.BACKENDS) for i in range(4000)]
    assert routes == [parsed.route(str(i), parsed.BACKENDS) for i in range(4000)]
    share = Counter(routes)
    assert abs(share["alpha"] / 4000 - 5 / 8) < 0.04 and abs(share["gamma"] / 4000 - 1 / 8) < 0.03
    kept = [r for r in routes if r != "gamma"]
    assert [parsed.route(str(i), parsed.BACKENDS[:2]) for i, r in enumerate(routes) if r != "gamma"] == kept


@pytest.mark.parametrize("name", [n for n in registry.queries() if n.startswith("parsed_")])
def test_queries_run(spark, sf, name):
    rows = registry.queries()[name](spark, sf).collect()
    assert rows
    if name == "parsed_bootstrap":
        assert all(r["lower"] <= r["mean"] <= r["upper"] for r in rows)


def test_parsers_read_the_documents_texts(spark, tmp_path):
    probes = [*parsed.JSON_PROBES, *parsed.XML_PROBES, *parsed.PYTHON_PROBES, "1" + "0" * 5000, "a" + ".b()" * 3000, "plain words", None]
    texts = list(enumerate([*probes, *reversed(probes)]))  # one text under two keys: rows follow the text, not the key
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def rows(name):
        return sorted(tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).collect())

    assert rows("parsed_json") == sorted((k, *parsed.scan_json(t)) for k, t in texts)
    assert rows("parsed_json_recovery") == sorted(((k, *parsed.recover_json(t)) for k, t in texts), key=lambda r: r[0])
    assert rows("parsed_tag_probes") == sorted((k, *parsed.balance_tags(t)) for k, t in texts)
    assert rows("parsed_python") == sorted((k, *x) for k, t in texts for x in parsed.scan_python(t))
    assert parsed.scan_json("1" + "0" * 5000) == ("valid", 0, 1, 0) and parsed.scan_json(str(2**53 + 1))[2] == 1 and parsed.scan_json(str(2**60))[2] == 0


def test_parsers_read_the_tables_texts(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    found = {r["doc_id"]: tuple(r)[1:] for r in registry.queries()["parsed_json"](spark, sf).collect()}
    assert found == {k: parsed.scan_json(t) for k, t in texts.items()}
    found = {r["doc_id"]: tuple(r)[1:] for r in registry.queries()["parsed_tag_probes"](spark, sf).collect()}
    assert found == {k: parsed.balance_tags(t) for k, t in texts.items()}


def longest_closable(text):
    """Brute force: every prefix from the longest to the shortest, closed and parsed."""
    body = text.strip()
    for end in range(len(body), 0, -1):
        stack, quoted, escaped = [], False, False
        for c in body[:end]:
            if quoted:
                quoted, escaped = (c != '"') or escaped, c == "\\" and not escaped
            elif c == '"':
                quoted = True
            elif c in "{[":
                stack.append("}" if c == "{" else "]")
            elif c in "}]" and stack:
                stack.pop()
        candidate = body[:end] + '"' * quoted + "".join(reversed(stack))
        try:
            json.loads(candidate)
        except ValueError:
            continue
        return ("complete" if candidate == body else "recovered"), candidate
    return "lost", None


def test_recovery_agrees_with_brute_force():
    rng = random.Random(6)

    def value(depth):
        kind = rng.randrange(7 if depth else 5)
        if kind == 5:
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        if kind == 6:
            return {rng.choice(["k", 'q"', "", "né", "\\"]) + str(i): value(depth - 1) for i in range(rng.randrange(4))}
        return rng.choice([None, True, -0.5, 12, 1e30, "a b", 'x"y\\', "ü\n", "", float("inf")])

    texts = [*parsed.JSON_PROBES, "-", "1.", "1.5e", "01", "tru", '"a', '"\\u12', '"\\', '{"a" 1}', "[1,]", "[1}", '{"a":1,}', "{,}", '["a\nb"]', "\ufeff[]"]
    for _ in range(1500):
        t = json.dumps(value(3), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        if rng.random() < 0.5:  # one character changed
            at = rng.randrange(len(t))
            t = t[:at] + rng.choice('{}[]",:\\ 1e-.tnx') + t[at + 1 :]
        texts.append(rng.choice([t, t[: rng.randrange(len(t) + 1)], t + " and, so on {x"]))
    for t in texts:
        assert parsed.recover_json(t) == longest_closable(t), t


def test_recovery_has_no_limit_of_characters():
    prose = "That is all I found, and here is why. " * 50
    assert parsed.recover_json('{"a": [1, 2]}' + prose) == ("recovered", '{"a": [1, 2]}')
    assert parsed.recover_json('{"a": 1, "' + "k" * 5000) == ("recovered", '{"a": 1}')
    assert parsed.recover_json("[" * 100_000) == ("recovered", "[" * 100_000 + "]" * 100_000)
    assert parsed.recover_json("x" * 1_000_000) == ("lost", None)


def test_answers_are_repaired_to_a_schema():
    schema = {"name": "string", "n": "integer", "ok": "boolean"}
    good = '{"n":3,"name":"a","ok":true}'
    for text, status, actions in (
        ('{"name": "a", "n": 3, "ok": true}', "valid", ""),
        ('```json\n{"name": "a", "n": "3", "ok": true}\n```', "repaired", "strip_fence,coerce:n"),
        ("Here: {'name': 'a', 'n': 3, 'ok': True,} done", "repaired", "strip_around,trailing_commas,python_literals"),
        ('{"name": "a", "n": 3.0, "ok": "true", "more": 1}', "repaired", "coerce:n,coerce:ok,drop:more"),
        ('{\u201cname\u201d: "a", "n": 3, "ok": true', "repaired", "straight_quotes,close_open"),
    ):
        assert parsed.repair_json(text, schema) == (status, good, actions), text
    for text, actions in (("no json", "unparsable"), (None, "unparsable"), ('{"name": "a", "n": 3}', "missing:ok"), ('{"name": "a", "n": 3.5, "ok": true}', "type:n"), ('{"name": "a", "n": true, "ok": true}', "type:n")):
        assert parsed.repair_json(text, schema) == ("failed", None, actions), text


def test_unknown_imports():
    found = parsed.scan_python("import os, pandas_utils\nfrom openai_helper import x\nfrom . import y\nimport numpy.linalg")
    assert found == [("unknown_import", 1), ("unknown_import", 2)]
