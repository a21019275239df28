"""Operators that need a real parser, a keyed hash or resampling: Arrow-batched Pandas UDFs over one column.

Each is a scalar function of a row's text, so there is no shuffle; what they
return is a struct that native columns go on with.
"""

from __future__ import annotations

import ast
import hashlib
import json
import math
import re
import sys

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tags without an end tag.
_VOID = set("area base br col embed hr img input link meta source track wbr".split())


def scan_json(text: str | None) -> tuple[str, int, int, int]:
    """Status, duplicate names within one object, numbers that a double cannot hold, and depth."""
    duplicates, lossy = 0, 0

    def pairs(items):
        nonlocal duplicates
        out = dict(items)
        duplicates += len(items) - len(out)
        return out

    def whole(digits: str):
        nonlocal lossy
        value = float(digits)  # of any length, where int() and float(int) give up on long ones
        lossy += math.isinf(value) or abs(value) >= 2**53 and int(value) != int(digits)
        return value

    def depth(value) -> int:
        below = value.values() if isinstance(value, dict) else value if isinstance(value, list) else None
        return 0 if below is None else 1 + max(map(depth, below), default=0)

    try:
        value = json.loads(text or "", object_pairs_hook=pairs, parse_int=whole)
        return "valid", duplicates, lossy, depth(value)
    except (ValueError, RecursionError):
        return "invalid", 0, 0, 0


#: Tokens of JSON as ``json.loads`` reads them: a string without its end quote, and numbers and names.
_BLANKS = re.compile(r"[ \t\n\r]*")
_STRING = re.compile(r'"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*+')
_SCALAR = re.compile(r"true|false|null|NaN|-?Infinity|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")


def recover_json(text: str | None) -> tuple[str, str | None]:
    """Close what a cut-off JSON text left open: status (complete, recovered, lost) and the text that parses.

    One scan from the left finds the longest prefix that closing an open string value and the open brackets makes
    whole, however much follows it.
    """
    body = (text or "").strip()
    stack: list[str] = []
    at, safe, quote, want = 0, 0, "", "value"
    while True:
        at = _BLANKS.match(body, at).end()
        if want in ("first_key", "first_value", "after"):  # brackets change only where the cut moves with them
            safe = at
        c = body[at : at + 1]
        if want == "after":
            if stack and c == ",":
                want = "key" if stack[-1] == "}" else "value"
            elif stack and c == stack[-1]:
                stack.pop()
            else:
                break
            at += 1
        elif want == "colon":
            if c != ":":
                break
            at, want = at + 1, "value"
        elif c == '"':
            at = _STRING.match(body, at).end()
            closed = body[at : at + 1] == '"'
            if not closed:
                if want in ("value", "first_value"):
                    safe, quote = at, '"'
                break
            at, want = at + 1, "colon" if want in ("key", "first_key") else "after"
        elif want in ("first_key", "first_value") and c == stack[-1]:
            stack.pop()
            at, want = at + 1, "after"
        elif want in ("key", "first_key"):
            break
        elif c in ("{", "["):
            stack.append("}" if c == "{" else "]")
            at, want = at + 1, "first_key" if c == "{" else "first_value"
        elif m := _SCALAR.match(body, at):
            at, want = m.end(), "after"
        else:
            break
    if not safe:
        return "lost", None
    candidate = body[:safe] + quote + "".join(reversed(stack))
    return ("complete" if candidate == body else "recovered"), candidate


def repair_json(text: str | None, schema: dict[str, str]) -> tuple[str, str | None, str]:
    """Bring an answer to a flat schema (name -> string, integer, number or boolean): status (valid, repaired, failed), the
    object as canonical JSON, and the actions taken, in order.

    In turn: fences and what stands around the outer braces go, curly quotes become straight, Python's names and single
    quotes become JSON's, commas before a closing bracket go, what is cut off is closed; then extras are dropped and values
    coerced.  A required name that is missing, or a value that cannot be coerced, fails.
    """
    body, actions = (text or "").strip(), []

    def parse(candidate: str):
        try:
            value = json.loads(candidate)
        except (ValueError, RecursionError):
            return None
        return value if isinstance(value, dict) else None

    def literal(candidate: str) -> str:
        try:
            value = ast.literal_eval(candidate)
            return json.dumps(value) if isinstance(value, dict) else candidate
        except (ValueError, SyntaxError, RecursionError, MemoryError, TypeError):
            return candidate

    steps = (
        ("strip_fence", lambda x: re.sub(r"^```[A-Za-z]*\s*\n|\n?```\s*$", "", x)),
        ("strip_around", lambda x: x[x.find("{") : x.rfind("}") + 1] if 0 <= x.find("{") < x.rfind("}") else x),
        ("straight_quotes", lambda x: re.sub("[\u201c\u201d]", '"', re.sub("[\u2018\u2019]", "'", x))),
        ("trailing_commas", lambda x: re.sub(r",(\s*[}\]])", r"\1", x)),
        ("python_literals", literal),
        ("close_open", lambda x: recover_json(x)[1] or x),
    )
    value = parse(body)
    for name, step in steps:
        if value is not None:
            break
        after = step(body)
        if after != body:
            body = after
            actions.append(name)
            value = parse(body)
    if value is None:
        return "failed", None, ",".join([*actions, "unparsable"])
    out = {}
    for name, kind in schema.items():
        if name not in value:
            return "failed", None, ",".join([*actions, f"missing:{name}"])
        v = value[name]
        try:
            if kind == "string":
                fit = v if isinstance(v, str) else json.dumps(v)
            elif kind == "boolean":
                fit = v if isinstance(v, bool) else {"true": True, "false": False, "1": True, "0": False}[str(v).strip().lower()]
            else:
                number = float(v) if not isinstance(v, bool) else math.nan
                fit = v if isinstance(v, int if kind == "integer" else (int, float)) and not isinstance(v, bool) else int(number) if kind == "integer" and number == int(number) else number
                if not math.isfinite(number) or kind == "integer" and not isinstance(fit, int):
                    raise ValueError(name)
        except (ValueError, KeyError, TypeError, OverflowError):
            return "failed", None, ",".join([*actions, f"type:{name}"])
        if fit != v or type(fit) is not type(v):
            actions.append(f"coerce:{name}")
        out[name] = fit
    actions += [f"drop:{name}" for name in value if name not in schema]
    return ("repaired" if actions else "valid"), canonical_json(out), ",".join(actions)


def balance_tags(text: str | None) -> tuple[int, int, int]:
    """Tags left open, end tags without a start, and end tags that cross another element."""
    stack, unexpected, crossed = [], 0, 0
    for end, name, own in re.findall(r"<(/?)([A-Za-z][A-Za-z0-9:_-]*)(?:\s[^<>]*?)?(/?)>", text or ""):
        if own or name.lower() in _VOID:
            continue
        if not end:
            stack.append(name)
        elif stack and stack[-1] == name:
            stack.pop()
        elif name in stack:
            crossed += 1
            while stack.pop() != name:
                pass
        else:
            unexpected += 1
    return len(stack), unexpected, crossed


# Packages that code may import besides the standard library.
KNOWN_PACKAGES = frozenset("aiohttp anthropic attr attrs boto3 botocore bs4 celery click cryptography cv2 dateutil django dotenv duckdb fastapi flask google grpc httpx huggingface_hub jinja2 jwt langchain lxml matplotlib mypy networkx nltk numpy openai opentelemetry pandas paramiko PIL pip pkg_resources playwright polars prometheus_client psutil psycopg psycopg2 pyarrow pydantic pymongo pyspark pytest pytz redis regex requests rich ruamel scipy seaborn selenium setuptools six sklearn sqlalchemy starlette tenacity tiktoken tokenizers toml tomli torch tqdm transformers typer typing_extensions urllib3 uvicorn websockets werkzeug yaml zstandard".split())


def _dotted(node: ast.expr) -> str:
    """``a.b.c`` of names and attributes alone, else nothing; chains of calls may be longer than the stack is deep."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else ""


def scan_python(text: str | None) -> list[tuple[str, int]]:
    """Findings (kind, line) of Python source, from its syntax tree; a syntax error is a finding."""
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [("syntax_error", getattr(e, "lineno", 0) or 0)]
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Call):
            name = _dotted(node.func)
            words = {k.arg: k.value for k in node.keywords if k.arg}
            literal = bool(node.args) and all(isinstance(a, ast.Constant) for a in node.args)
            kinds = {
                "eval_exec": name in ("eval", "exec", "compile", "__import__") and not literal,
                "shell_true": isinstance(words.get("shell"), ast.Constant) and words["shell"].value is True,
                "verify_false": isinstance(words.get("verify"), ast.Constant) and words["verify"].value is False,
                "no_timeout": bool(re.fullmatch(r"requests\.(get|post|put|delete|head|patch)", name)) and "timeout" not in words,
                "pickle_load": name in ("pickle.load", "pickle.loads", "marshal.loads"),
                "yaml_load": name in ("yaml.load", "yaml.load_all") and not any("SafeLoader" in v for n in ast.walk(node) for v in (getattr(n, k, None) for k in ("id", "attr", "arg", "value")) if isinstance(v, str)),
                "mktemp": name == "tempfile.mktemp",
                "weak_hash": name in ("hashlib.md5", "hashlib.sha1"),
            }
            out += [(k, node.lineno) for k, hit in kinds.items() if hit]
        elif isinstance(node, (ast.Import, ast.ImportFrom)) and not getattr(node, "level", 0):
            roots = [(a.name if isinstance(node, ast.Import) else node.module or "").partition(".")[0] for a in (node.names if isinstance(node, ast.Import) else node.names[:1])]
            out += [("unknown_import", node.lineno) for r in roots if r not in sys.stdlib_module_names and r not in KNOWN_PACKAGES]
        elif isinstance(node, ast.ExceptHandler) and node.type is None:
            out.append(("bare_except", node.lineno))
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            defaults = [*node.args.defaults, *(d for d in node.args.kw_defaults if d)]
            out += [("mutable_default", node.lineno)] * sum(isinstance(d, (ast.List, ast.Dict, ast.Set)) for d in defaults)
            if isinstance(node, ast.AsyncFunctionDef):
                out += [("blocking_in_async", c.lineno) for c in ast.walk(node) if isinstance(c, ast.Call) and _dotted(c.func) in ("time.sleep", "requests.get", "requests.post")]
    return sorted(set(out), key=lambda x: (x[1], x[0]))


def canonical_json(value) -> str:
    """Names sorted, no blanks; what is not JSON is an error."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)


def route(key: str, backends: list[tuple[str, float]]) -> str:
    """The backend of the highest weighted rendezvous score, the first by name among equals.

    Fixed values: the hash (BLAKE2b of 8 bytes over key, a zero byte and name), its scale of 2^64 and the score of weight
    over the negative logarithm; whoever routes by them agrees.
    """

    def score(name: str, weight: float) -> float:
        n = int.from_bytes(hashlib.blake2b(f"{key}\0{name}".encode(), digest_size=8).digest(), "big")
        return weight / -math.log(min((n + 1) / 2**64, 1.0 - 2**-53))

    return min(backends, key=lambda b: (-score(*b), b[0]))[0]


def _struct(function, schema: str, names: list[str]):
    @F.pandas_udf(schema)
    def apply(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([function(t) for t in texts], columns=names)

    return apply


def json_scan(df: DataFrame, key: str, text: str) -> DataFrame:
    names = ["status", "duplicate_keys", "lossy_numbers", "depth"]
    return df.select(key, _struct(scan_json, "status string, duplicate_keys int, lossy_numbers int, depth int", names)(text).alias("_x")).select(key, "_x.*")


def json_recovery(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, _struct(recover_json, "status string, recovered string", ["status", "recovered"])(text).alias("_x")).select(key, "_x.*")


def schema_repair(df: DataFrame, key: str, text: str, schema: dict[str, str]) -> DataFrame:
    """Rows of (key, status, repaired, actions); null and empty texts fail; texts are read whole."""
    return df.select(key, _struct(lambda t: repair_json(t, schema), "status string, repaired string, actions string", ["status", "repaired", "actions"])(text).alias("_x")).select(key, "_x.*")


def tag_balance(df: DataFrame, key: str, text: str) -> DataFrame:
    names = ["unmatched_open", "unexpected_close", "crossed_close"]
    return df.select(key, _struct(balance_tags, "unmatched_open int, unexpected_close int, crossed_close int", names)(text).alias("_x")).select(key, "_x.*")


def python_findings(df: DataFrame, key: str, text: str) -> DataFrame:
    @F.pandas_udf("array<struct<kind:string,line_no:int>>")
    def apply(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "line_no": n} for k, n in scan_python(t)] for t in texts])

    return df.select(key, F.explode(apply(text)).alias("_x")).select(key, "_x.kind", "_x.line_no")


def cache_keys(df: DataFrame, key: str, model: str, prompt: str, temperature: str) -> DataFrame:
    """SHA-256 of each call's canonical descriptor."""

    @F.pandas_udf("string")
    def apply(models: pd.Series, prompts: pd.Series, temperatures: pd.Series) -> pd.Series:
        def one(m, p, t) -> str:
            return hashlib.sha256(canonical_json({"context_hash": hashlib.sha256(b"null").hexdigest(), "model": m, "prompt": p, "temperature": round(float(t), 4)}).encode()).hexdigest()

        return pd.Series([one(*x) for x in zip(models, prompts, temperatures, strict=True)])

    return df.select(key, apply(model, prompt, temperature).alias("cache_key"))


def routed(df: DataFrame, key: str, backends: list[tuple[str, float]]) -> DataFrame:
    @F.pandas_udf("string")
    def apply(keys: pd.Series) -> pd.Series:
        return pd.Series([route(str(k), backends) for k in keys])

    return df.select(key).distinct().select(key, apply(F.col(key).cast("string")).alias("backend"))


def bootstrap_bands(df: DataFrame, name: str, score: str, rounds: int = 2000, alpha: float = 0.05, seed: int = 7) -> DataFrame:
    """Mean and percentile bootstrap interval of each name's scores.

    Resampling draws how often each distinct score occurs, so a group comes to its task as counts of scores, however
    many rows it has.
    """

    def bands(group: pd.DataFrame) -> pd.DataFrame:
        values, counts = group["score"].to_numpy(float), group["n"].to_numpy(np.int64)
        total = int(counts.sum())
        own = int.from_bytes(hashlib.blake2b(str(group["name"].iloc[0]).encode(), digest_size=8).digest(), "big")
        means = np.sort(np.random.default_rng([seed, own]).multinomial(total, counts / total, rounds) @ values / total)
        low, high = max(0, int(alpha / 2 * rounds)), min(rounds - 1, int((1 - alpha / 2) * rounds))
        return pd.DataFrame({"name": [group["name"].iloc[0]], "n": [total], "mean": [float(values @ counts / total)], "lower": [float(means[low])], "upper": [float(means[high])]})

    counted = df.where(F.col(score).isNotNull()).groupBy(F.col(name).alias("name"), F.col(score).cast("double").alias("score")).agg(F.count("*").alias("n"))
    return counted.groupBy("name").applyInPandas(bands, "name string, n long, mean double, lower double, upper double")


# Texts that the parsers have something to say about, for tests.
JSON_PROBES = ['{"a": 1, "a": 2}', '{"n": 12345678901234567891}', '[1, 2', '{"k": {"x": [1, {"y": "z', "{'a': 1}", '{"ok": [[]]}', "", '{"a": "b\\"c']
XML_PROBES = ["<a><b></b></a>", "<a><b></a></b>", "<p>x<br>y", "</div>", "<img/><i>z</i>"]
PYTHON_PROBES = ["eval(x)", "try:\n    f()\nexcept:\n    pass", "def f(a=[]):\n    return a", "import subprocess\nsubprocess.run(c, shell=True)", "async def g():\n    time.sleep(1)", "def broken(:", "requests.get(u)\nyaml.load(s)\npickle.loads(b)", "x = 1"]
BACKENDS = [("alpha", 5.0), ("beta", 2.0), ("gamma", 1.0)]
