"""A compiler from declared document rules to Spark columns and to DuckDB SQL.

A rule looks at a whole document: it is skipped where its marker of consent
stands, where its gate does not match or where a guard does; comments are
removed; each match of a pattern is a finding with its line, column and first
line, and each required pattern that is missing is one without a place.  All
rules run in one projection, gates first, so that no rule explodes lines or
shuffles; only findings become rows.  Patterns keep to what Java's and RE2's
expressions share.

Authors consent by a comment: ``some-words-ok`` behind code silences its line,
alone on a line it silences the document, as ``some-words-allowed`` does
anywhere in a comment.
"""

from __future__ import annotations

import functools
import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dialect

#: Addresses on which everybody is served.
ANYWHERE = r"(?:0\.0\.0\.0|\[?::\]?|\*)"
#: A host that is not this machine.
ELSEWHERE = r"(?:0\.0\.0\.0|\*|\[?::\]?(?:[\s:/\"',]|$)|(?:[1-9]?[0-9]|1[01][0-9]|12[0-689]|1[3-9][0-9]|2[0-9]{2})\.[0-9]+\.[0-9]+\.[0-9]+|[a-km-z][a-z0-9-]*\.[a-z0-9.-]+)"
HASH_COMMENT = r"(?m)(?:^|[ \t])[#;][^\n]*$"
SLASH_COMMENT = r"(?m)(?:^|[ \t])(?://|#)[^\n]*$|(?s:/\*.*?\*/)"
XML_COMMENT = r"(?s)<!--.*?-->"
_COMMENT = r"(?:#|//|--|;|%|<!--|/\*|\(\*|\*|!|\\)"
#: Comments by which an author consents: to a line of code, and to the whole document.
LINE_CONSENT = rf"(?im)^[ \t]*[^\s#/;%*!\\<-][^\n]*{_COMMENT}[^\n]*\b[a-z0-9][a-z0-9-]*-ok\b[^\n]*$"
CONSENT = rf"(?im)^[ \t]*{_COMMENT}[^\n]*\b[a-z0-9][a-z0-9-]*-ok\b|{_COMMENT}[^\n]*\b[a-z0-9]+(?:-[a-z0-9]+)+-allowed\b"
#: What stands before and after a match while its place is worked out.
START, END = "\u0001", "\u0002"
#: Characters of a match that are shown.
SHOWN = 120
YES, NO = "true|yes|on|1", "false|no|off|0"


#: What may follow a value inside a command, a quoted string or a list.
_ENDS = r"(?:[\"'|/,;)}\\\]]|[ \t]*$|[ \t]+(?:>>|>|&&|\|\||\\|-))"


def setting(key: str, values: str) -> str:
    """``key = value`` or ``key: value``: a line of its own, also exported, as a list item or quoted; inside a command, a
    string or a flow list; a quoted directive that a command writes; or the name and value of a container's variable."""
    line = rf"^[ \t]*(?:export[ \t]+|-[ \t]+|ENV[ \t]+)?[\"']?(?:{key})[\"']?[ \t]*(?:[:=]|[ \t])[ \t]*[\"']?(?:{values})[\"']?[ \t]*,?[ \t]*$"
    inside = rf"(?:[ \t\"'|/,({{]|Environment=[\"']?)(?:{key})[\"']?[ \t]*[:=][ \t]*[\"']?(?:{values}){_ENDS}"
    written = rf"[\"'|/](?:{key})[ \t]+(?:{values})[\"'|/]"
    variable = rf"\bname[ \t]*:[ \t]*[\"']?(?:{key})[\"']?[ \t]*,?\s+value[ \t]*:[ \t]*[\"']?(?:{values})[\"']?[ \t]*$"
    return rf"(?im)(?:{line}|{inside}|{written}|{variable})"


def empty(key: str) -> str:
    """A setting without a value."""
    return rf"(?im)^[ \t]*(?:export[ \t]+|-[ \t]+|ENV[ \t]+)?[\"']?(?:{key})[\"']?[ \t]*[:=][ \t]*(?:[\"']{{2}})?[ \t]*,?[ \t]*$"


def flag(name: str, values: str = "") -> str:
    """A command-line flag, with a value if ``values`` is given; also as items of a list."""
    return rf"(?im)(?:^|[\s\"'])--?(?:{name})" + (rf"(?:[ \t]+|=|[\"']?[ \t]*,[ \t]*)[\"']?(?:{values})(?:[\s\"',:\]]|$)" if values else r"(?:[\s\"',=\]]|$)")


def xml_property(name: str, values: str) -> str:
    """A property of an XML site file."""
    return rf"(?is)<name>\s*(?:{name})\s*</name>\s*<value>\s*(?:{values})\s*</value>"


def bind(key: str) -> str:
    """A setting whose address is everybody's."""
    return setting(key, rf"(?:[a-z]+://)?{ANYWHERE}(?::\d+)?[^\n]*")


@dataclass(frozen=True)
class Rule:
    """``found``: patterns that are findings; ``needed``: patterns whose absence is one; ``gate``: pattern that must
    match; ``unless``: guards, of which none may match; ``consent``: marker that silences the rule; ``comments``: what is
    removed first; ``probe``: a text that the rule must flag; ``clean``: one that it must not."""

    name: str
    found: tuple[str, ...]
    probe: str
    gate: str | None = None
    needed: tuple[str, ...] = ()
    consent: str | None = None
    comments: str | None = HASH_COMMENT
    unless: tuple[str, ...] = ()
    clean: str = ""


def _required(parts) -> set[str] | None:
    """Literals of which every match holds one, the longest that can be told; None if there are none."""
    choices: list[set[str]] = []
    run = ""
    for op, argument in [*parts, (None, None)]:
        if op is sre.LITERAL and argument < 128:
            run += chr(argument).lower()
            continue
        if len(run) > 1:
            choices.append({run})
        run = ""
        inner = None
        if op is sre.SUBPATTERN:
            inner = [argument[-1]]
        elif op is sre.BRANCH:
            inner = argument[1]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and argument[0] >= 1:
            inner = [argument[2]]
        if inner is not None:
            found = [_required(x) for x in inner]
            if all(found):
                choices.append(set().union(*found))
    return max(choices, key=lambda c: (min(map(len, c)), -len(c)), default=None)


@functools.cache
def needles(pattern: str) -> frozenset[str] | None:
    """Lower-case literals of which every match of ``pattern`` holds one; None if that can't be told."""
    if r"\x{" in pattern or r"\p{" in pattern:
        return None
    try:
        found = _required(sre_parser.parse(pattern.replace(r"\z", r"\Z")))
    except Exception:  # a construct that only the other engines know
        return None
    return frozenset(found) if found else None


# The columns are written as SQL text and parsed at once: built call by call, twenty rules take seconds.
_KIND = "ARRAY<STRUCT<rule: STRING, kind: STRING, line_no: INT, col: INT, detail: STRING>>"
_q = dialect.spark_quote


def _may_match(patterns: tuple[str, ...]) -> str | None:
    """A cheap condition on the lower-case text that holds wherever one of the patterns matches."""
    sets = [needles(p) for p in patterns]
    if not sets or not all(sets):
        return None
    return "(" + " OR ".join(f"contains(_low, {_q(n)})" for n in sorted(set().union(*sets))) + ")"


def _places(clean: str, pattern: str) -> str:
    """Line, column and first line of each match, from one replacement and a fold over the pieces between matches."""
    marked = f"regexp_replace({clean}, {_q(pattern)}, {_q(START + '$0' + END)})"
    plain = f"translate(x, {_q(END)}, '')"
    breaks = f"(length({plain}) - length(translate({plain}, {_q(chr(10))}, '')))"
    tail = f"length(substring_index({plain}, {_q(chr(10))}, -1))"
    here = f"named_struct('line_no', a.line, 'col', a.col + 1, 'detail', substring_index(x, {_q(END)}, 1))"
    step = f"named_struct('line', a.line + {breaks}, 'col', CASE WHEN {breaks} > 0 THEN {tail} ELSE a.col + {tail} END, 'found', array_append(a.found, {here}))"
    begin = "named_struct('line', 1, 'col', 0, 'found', CAST(array() AS ARRAY<STRUCT<line_no: INT, col: INT, detail: STRING>>))"
    # the first piece stands before the first match
    return f"slice(aggregate(split({marked}, {_q(START)}), {begin}, (a, x) -> {step}, a -> a.found), 2, 1073741824)"


def _findings(rule: Rule) -> tuple[list[str], str]:
    """When a rule applies, and its findings as an array, in a text ``c`` if it removes comments."""
    none, name = f"CAST(array() AS {_KIND})", _q(rule.name)
    clean = "c" if rule.comments else "_text"
    shown = f"substring(trim(BOTH ' ' FROM substring_index(trim(LEADING {_q(' ' + chr(9) + chr(13) + chr(10))} FROM y.detail), {_q(chr(10))}, 1)), 1, {SHOWN})"
    parts = [f"CASE WHEN regexp_like({clean}, {_q(p)}) THEN CAST(transform({_places(clean, p)}, y -> named_struct('rule', {name}, 'kind', 'found', 'line_no', y.line_no, 'col', y.col, 'detail', {shown})) AS {_KIND}) ELSE {none} END" for p in rule.found]
    missing = f"CAST(array(named_struct('rule', {name}, 'kind', 'missing', 'line_no', 0, 'col', 0, 'detail', '')) AS {_KIND})"
    parts += [f"CASE WHEN regexp_like({clean}, {_q(p)}) THEN {none} ELSE {missing} END" for p in rule.needed]
    found = f"concat({', '.join(parts)})"
    for p in rule.unless:
        found = f"CASE WHEN NOT regexp_like({clean}, {_q(p)}) THEN {found} END"
    # from the cheapest to the dearest: substrings, the gate, consent; only then comments and patterns
    applies = [c for c in (_may_match(x) for x in ((rule.gate,) if rule.gate else (), () if rule.needed else rule.found)) if c]
    applies += [f"regexp_like(_text, {_q(rule.gate)})"] if rule.gate else []
    applies += [f"NOT regexp_like(_text, {_q(rule.consent)})"] if rule.consent else []
    return applies, found


def _all_findings(rules: list[Rule]) -> str:
    """The findings of all rules, as arrays of which some are null: rules that differ in nothing but names are one, and
    comments are removed once for all that remove the same ones."""
    alike: dict[Rule, list[str]] = {}
    for r in rules:
        alike.setdefault(replace(r, name="", probe="", clean=""), []).append(r.name)
    by_comments: dict[str | None, list[tuple[list[str], str]]] = {}
    for r, names in alike.items():
        applies, found = _findings(replace(r, name=names[0]))
        if len(names) > 1:
            each = "named_struct('rule', name, 'kind', z.kind, 'line_no', z.line_no, 'col', z.col, 'detail', z.detail)"
            found = f"CAST(flatten(transform({found}, z -> transform(array({', '.join(map(_q, names))}), name -> {each}))) AS {_KIND})"
        by_comments.setdefault(r.comments, []).append((applies, found))
    out = []
    for comments, group in by_comments.items():
        each = [f"CASE WHEN {' AND '.join(applies)} THEN {found} END" if applies else found for applies, found in group]
        if comments is None:
            out += each
            continue
        # through a lambda's variable, and only where the cheapest condition of one of the rules holds
        found = f"element_at(transform(array(regexp_replace(_text, {_q(comments)}, '')), c -> flatten(filter(array({', '.join(each)}), z -> z IS NOT NULL))), 1)"
        out.append(f"CASE WHEN {' OR '.join(applies[0] for applies, _ in group)} THEN {found} END" if all(applies for applies, _ in group) else found)
    return ", ".join(out)


def scan(rules: list[Rule], documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of (key, rule, kind, line_no, col, detail), one for each finding.

    ``kind`` is found or missing; a missing one has line and column 0 and no detail.  Lines and columns (from 1) are those of the
    text without comments, which keep their line breaks unless they are blocks.  Null and empty texts have no findings, but
    nothing is required of them either; texts are read whole, repeated rows each have their findings, no rows in, none out.
    """
    plain = F.translate(F.col(text), START + END, "")
    lowered = F.lower(F.col(text))
    marked = lowered.contains("-ok")
    source = documents.select(F.col(key), F.when(marked, F.regexp_replace(plain, F.lit(LINE_CONSENT), F.lit(""))).otherwise(plain).alias("_text"), lowered.alias("_low"))
    source = source.where(~((F.col("_low").contains("-ok") | F.col("_low").contains("-allowed")) & F.col("_text").rlike(CONSENT)))
    every = F.expr(f"flatten(filter(array({_all_findings(rules)}), z -> z IS NOT NULL))")
    return source.select(F.col(key), F.explode(every).alias("_x")).select(key, "_x.*")


def scan_sql(rules: list[Rule], documents: str) -> str:
    """The same rows from DuckDB, where places are counted in prefixes; ``documents`` is a query of (doc_id, text)."""
    parts = []

    def quote(pattern: str) -> str:  # scripts are named without Java's prefix
        return dialect.quote(pattern.replace(r"\p{Is", r"\p{"))

    for r in rules:
        clean = f"regexp_replace(text, {quote(r.comments)}, '', 'g')" if r.comments else "text"
        where = ["true"] + ([f"regexp_matches(text, {quote(r.gate)})"] if r.gate else []) + ([f"NOT regexp_matches(text, {quote(r.consent)})"] if r.consent else []) + [f"NOT regexp_matches({clean}, {quote(p)})" for p in r.unless]
        name, applies = quote(r.name), " AND ".join(where)
        for p in r.found:
            parts.append(f"SELECT doc_id, {name} AS rule, string_split(regexp_replace({clean}, {quote(p)}, chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS pieces, 'found' AS kind FROM docs WHERE {applies} AND regexp_matches({clean}, {quote(p)})")
        for p in r.needed:
            parts.append(f"SELECT doc_id, {name} AS rule, ['', ''] AS pieces, 'missing' AS kind FROM docs WHERE {applies} AND NOT regexp_matches({clean}, {quote(p)})")
    return f"""WITH docs AS (SELECT * FROM (SELECT doc_id, regexp_replace(replace(replace(text, chr(1), ''), chr(2), ''), {quote(LINE_CONSENT)}, '', 'g') AS text FROM ({documents}) d) e WHERE NOT regexp_matches(text, {quote(CONSENT)})),
marked AS ({' UNION ALL '.join(parts)}),
each AS (SELECT doc_id, rule, kind, pieces, unnest(range(2, len(pieces) + 1)) AS i FROM marked),
placed AS (SELECT doc_id, rule, kind, replace(array_to_string(pieces[1:i - 1], ''), chr(2), '') AS prefix, string_split(pieces[i], chr(2))[1] AS found FROM each)
SELECT doc_id, rule, kind, CASE WHEN kind = 'found' THEN CAST(1 + len(prefix) - len(replace(prefix, chr(10), '')) AS INTEGER) ELSE 0 END AS line_no,
  CASE WHEN kind = 'found' THEN CAST(1 + len(string_split(prefix, chr(10))[-1]) AS INTEGER) ELSE 0 END AS col,
  substr(trim(string_split(ltrim(found, ' ' || chr(9) || chr(13) || chr(10)), chr(10))[1], ' '), 1, {SHOWN}) AS detail
FROM placed"""
