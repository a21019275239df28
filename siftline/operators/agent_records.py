"""Operators over the records of agents: one SQL text each over named inputs, and how the tables at hand become these inputs.

``OPERATORS[name]`` runs on any DataFrames of the named columns (``apply``); the
registered query feeds it with ``INPUTS``, SQL over the tables that only renames
and derives columns.  Every text runs on Spark and, through the same macros, on
DuckDB.  Windows are partitioned by the entity; nothing is collected.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions import dialect
from . import span_graphs

#: SQL over tables that gives an input: traces, calls, prompts and streams in the shape that the operators expect.
INPUTS = {
    # tool calls with JSON arguments: call_id, session, tool, args, n (order in the session)
    "calls": "SELECT event_id AS call_id, user_id AS session, event_type AS tool, CASE WHEN event_id % 17 = 3 THEN concat('{\"qeury\": 1, \"k\": ', CAST(event_id % 5 AS STRING), '}') WHEN event_id % 13 = 5 THEN '{\"query\": \"x\", \"page\": 2, \"k\": 1}' ELSE concat('{\"query\": \"', event_type, '\", \"k\": ', CAST(event_id % 5 AS STRING), '}') END AS args, event_id AS n FROM {events}",
    # spans: trace_id, span_id, parent_id (null at a root)
    "spans": "SELECT l_orderkey AS trace_id, l_linenumber AS span_id, CASE WHEN l_linenumber = 1 THEN NULL WHEN (l_orderkey + l_linenumber) % 11 = 0 THEN 99 WHEN (l_orderkey + l_linenumber) % 13 = 0 THEN l_linenumber + 1 ELSE l_linenumber - 1 END AS parent_id FROM {lineitem}",
    # requests in flight: request_id, key, started, ended
    "flights": "SELECT event_id AS request_id, event_type AS k, EPOCH(ts) AS started, EPOCH(ts) + 30 + event_id % 600 AS ended FROM {events}",
    # attempts of calls under one idempotency key: k, attempt, at, max_attempts, deadline, args_hash
    "attempts": "SELECT user_id * 10 + event_id % 7 AS k, event_id AS attempt_id, row_number() OVER (PARTITION BY user_id * 10 + event_id % 7 ORDER BY event_id) AS attempt, EPOCH(ts) AS at, 3 AS max_attempts, event_id % 2 AS args_hash FROM {events}",
    # a model's planned calls: plan_id, prompt, output_tokens
    "plans": "SELECT doc_id AS plan_id, text AS prompt, 200 + doc_id % 400 AS output_tokens FROM {documents}",
    # log of flushed output: stream_id, seq, bytes_committed
    "flushes": "SELECT conv_id AS stream_id, turn AS seq, 100 * (turn + 1) - CASE WHEN (conv_id + turn) % 9 = 8 THEN 150 ELSE 0 END AS bytes_committed FROM {conversations}",
    # server-sent events and the last id that a client holds: stream_id, event_id, client_last
    "sent": "SELECT user_id AS stream_id, event_id, CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id * 3 END AS client_last FROM {events}",
    # runs of prompts against stored snapshots: case_id, output, stored
    "snapshots": "SELECT conv_id * 100 + turn AS case_id, CASE WHEN turn % 5 = 4 THEN NULL ELSE text END AS output, CASE WHEN turn % 7 = 6 THEN NULL WHEN (conv_id + turn) % 4 = 0 THEN concat(text, ' ') ELSE text END AS stored FROM {conversations}",
    # sections of prompts: prompt_id, position, header, body
    "sections": "SELECT conv_id AS prompt_id, turn AS position, CASE turn % 5 WHEN 0 THEN 'Output' WHEN 1 THEN 'Role' WHEN 2 THEN 'Tools' WHEN 3 THEN 'Notes' ELSE 'Rules' END AS header, text AS body FROM {conversations}",
    # pinned and running prompt settings: name, model, temperature, max_tokens, prompt, and the same with _now
    "pins": "SELECT conv_id AS name, 'm1' AS model, CASE WHEN conv_id % 4 = 0 THEN 'm2' ELSE 'm1' END AS model_now, 0.2 AS temperature, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE 0.2 END AS temperature_now, text AS prompt, CASE WHEN conv_id % 5 = 0 THEN upper(text) ELSE text END AS prompt_now FROM {conversations} WHERE turn = 0",
    # messages that agents hand to each other: message_id, body (JSON)
    "handoffs": "SELECT event_id AS message_id, CASE WHEN event_id % 19 = 0 THEN 'not json' WHEN event_id % 7 = 0 THEN concat('{\"from\": \"scout\", \"to\": \"', event_type, '\", \"task\": \"\"}') ELSE concat('{\"from\": \"scout\", \"to\": \"actor\", \"task\": \"', event_type, '\", \"status\": \"', CASE WHEN event_id % 5 = 0 THEN 'maybe' ELSE 'ready' END, '\"}') END AS body FROM {events}",
    # repair attempts of structured output: session, attempt, error (null when valid)
    "repairs": "SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt, CASE WHEN event_type = 'purchase' THEN NULL ELSE concat('bad ', event_type) END AS error FROM {events}",
    # steps of missions as logged, with repeats after a resume: mission, seq, step, status
    "steps": "SELECT user_id AS mission, event_id AS seq, event_id % 6 AS step, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' THEN 'started' ELSE 'done' END AS status FROM {events}",
    # texts to embed as they are submitted: item_id, t, text
    "submissions": "SELECT event_id AS item_id, EPOCH(ts) AS t, event_type AS text FROM {events}",
    # deltas of streamed tool calls: stream_id, idx (of the call), n (order), piece; some streams break off
    "deltas": "SELECT conv_id AS stream_id, turn % 2 AS idx, turn AS n, CASE WHEN turn < 2 THEN '{\"v\": [0' ELSE concat(', ', CAST(turn AS STRING)) END AS piece FROM {conversations} UNION ALL SELECT conv_id AS stream_id, turn % 2 AS idx, 100000 AS n, ']}' AS piece FROM {conversations} WHERE turn < 2 AND (conv_id + turn) % 3 > 0",
    # JSONL files: doc_id, line_no, line
    "jsonl": "SELECT user_id AS doc_id, event_id AS line_no, CASE WHEN event_id % 23 = 0 THEN 'oops' WHEN event_id % 9 = 0 THEN '{\"a\": 1}' ELSE props END AS line FROM {events}",
    "documents": "SELECT doc_id, text FROM {documents}",
    "records": "SELECT event_id AS record_id, event_type AS kind, props AS body FROM {events}",
}

_JSON_KEYS = "EXPLODE(JSON_KEYS(args))"

OPERATORS: dict[str, str] = {}

# keys of arguments against the first call of the same tool in a session
OPERATORS["argument_key_stability"] = f"""
WITH keyed AS (SELECT session, tool, call_id, n, {_JSON_KEYS} AS name FROM {{calls}}),
first_calls AS (SELECT session, tool, min(n) AS first_n, count(*) AS n_calls FROM {{calls}} GROUP BY session, tool),
uses AS (SELECT k.session, k.tool, k.name, f.n_calls, count(*) AS n_used, min(k.n) = min(f.first_n) AS in_baseline FROM keyed k JOIN first_calls f ON k.session = f.session AND k.tool = f.tool GROUP BY k.session, k.tool, k.name, f.n_calls)
SELECT session, tool, name, n_calls, n_used, CASE WHEN NOT in_baseline THEN 'key_added_after_baseline' WHEN n_used < n_calls THEN 'key_dropped_after_baseline' ELSE 'stable' END AS kind FROM uses"""

# keys that no tool declares but that are one or two edits from a declared key; the declared keys are those of most calls
OPERATORS["argument_key_typos"] = f"""
WITH keyed AS (SELECT tool, call_id, {_JSON_KEYS} AS name FROM {{calls}}),
sizes AS (SELECT tool, count(*) AS n_calls FROM {{calls}} GROUP BY tool),
counted AS (SELECT tool, name, count(*) AS n FROM keyed GROUP BY tool, name),
declared AS (SELECT c.tool, c.name FROM counted c JOIN sizes s ON c.tool = s.tool WHERE 2 * c.n >= s.n_calls),
strange AS (SELECT c.tool, c.name, c.n FROM counted c JOIN sizes s ON c.tool = s.tool WHERE 2 * c.n < s.n_calls),
near AS (SELECT x.tool, x.name, x.n, d.name AS meant, levenshtein(x.name, d.name) AS distance, row_number() OVER (PARTITION BY x.tool, x.name ORDER BY levenshtein(x.name, d.name), d.name) AS k FROM strange x JOIN declared d ON x.tool = d.tool)
SELECT tool, name, n, CASE WHEN distance <= 2 THEN meant END AS meant, CASE WHEN distance <= 2 THEN 'typo' ELSE 'unknown_key' END AS kind FROM near WHERE k = 1"""

# spans of a trace: several or no roots, parents that are missing, and cycles (spans that no root reaches)
OPERATORS["span_graph"] = """
WITH RECURSIVE reached(trace_id, span_id, depth) AS (
  SELECT trace_id, span_id, 0 AS depth FROM {spans} WHERE parent_id IS NULL
  UNION ALL SELECT s.trace_id, s.span_id, r.depth + 1 FROM {spans} s JOIN reached r ON s.trace_id = r.trace_id AND s.parent_id = r.span_id WHERE r.depth < 50),
counts AS (SELECT trace_id, count(*) AS n_spans, CAST(sum(CASE WHEN parent_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_roots, count(DISTINCT span_id) AS n_ids FROM {spans} GROUP BY trace_id),
orphans AS (SELECT c.trace_id, count(*) AS n_orphans FROM {spans} c LEFT JOIN (SELECT DISTINCT trace_id, span_id FROM {spans}) p ON c.trace_id = p.trace_id AND c.parent_id = p.span_id WHERE c.parent_id IS NOT NULL AND p.span_id IS NULL GROUP BY c.trace_id),
found AS (SELECT trace_id, count(DISTINCT span_id) AS n_reached, max(depth) AS depth FROM reached GROUP BY trace_id)
SELECT c.trace_id, c.n_spans, c.n_roots, coalesce(o.n_orphans, 0) AS n_orphans, c.n_ids - coalesce(f.n_reached, 0) AS n_unreached, CAST(coalesce(f.depth, 0) AS BIGINT) AS depth, c.n_spans - c.n_ids AS n_duplicates,
  CASE WHEN c.n_roots = 0 THEN 'no_root' WHEN c.n_roots > 1 THEN 'multiple_roots' WHEN coalesce(o.n_orphans, 0) > 0 THEN 'orphan_span' WHEN c.n_ids > coalesce(f.n_reached, 0) THEN 'cycle' ELSE 'ok' END AS verdict
FROM counts c LEFT JOIN orphans o ON c.trace_id = o.trace_id LEFT JOIN found f ON c.trace_id = f.trace_id"""

def _span_graph(spark: SparkSession, spans: DataFrame) -> DataFrame:
    """The operator's columns from ``span_graphs``: Spark's recursion keeps each path as a row and ends at a million rows."""
    columns = OPERATORS["span_graph"].rpartition("\nSELECT ")[2].rpartition("\nFROM ")[0]
    columns = re.sub(r"coalesce\([of]\.(\w+), 0\)", r"c.\1", columns)
    return dialect.run(spark, "", f"SELECT {columns} FROM {{counted}} c", {"counted": span_graphs.counts(spans)})


#: Operators that Spark plans otherwise than by their SQL, with the same rows.
PLANS = {"span_graph": _span_graph}

# requests that arrive while one of the same key is in flight follow it
OPERATORS["request_coalescing"] = """
WITH seen AS (SELECT request_id, k, started, ended, max(ended) OVER (PARTITION BY k ORDER BY started, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy_until FROM {flights}),
led AS (SELECT request_id, k, started, CASE WHEN busy_until > started THEN 0 ELSE 1 END AS leads FROM seen),
numbered AS (SELECT request_id, k, leads, sum(leads) OVER (PARTITION BY k ORDER BY started, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS flight FROM led)
SELECT k, CAST(flight AS BIGINT) AS flight, max(CASE WHEN leads = 1 THEN request_id END) AS leader, count(*) - 1 AS n_followers FROM numbered GROUP BY k, flight"""

# one execution for each idempotency key; repeats replay it, other arguments conflict, too many attempts are refused
OPERATORS["retry_envelopes"] = """
WITH first_tries AS (SELECT k, args_hash AS first_hash, attempt_id AS executed_as FROM {attempts} WHERE attempt = 1)
SELECT a.k, a.attempt_id, a.attempt, f.executed_as, CASE WHEN a.attempt > a.max_attempts THEN 'exhausted' WHEN a.attempt = 1 THEN 'execute' WHEN a.args_hash <> f.first_hash THEN 'conflict' ELSE 'replay' END AS verdict FROM {attempts} a JOIN first_tries f ON a.k = f.k"""

# tokens by words and marks, priced by model; the cheapest model whose window holds the plan
OPERATORS["call_costs"] = r"""
WITH sized AS (SELECT plan_id, output_tokens, REGEX_COUNT(prompt, '[A-Za-z0-9_]{1,4}|[^A-Za-z0-9_\s]') AS input_tokens FROM {plans}),
priced AS (SELECT s.plan_id, s.input_tokens, s.output_tokens, p.model, s.input_tokens * p.input_rate + s.output_tokens * p.output_rate AS cost, row_number() OVER (PARTITION BY s.plan_id ORDER BY s.input_tokens * p.input_rate + s.output_tokens * p.output_rate, p.model) AS k
  FROM sized s JOIN (VALUES ('small', 1, 2, 1000), ('middle', 3, 9, 8000), ('large', 10, 30, 200000)) AS p(model, input_rate, output_rate, context) ON s.input_tokens + s.output_tokens <= p.context)
SELECT s.plan_id, s.input_tokens, s.output_tokens, p.model, p.cost, CASE WHEN p.model IS NULL THEN 'fits_nowhere' ELSE 'ok' END AS verdict FROM sized s LEFT JOIN priced p ON s.plan_id = p.plan_id AND p.k = 1"""

# the last flush up to which a stream's log is whole: numbers without a gap, bytes that only grow
OPERATORS["flush_recovery"] = """
WITH steps AS (SELECT stream_id, seq, bytes_committed, CASE WHEN seq <> row_number() OVER (PARTITION BY stream_id ORDER BY seq) - 1 OR bytes_committed < lag(bytes_committed) OVER (PARTITION BY stream_id ORDER BY seq) THEN 1 ELSE 0 END AS broken FROM {flushes}),
run AS (SELECT stream_id, seq, bytes_committed, sum(broken) OVER (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS breaks FROM steps)
SELECT stream_id, count(*) AS n_flushes, CAST(coalesce(max(CASE WHEN breaks = 0 THEN bytes_committed END), 0) AS BIGINT) AS resume_at, CAST(sum(CASE WHEN breaks > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_lost, CASE WHEN max(breaks) = 0 THEN 'intact' ELSE 'truncated' END AS verdict FROM run GROUP BY stream_id"""

# what a client that reconnects is sent from the events still held (the last 20 of a stream)
OPERATORS["event_replays"] = """
WITH ranked AS (SELECT stream_id, event_id, client_last, row_number() OVER (PARTITION BY stream_id ORDER BY event_id DESC) AS back FROM {sent}),
held AS (SELECT stream_id, max(client_last) AS client_last, max(event_id) AS newest, min(CASE WHEN back <= 20 THEN event_id END) AS oldest_held, min(event_id) AS oldest, CAST(sum(CASE WHEN back <= 20 AND event_id > client_last THEN 1 ELSE 0 END) AS BIGINT) AS n_replayed, CAST(sum(CASE WHEN back > 20 AND event_id > client_last THEN 1 ELSE 0 END) AS BIGINT) AS n_gone FROM ranked GROUP BY stream_id)
SELECT stream_id, client_last, newest, oldest_held, n_replayed, n_gone, CASE WHEN client_last >= newest THEN 'up_to_date' WHEN n_gone > 0 THEN 'gap' ELSE 'replay' END AS verdict FROM held"""

OPERATORS["prompt_snapshots"] = """
SELECT case_id, CASE WHEN output IS NULL AND stored IS NULL THEN 'absent' WHEN stored IS NULL THEN 'new' WHEN output IS NULL THEN 'missing' WHEN SHA256(trim(output)) = SHA256(trim(stored)) THEN 'same' ELSE 'changed' END AS status, SHA256(trim(output)) AS output_sha256 FROM {snapshots}"""

# sections in the declared order, others after them by name; prompts that differ in order alone get the same rows
OPERATORS["section_order"] = """
WITH ranked AS (SELECT prompt_id, position, header, body, CASE lower(header) WHEN 'role' THEN 1 WHEN 'rules' THEN 2 WHEN 'tools' THEN 3 WHEN 'output' THEN 4 ELSE 9 END AS declared FROM {sections})
SELECT prompt_id, header, SHA256(trim(body)) AS body_sha256, row_number() OVER (PARTITION BY prompt_id ORDER BY declared, lower(header), position) AS place, CASE WHEN declared = 9 THEN 'undeclared' ELSE 'declared' END AS kind FROM ranked"""

OPERATORS["prompt_pins"] = """
SELECT name, field, pinned_sha256, running_sha256 FROM (
SELECT name, 'model' AS field, SHA256(model) AS pinned_sha256, SHA256(model_now) AS running_sha256, model IS NOT DISTINCT FROM model_now AS same FROM {pins}
UNION ALL SELECT name, 'temperature' AS field, SHA256(CAST(CAST(temperature AS DOUBLE) AS STRING)) AS pinned_sha256, SHA256(CAST(CAST(temperature_now AS DOUBLE) AS STRING)) AS running_sha256, temperature IS NOT DISTINCT FROM temperature_now AS same FROM {pins}
UNION ALL SELECT name, 'prompt' AS field, SHA256(prompt) AS pinned_sha256, SHA256(prompt_now) AS running_sha256, prompt IS NOT DISTINCT FROM prompt_now AS same FROM {pins}) x WHERE NOT same"""

# required fields, filled and of a known status
OPERATORS["handoff_messages"] = """
WITH parsed AS (SELECT message_id, JSON_VALID(body) AS valid, JSON_GET(body, 'from') AS sender, JSON_GET(body, 'to') AS receiver, JSON_GET(body, 'task') AS task, JSON_GET(body, 'status') AS status FROM {handoffs})
SELECT message_id, CASE WHEN NOT valid THEN 'not_json' WHEN sender IS NULL OR receiver IS NULL OR task IS NULL OR status IS NULL THEN 'missing_field' WHEN trim(sender) = '' OR trim(receiver) = '' OR trim(task) = '' THEN 'empty_field' WHEN status NOT IN ('ready', 'blocked', 'done') THEN 'bad_status' WHEN sender = receiver THEN 'sent_to_itself' ELSE 'ok' END AS verdict FROM parsed"""

# a repair loop ends with a valid answer, is stuck when an error comes back at once, or runs out of attempts
OPERATORS["repair_loops"] = """
WITH marked AS (SELECT session, attempt, error, lag(error) OVER (PARTITION BY session ORDER BY attempt) AS before FROM {repairs} WHERE attempt <= 6),
ends AS (SELECT session, min(CASE WHEN error IS NULL THEN attempt END) AS solved_at, min(CASE WHEN error = before THEN attempt END) AS stuck_at, max(attempt) AS n_attempts FROM marked GROUP BY session)
SELECT session, n_attempts, solved_at, stuck_at, CASE WHEN stuck_at IS NOT NULL AND (solved_at IS NULL OR stuck_at < solved_at) THEN 'stuck' WHEN solved_at IS NOT NULL THEN 'solved' WHEN n_attempts >= 6 THEN 'exhausted' ELSE 'running' END AS status FROM ends"""

# where a mission goes on: after its last done step, and what was done more than once
OPERATORS["checkpoint_resume"] = """
WITH per_step AS (SELECT mission, step, max(CASE WHEN status = 'done' THEN 1 ELSE 0 END) AS done, CAST(sum(CASE WHEN status = 'done' THEN 1 ELSE 0 END) AS BIGINT) AS times FROM {steps} GROUP BY mission, step),
chain AS (SELECT mission, step, done, times, min(done) OVER (PARTITION BY mission ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS unbroken, row_number() OVER (PARTITION BY mission ORDER BY step) - 1 AS k FROM per_step)
SELECT mission, CAST(sum(CASE WHEN unbroken = 1 AND step = k THEN 1 ELSE 0 END) AS BIGINT) AS resume_step, CAST(sum(done) AS BIGINT) AS n_done, CAST(sum(CASE WHEN times > 1 THEN times - 1 ELSE 0 END) AS BIGINT) AS n_redone FROM chain GROUP BY mission"""

# batches of at most 8 distinct texts out of fixed windows of 60 seconds; a text is sent once a window
OPERATORS["embedding_batches"] = """
WITH placed AS (SELECT item_id, text, t - t % 60 AS window_start FROM {submissions}),
sent_once AS (SELECT window_start, text, min(item_id) AS first_item, count(*) AS n_items FROM placed GROUP BY window_start, text),
numbered AS (SELECT window_start, text, first_item, n_items, row_number() OVER (PARTITION BY window_start ORDER BY first_item) - 1 AS k FROM sent_once)
SELECT window_start, CAST(floor(k / 8) AS BIGINT) AS batch, count(*) AS n_sent, CAST(sum(n_items) AS BIGINT) AS n_items, CASE WHEN count(*) = 8 THEN 'size' ELSE 'wait' END AS flushed_by FROM numbered GROUP BY window_start, CAST(floor(k / 8) AS BIGINT)"""

# keys of JSON records: how many records of a kind hold each key, and what is extra or missing against most
OPERATORS["record_key_coverage"] = """
WITH keyed AS (SELECT kind, record_id, EXPLODE(JSON_KEYS(body)) AS name FROM {records}),
sizes AS (SELECT kind, count(*) AS n_records, CAST(sum(CASE WHEN JSON_VALID(body) THEN 0 ELSE 1 END) AS BIGINT) AS n_invalid FROM {records} GROUP BY kind)
SELECT s.kind, k.name, s.n_records, s.n_invalid, count(*) AS n_with, s.n_records - count(*) AS n_without, CASE WHEN count(*) = s.n_records THEN 'always' WHEN 2 * count(*) >= s.n_records THEN 'usual' ELSE 'extra' END AS coverage FROM keyed k JOIN sizes s ON k.kind = s.kind GROUP BY s.kind, k.name, s.n_records, s.n_invalid"""

# a tool's results against the declared keys: extras are stripped, missing ones and wrong types are reported
OPERATORS["result_schema"] = """
WITH parsed AS (SELECT record_id, kind, JSON_VALID(body) AS valid, ITEMS(JSON_KEYS(body)) AS n_keys, JSON_GET(body, 'page') AS page, JSON_GET(body, 'k') AS k FROM {records})
SELECT record_id, kind, valid, page IS NULL AS missing_page, n_keys - CASE WHEN page IS NULL THEN 0 ELSE 1 END - CASE WHEN k IS NULL THEN 0 ELSE 1 END AS n_extras, CASE WHEN k IS NOT NULL AND TRY_CAST(k AS BIGINT) IS NULL THEN 'type_mismatch' WHEN k IS NULL THEN 'missing_k' ELSE 'ok' END AS verdict FROM parsed"""

# values of denied keys are replaced wherever they stand in a record
OPERATORS["record_redaction"] = r"""
SELECT record_id, SHA256(clean) AS clean_sha256, clean <> body AS redacted, REGEX_COUNT(body, '"(?:email|token|password|k)"[ ]*:[ ]*(?:"[^"]*"|[0-9.]+)') AS n_values FROM (SELECT record_id, body, REGEX_REPLACE(body, '"(?:email|token|password|k)"[ ]*:[ ]*(?:"[^"]*"|[0-9.]+)', '"redacted": true') AS clean FROM {records}) x"""

# lines of a JSONL file against the keys that most of its objects have
OPERATORS["jsonl_mixed_schema"] = """
WITH valid AS (SELECT doc_id, line_no, line, JSON_VALID(line) AS ok FROM {jsonl}),
sizes AS (SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS n_valid FROM valid GROUP BY doc_id),
keyed AS (SELECT doc_id, line_no, EXPLODE(JSON_KEYS(line)) AS name FROM valid WHERE ok),
usual AS (SELECT k.doc_id, k.name FROM keyed k JOIN sizes s ON k.doc_id = s.doc_id GROUP BY k.doc_id, k.name, s.n_valid HAVING 2 * count(*) > s.n_valid),
n_usual AS (SELECT doc_id, count(*) AS n FROM usual GROUP BY doc_id),
held AS (SELECT k.doc_id, k.line_no, CAST(sum(CASE WHEN u.name IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS extra, CAST(sum(CASE WHEN u.name IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS common FROM keyed k LEFT JOIN usual u ON k.doc_id = u.doc_id AND k.name = u.name GROUP BY k.doc_id, k.line_no)
SELECT v.doc_id, v.line_no, coalesce(h.extra, 0) AS n_extra, coalesce(n.n, 0) - coalesce(h.common, 0) AS n_missing, CASE WHEN NOT v.ok THEN 'invalid_json' WHEN coalesce(h.extra, 0) > 0 THEN 'extra_keys' ELSE 'missing_keys' END AS kind
FROM valid v LEFT JOIN held h ON v.doc_id = h.doc_id AND v.line_no = h.line_no LEFT JOIN n_usual n ON v.doc_id = n.doc_id WHERE NOT v.ok OR coalesce(h.extra, 0) > 0 OR coalesce(n.n, 0) > coalesce(h.common, 0)"""

# a sub-agent's answer: fences stripped, JSON with the required keys, and what the policy does with the rest
OPERATORS["output_validation"] = r"""
WITH bare AS (SELECT message_id, trim(REGEX_REPLACE(body, '^[ \n]*```[a-z]*\n|\n```[ \n]*$', '')) AS body FROM {handoffs}),
parsed AS (SELECT message_id, JSON_VALID(body) AS valid, ITEMS(JSON_KEYS(body)) AS n_keys, JSON_GET(body, 'task') AS task, JSON_GET(body, 'status') AS status FROM bare)
SELECT message_id, CASE WHEN NOT valid THEN 'invalid_json' WHEN task IS NULL OR status IS NULL THEN 'missing_key' WHEN status NOT IN ('ready', 'blocked', 'done') THEN 'bad_value' WHEN n_keys > 4 THEN 'extra_key' ELSE 'valid' END AS error, CASE WHEN NOT valid THEN 'reject' WHEN task IS NULL OR status IS NULL THEN 'repair_once' WHEN status NOT IN ('ready', 'blocked', 'done') THEN 'quarantine' ELSE 'accept' END AS policy FROM parsed"""

# each streamed call once, when its arguments are whole
OPERATORS["tool_call_buffer"] = """
WITH joined AS (SELECT stream_id, idx, count(*) AS n_deltas, JOINED(n, piece) AS args FROM {deltas} GROUP BY stream_id, idx)
SELECT stream_id, idx, n_deltas, SHA256(args) AS args_sha256, CASE WHEN JSON_VALID(args) THEN 'completed' ELSE 'malformed' END AS verdict FROM joined"""

_LINES = "lined AS (SELECT doc_id, line_no, line, below, above FROM {around} src)"

OPERATORS["lines_setext_underlines"] = rf"""
WITH {_LINES},
heads AS (SELECT doc_id, line_no, CASE WHEN REGEX_MATCH(below, '^ {{0,3}}=') THEN 'h1' ELSE 'h2' END AS level, length(trim(line)) AS n_text, length(trim(below)) AS n_under FROM lined WHERE REGEX_MATCH(below, '^ {{0,3}}(?:=+|-+)[ \t]*$') AND trim(line) <> '' AND NOT REGEX_MATCH(line, '^ {{0,3}}(?:[#>|=-]|[*+] |[0-9]+[.)] |```|~~~)'))
SELECT doc_id, line_no, level, n_text, n_under, n_under <> n_text AS length_mismatch, CASE WHEN n_under < n_text THEN concat('setext_underline_too_short_', level) ELSE 'long_enough' END AS kind FROM heads"""

OPERATORS["lines_table_rules"] = r"""
WITH ruled AS (SELECT doc_id, line_no, REGEX_ALL(line, '(-+)', 1) AS dashes FROM {lines} src WHERE REGEX_MATCH(line, '^[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)+\|?[ \t]*$')),
parts AS (SELECT doc_id, line_no, EXPLODE(dashes) AS dash FROM ruled),
each AS (SELECT doc_id, line_no, length(dash) AS n FROM parts)
SELECT doc_id, line_no, count(*) AS n_columns, CAST(min(n) AS BIGINT) AS fewest, CAST(max(n) AS BIGINT) AS most, min(n) <> max(n) AS inconsistent FROM each GROUP BY doc_id, line_no"""

# items of each list: how they end, whether they are empty or capitalised, and which do not as most do
OPERATORS["lines_bullet_ends"] = r"""
WITH items AS (SELECT doc_id, line_no, line, trim(REGEX_REPLACE(line, '^[ \t]*(?:[-*+]|[0-9]+[.)])(?:[ \t]+|$)', '')) AS body FROM {lines} src WHERE REGEX_MATCH(line, '^[ \t]*(?:[-*+]|[0-9]+[.)])(?:[ \t]|$)')),
placed AS (SELECT doc_id, line_no, line, body, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM items),
judged AS (SELECT doc_id, island, CASE WHEN body = '' THEN 'empty' WHEN REGEX_MATCH(body, '[.!?]$') THEN 'full' WHEN REGEX_MATCH(body, '[;,:]$') THEN 'half' ELSE 'none' END AS ending, CASE WHEN REGEX_MATCH(line, '[ \t]+$') THEN 1 ELSE 0 END AS blanks_behind, CASE WHEN REGEX_MATCH(body, '^[A-Z]') THEN 1 ELSE 0 END AS capital, CASE WHEN REGEX_MATCH(body, '[.!?] [A-Z]') THEN 1 ELSE 0 END AS sentences FROM placed)
SELECT doc_id, island, count(*) AS n_items, CAST(sum(CASE WHEN ending = 'empty' THEN 1 ELSE 0 END) AS BIGINT) AS empty_item, CAST(sum(blanks_behind) AS BIGINT) AS trailing_whitespace, count(DISTINCT CASE WHEN ending <> 'empty' THEN ending END) > 1 AS mixed_terminator,
  CAST(CASE WHEN 2 * sum(CASE WHEN ending = 'none' THEN 1 ELSE 0 END) > count(*) THEN sum(sentences) ELSE 0 END AS BIGINT) AS sentence_in_fragment_list, sum(capital) > 0 AND sum(capital) < count(*) AS inconsistent_capitalization FROM judged GROUP BY doc_id, island"""


def inputs_of(sql: str) -> list[str]:
    return [n for n in dict.fromkeys(re.findall(r"\{([a-z]+)\}", sql)) if n in INPUTS]


def apply(spark: SparkSession, name: str, **frames: DataFrame) -> DataFrame:
    """Run an operator on DataFrames that have the columns of its inputs; null keys form groups of their own, repeated
    rows count, no rows in, none out."""
    if name in PLANS:
        return PLANS[name](spark, **frames)
    return dialect.run(spark, "", OPERATORS[name], frames)


def query(spark: SparkSession, folder: str, name: str, **frames: DataFrame) -> DataFrame:
    """The operator over the tables of a folder."""
    made = {n: dialect.run(spark, folder, INPUTS[n]) for n in inputs_of(OPERATORS[name])}
    return apply(spark, name, **made, **frames)


def oracle(name: str, **frames: str) -> str:
    """The same for DuckDB."""
    made = {n: dialect.oracle(INPUTS[n]) for n in inputs_of(OPERATORS[name])}
    return dialect.oracle(OPERATORS[name], {**made, **frames})
