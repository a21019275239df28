"""Audits, costs, baselines and conversations: relational operators over records, each one SQL text.

Every operator partitions by its entity (tool, user, conversation, order) and
aggregates before it joins; nothing is collected.  The texts run on Spark and,
through the same macros, on DuckDB.  Fixed values: names of verdicts, thresholds
and windows, as the findings are defined by them.
"""

from __future__ import annotations

QUERIES: dict[str, str] = {}

# --- traces and logs --------------------------------------------------------

QUERIES["tool_call_loops"] = """
WITH ranked AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM {events}),
tail AS (SELECT user_id, event_type, back FROM ranked WHERE back <= 8),
worst AS (SELECT user_id, max(n) AS worst, count(*) AS n_distinct, CAST(sum(n) AS BIGINT) AS n_calls FROM (SELECT user_id, event_type, count(*) AS n FROM tail GROUP BY user_id, event_type) x GROUP BY user_id),
ends AS (SELECT user_id, max(CASE WHEN back = 1 THEN event_type END) AS e1, max(CASE WHEN back = 2 THEN event_type END) AS e2, max(CASE WHEN back = 3 THEN event_type END) AS e3, max(CASE WHEN back = 4 THEN event_type END) AS e4 FROM tail GROUP BY user_id)
SELECT worst.user_id, n_calls, n_distinct, worst, CASE WHEN n_calls < 3 THEN 'insufficient_history' WHEN worst >= 3 THEN 'exact_repeat' WHEN e1 = e3 AND e2 = e4 AND e1 <> e2 THEN 'abab_cycle' ELSE 'ok' END AS verdict
FROM worst JOIN ends ON worst.user_id = ends.user_id"""

QUERIES["output_size_findings"] = """
WITH sizes AS (SELECT tool, size, count(*) AS c FROM (SELECT event_type AS tool, CAST(floor(abs(value) * 100) AS BIGINT) AS size FROM {events}) x GROUP BY tool, size),
ranked AS (SELECT tool, size, c, sum(c) OVER (PARTITION BY tool ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(c) OVER (PARTITION BY tool) AS n FROM sizes),
middle AS (SELECT tool, CAST(max(n) AS BIGINT) AS n, count(*) AS n_sizes, (min(CASE WHEN 2 * upto >= n THEN size END) + min(CASE WHEN 2 * upto > n THEN size END)) / 2.0 AS med FROM ranked GROUP BY tool),
apart AS (SELECT s.tool, abs(s.size - m.med) AS away, sum(s.c) AS c FROM sizes s JOIN middle m ON s.tool = m.tool GROUP BY s.tool, abs(s.size - m.med)),
spans AS (SELECT tool, away, sum(c) OVER (PARTITION BY tool ORDER BY away ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(c) OVER (PARTITION BY tool) AS n FROM apart),
spread AS (SELECT tool, (min(CASE WHEN 2 * upto >= n THEN away END) + min(CASE WHEN 2 * upto > n THEN away END)) / 2.0 AS mad FROM spans GROUP BY tool)
SELECT m.tool, m.n, CAST(sum(CASE WHEN c.size = 0 THEN c.c ELSE 0 END) AS BIGINT) AS empty_output,
  CAST(sum(CASE WHEN s.mad > 0 AND c.size > m.med + 6 * s.mad THEN c.c ELSE 0 END) AS BIGINT) AS size_outlier_high,
  CAST(sum(CASE WHEN s.mad > 0 AND c.size > 0 AND c.size < m.med - 6 * s.mad AND m.med > 64 THEN c.c ELSE 0 END) AS BIGINT) AS size_outlier_low,
  CAST(sum(CASE WHEN c.size BETWEEN 1014 AND 1024 OR c.size BETWEEN 2028 AND 2048 OR c.size BETWEEN 4056 AND 4096 OR c.size BETWEEN 8111 AND 8192 OR c.size BETWEEN 16221 AND 16384 OR c.size BETWEEN 32441 AND 32768 OR c.size BETWEEN 64881 AND 65536 OR c.size BETWEEN 129762 AND 131072 THEN c.c ELSE 0 END) AS BIGINT) AS size_at_round_cap,
  max(CASE WHEN m.n >= 5 AND m.n_sizes = 1 THEN 1 ELSE 0 END) AS variance_collapse
FROM sizes c JOIN middle m ON c.tool = m.tool JOIN spread s ON c.tool = s.tool GROUP BY m.tool, m.n"""

QUERIES["timestamp_monotonicity"] = """
WITH steps AS (SELECT user_id, EPOCH(ts) AS t, lag(EPOCH(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS before, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS ts_before, ts FROM {events})
SELECT user_id, count(*) AS n_calls, CAST(sum(CASE WHEN ts < ts_before THEN 1 ELSE 0 END) AS BIGINT) AS non_monotonic, CAST(sum(CASE WHEN ts = ts_before THEN 1 ELSE 0 END) AS BIGINT) AS duplicate_timestamp, CAST(sum(CASE WHEN t - before > 60 THEN 1 ELSE 0 END) AS BIGINT) AS clock_gap FROM steps GROUP BY user_id"""

QUERIES["retry_backoff_fairness"] = """
WITH marked AS (SELECT user_id, event_id, EPOCH(ts) AS t, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lag(EPOCH(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t_before FROM {events}),
retries AS (SELECT user_id, event_id, t - t_before AS delay FROM marked WHERE before = 'error'),
ratios AS (SELECT user_id, delay, lag(delay) OVER (PARTITION BY user_id ORDER BY event_id) AS delay_before FROM retries)
SELECT user_id, count(*) AS n_retries, CAST(sum(CASE WHEN delay < 60 THEN 1 ELSE 0 END) AS BIGINT) AS hot_retry, CAST(sum(CASE WHEN delay <= delay_before THEN 1 ELSE 0 END) AS BIGINT) AS flat_or_shrinking, CAST(sum(CASE WHEN delay > delay_before AND delay < 2 * delay_before THEN 1 ELSE 0 END) AS BIGINT) AS ratio_below_target FROM ratios GROUP BY user_id"""

QUERIES["span_orphans"] = """
WITH roots AS (SELECT o_orderkey AS span_id FROM {orders} WHERE o_orderkey % 7 <> 0),
spans AS (SELECT l_orderkey AS parent_id, l_linenumber AS n FROM {lineitem})
SELECT s.parent_id, count(*) AS n_orphans, min(s.n) AS first_orphan FROM spans s LEFT ANTI JOIN roots r ON s.parent_id = r.span_id GROUP BY s.parent_id"""

QUERIES["argument_drift"] = """
WITH attempts AS (SELECT l_orderkey AS call_id, l_linenumber AS attempt_no, l_shipdate, l_returnflag, l_linestatus FROM {lineitem}),
firsts AS (SELECT call_id, l_returnflag, l_linestatus FROM attempts WHERE attempt_no = 1)
SELECT a.call_id, count(*) AS n_attempts, CAST(sum(CASE WHEN a.l_returnflag <> f.l_returnflag THEN 1 ELSE 0 END) AS BIGINT) AS flag_changed, CAST(sum(CASE WHEN a.l_linestatus <> f.l_linestatus THEN 1 ELSE 0 END) AS BIGINT) AS status_changed
FROM attempts a JOIN firsts f ON a.call_id = f.call_id GROUP BY a.call_id"""

QUERIES["duplicate_attempts"] = """
SELECT call_id, attempt_no, count(*) AS n FROM (SELECT o_custkey AS call_id, o_orderpriority AS attempt_no FROM {orders}) x GROUP BY call_id, attempt_no HAVING count(*) > 1"""

QUERIES["decision_log_fields"] = """
SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN ts IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_ts, CAST(sum(CASE WHEN user_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_mission, CAST(sum(CASE WHEN value < 0 THEN 1 ELSE 0 END) AS BIGINT) AS bad_step_index, CAST(sum(CASE WHEN event_type IN ('view', 'click', 'signup', 'purchase', 'error') THEN 0 ELSE 1 END) AS BIGINT) AS unknown_state FROM {events} GROUP BY event_type"""

QUERIES["replay_fingerprints"] = """
SELECT SHA256(concat(event_type, '|', props)) AS fingerprint, count(*) AS n, min(event_id) AS first_id FROM {events} GROUP BY SHA256(concat(event_type, '|', props))"""

QUERIES["hash_chain_links"] = """
WITH hashed AS (SELECT event_id, user_id, SHA256(concat(CAST(event_id AS STRING), '|', event_type, '|', props)) AS own FROM {events}),
chained AS (SELECT event_id, user_id, own, lag(own) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM hashed)
SELECT event_id, user_id, SHA256(concat(coalesce(before, 'genesis'), own)) AS link FROM chained"""

# --- costs, budgets and routing ---------------------------------------------

PRICES = "(VALUES ('view', 0.1, 0.2), ('click', 0.3, 0.6), ('purchase', 3.0, 15.0), ('error', 0.0, 0.0)) AS p(model, input_rate, output_rate)"

QUERIES["token_costs"] = f"""
WITH used AS (SELECT event_type AS model, CAST(ts AS DATE) AS day, CAST(floor(abs(value) * 10) AS BIGINT) AS tokens FROM {{events}}),
summed AS (SELECT model, day, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens FROM used GROUP BY model, day)
SELECT s.model, s.day, s.calls, s.tokens, CAST(coalesce(s.tokens * (p.input_rate + p.output_rate), 0) AS DOUBLE) AS cost FROM summed s LEFT JOIN {PRICES} ON s.model = p.model"""

QUERIES["soft_fence"] = """
WITH spent AS (SELECT user_id, event_id, sum(CAST(floor(abs(value)) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM {events})
SELECT user_id, CAST(max(running) AS BIGINT) AS spent, min(CASE WHEN running >= 600 THEN event_id END) AS warn_60, min(CASE WHEN running >= 850 THEN event_id END) AS warn_85, min(CASE WHEN running >= 950 THEN event_id END) AS warn_95, min(CASE WHEN running >= 1000 THEN event_id END) AS hard_stop FROM spent GROUP BY user_id"""

QUERIES["burn_rate"] = """
WITH last AS (SELECT max(EPOCH(ts)) AS now FROM {events}),
recent AS (SELECT e.user_id, CAST(floor(abs(e.value)) AS BIGINT) AS spend FROM {events} e CROSS JOIN last WHERE EPOCH(e.ts) > last.now - 864000),
total AS (SELECT user_id, CAST(sum(CAST(floor(abs(value)) AS BIGINT)) AS BIGINT) AS spent FROM {events} GROUP BY user_id)
SELECT t.user_id, t.spent, CAST(coalesce(r.recent, 0) AS BIGINT) AS recent, CASE WHEN r.recent IS NULL OR r.recent = 0 THEN 'no_signal' WHEN t.spent >= 5000 THEN 'exhausted' WHEN (5000 - t.spent) * 864000 < r.recent * 259200 THEN 'hard' WHEN (5000 - t.spent) * 864000 < r.recent * 864000 THEN 'soft' ELSE 'ok' END AS verdict
FROM total t LEFT JOIN (SELECT user_id, CAST(sum(spend) AS BIGINT) AS recent FROM recent GROUP BY user_id) r ON t.user_id = r.user_id"""

QUERIES["latency_picker"] = """
WITH ranked AS (SELECT event_type AS rung, value AS latency, user_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS back FROM {events}),
stats AS (SELECT rung, count(*) AS n, percentile_disc(0.95) WITHIN GROUP (ORDER BY latency) AS p95, CAST(sum(CASE WHEN user_id % 10 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS failures FROM ranked WHERE back <= 200 GROUP BY rung)
SELECT rung, n, p95, failures, row_number() OVER (ORDER BY CASE WHEN failures * 100 > n * 25 THEN 1 ELSE 0 END, p95, rung) AS pick_order FROM stats"""

QUERIES["fallback_ladder"] = """
WITH tried AS (SELECT o_orderkey, o_orderstatus, CAST(substr(o_orderpriority, 1, 1) AS INT) AS rung FROM {orders})
SELECT rung, count(*) AS calls, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS failures, CAST(sum(count(*)) OVER (ORDER BY rung ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS reached FROM tried GROUP BY rung"""

QUERIES["backoff_plan"] = """
SELECT s_suppkey AS call_id, n.attempt, CAST(least(30000, 100 * power(2, n.attempt - 1)) AS BIGINT) AS delay_ms FROM {supplier} CROSS JOIN (VALUES (1), (2), (3), (4), (5), (6), (7), (8), (9), (10)) AS n(attempt) WHERE n.attempt <= s_suppkey % 10"""

QUERIES["cost_envelope"] = """
WITH calls AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(floor(abs(value)) AS BIGINT) AS cost FROM {events}),
days AS (SELECT user_id, day, CAST(sum(cost) AS BIGINT) AS day_cost, max(cost) AS call_cost FROM calls GROUP BY user_id, day)
SELECT user_id, day, day_cost, call_cost, CASE WHEN call_cost > 480 THEN 'deny_call' WHEN day_cost > 900 THEN 'deny_day' WHEN day_cost > 600 THEN 'degrade' ELSE 'allow' END AS decision FROM days"""

# --- baselines --------------------------------------------------------------

_DAILY = "daily AS (SELECT event_type AS metric, CAST(ts AS DATE) AS d, CAST(count(*) AS DOUBLE) AS v FROM {events} GROUP BY event_type, CAST(ts AS DATE))"

QUERIES["zscore_baseline"] = f"""
WITH {_DAILY},
base AS (SELECT metric, d, v, avg(v) OVER w AS mean, stddev_samp(v) OVER w AS sd, count(v) OVER w AS n FROM daily WINDOW w AS (PARTITION BY metric ORDER BY d ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
SELECT metric, d, v, n, CASE WHEN n < 2 THEN 'insufficient_data' WHEN sd = 0 AND v = mean THEN 'clean' WHEN sd = 0 THEN 'anomaly' WHEN abs(v - mean) >= 2.0 * sd THEN 'anomaly' ELSE 'clean' END AS verdict FROM base"""

def _middle(values: str) -> str:
    """The median of a sorted list."""
    return f"(AT({values}, floor((ITEMS({values}) + 1) / 2)) + AT({values}, floor(ITEMS({values}) / 2) + 1)) / 2.0"


# one window hands each day its last fortnight; medians are those of lists
QUERIES["mad_baseline"] = f"""
WITH {_DAILY},
based AS (SELECT metric, d, v, SORTED(LIST(v) OVER (PARTITION BY metric ORDER BY d ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)) AS past FROM daily),
mids AS (SELECT metric, d, v, past, CAST(coalesce(ITEMS(past), 0) AS BIGINT) AS n, CASE WHEN ITEMS(past) > 0 THEN {_middle('past')} END AS med FROM based),
aways AS (SELECT metric, d, v, n, med, CASE WHEN n > 0 THEN SORTED(AWAY(past, med)) END AS away FROM mids),
mads AS (SELECT metric, d, v, n, med, CASE WHEN n > 0 THEN {_middle('away')} END AS mad FROM aways)
SELECT metric, d, v, n, CASE WHEN n < 2 THEN 'insufficient_data' WHEN mad = 0 AND v = med THEN 'clean' WHEN mad = 0 THEN 'anomaly' WHEN abs(v - med) >= 2.0 * 1.4826 * mad THEN 'anomaly' ELSE 'clean' END AS verdict FROM mads"""

# exponentially weighted mean and deviation of span 7 (alpha 1/4), summed in closed form: a value's weight falls by 3/4 a day
_EWMA = "PARTITION BY metric ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
QUERIES["ewma_baseline"] = f"""
WITH {_DAILY},
numbered AS (SELECT metric, d, v, CAST(row_number() OVER (PARTITION BY metric ORDER BY d) AS DOUBLE) AS k FROM daily),
means AS (SELECT metric, d, v, k, sum(CASE WHEN k = 1 THEN v ELSE 0.25 * v END * power(0.75, -k)) OVER ({_EWMA}) * power(0.75, k) AS ewma FROM numbered),
steps AS (SELECT metric, d, v, k, lag(ewma) OVER (PARTITION BY metric ORDER BY d) AS mean FROM means),
spread AS (SELECT metric, d, v, k, mean, sum(CASE WHEN k = 1 THEN 0 ELSE 0.25 * (v - mean) * (v - mean) * power(0.75, -k) END) OVER ({_EWMA}) * power(0.75, k) AS var FROM steps),
scored AS (SELECT metric, d, v, k, mean, lag(var) OVER (PARTITION BY metric ORDER BY d) AS var FROM spread)
SELECT metric, d, v, CAST(k - 1 AS BIGINT) AS n, round(mean, 6) AS ewma, round(sqrt(var), 6) AS ewmsd, CASE WHEN k - 1 < 7 THEN 'insufficient_data' WHEN var < 1e-18 AND abs(v - mean) < 1e-9 THEN 'clean' WHEN var < 1e-18 THEN 'anomaly' WHEN abs(v - mean) >= 2.0 * sqrt(var) THEN 'anomaly' ELSE 'clean' END AS verdict FROM scored"""

QUERIES["alert_noise_budget"] = f"""
WITH {_DAILY},
base AS (SELECT metric, d, v, avg(v) OVER w AS mean, stddev_samp(v) OVER w AS sd, count(v) OVER w AS n FROM daily WINDOW w AS (PARTITION BY metric ORDER BY d ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
scored AS (SELECT metric, d, abs(v - mean) / sd AS score FROM base WHERE n >= 2 AND sd > 0)
SELECT s.metric, t.threshold, CAST(sum(CASE WHEN s.score >= t.threshold THEN 1 ELSE 0 END) AS BIGINT) AS fires, count(*) AS n_days, CASE WHEN sum(CASE WHEN s.score >= t.threshold THEN 1 ELSE 0 END) * 7 <= count(*) THEN 'within_budget' ELSE 'noisy' END AS verdict
FROM scored s CROSS JOIN (VALUES (1.25), (1.75), (2.25), (2.75), (3.25)) AS t(threshold) GROUP BY s.metric, t.threshold"""

QUERIES["daily_alerts"] = f"""
WITH {_DAILY}
SELECT d, count(*) AS n_metrics, CAST(sum(v) AS BIGINT) AS total, CAST(sum(CASE WHEN v > 300 THEN 1 ELSE 0 END) AS BIGINT) AS fired FROM daily GROUP BY d"""

# --- prompts and redaction --------------------------------------------------

# Patterns begin only at a word's edge, and a text is searched only if it holds what the pattern must.
_EMAIL, _CARD, _IP = r"\b[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,255}\.[A-Za-z]{2,24}", r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"


def _luhn(digits: str) -> str:
    """Whether sixteen digits pass the check sum: every second one doubled, from the left."""
    terms = []
    for i in range(1, 17):
        d = f"CAST(substr({digits}, {i}, 1) AS INT)"
        terms.append(f"CASE WHEN {d} > 4 THEN 2 * {d} - 9 ELSE 2 * {d} END" if i % 2 else d)
    return f"({' + '.join(terms)}) % 10 = 0"


QUERIES["pii_redaction"] = rf"""
SELECT doc_id, SHA256(clean) AS clean_sha256, length(clean) AS n_clean, n_email, n_card, n_ip FROM (
SELECT doc_id, n_email, n_card, n_ip, CASE WHEN n_ip > 0 THEN REGEX_REPLACE(no_cards, '{_IP}', '<IPV4>') ELSE no_cards END AS clean FROM (
SELECT doc_id, n_email, n_card, n_ip, CASE WHEN n_card > 0 THEN REGEX_REPLACE(no_mail, '{_CARD}', '<CARD>') ELSE no_mail END AS no_cards FROM (
SELECT doc_id, n_email, n_card, n_ip, CASE WHEN n_email > 0 THEN REGEX_REPLACE(text, '{_EMAIL}', '<EMAIL>') ELSE text END AS no_mail FROM (
SELECT doc_id, text, CASE WHEN contains(text, '@') THEN REGEX_COUNT(text, '{_EMAIL}') ELSE 0 END AS n_email, CASE WHEN REGEX_MATCH(text, '[0-9]{{4}}') THEN REGEX_COUNT(text, '{_CARD}') ELSE 0 END AS n_card, CASE WHEN REGEX_MATCH(text, '[0-9][.][0-9]') THEN REGEX_COUNT(text, '{_IP}') ELSE 0 END AS n_ip FROM {{documents}}) a) b) c) x"""

# one number for each value of a kind in a document, in order of the values: what numbered redaction writes
QUERIES["pii_numbers"] = rf"""
WITH found AS (SELECT doc_id, 'EMAIL' AS kind, EXPLODE(REGEX_ALL(text, '({_EMAIL})', 1)) AS value FROM {{documents}} WHERE contains(text, '@')
UNION ALL SELECT doc_id, 'IPV4' AS kind, EXPLODE(REGEX_ALL(text, '({_IP})', 1)) AS value FROM {{documents}} WHERE REGEX_MATCH(text, '[0-9][.][0-9]')
UNION ALL SELECT doc_id, 'CARD' AS kind, REGEX_REPLACE(value, '[ -]', '') AS value FROM (SELECT doc_id, EXPLODE(REGEX_ALL(text, '({_CARD})', 1)) AS value FROM {{documents}} WHERE REGEX_MATCH(text, '[0-9]{{4}}')) cards
UNION ALL SELECT doc_id, 'TOKEN' AS kind, EXPLODE(REGEX_ALL(text, '\b(AKIA[0-9A-Z]{{16}}|ghp_[A-Za-z0-9]{{36}}|eyJ[A-Za-z0-9_-]{{8,}}\.[A-Za-z0-9_-]{{8,}}\.[A-Za-z0-9_-]{{4,}})', 1)) AS value FROM {{documents}}),
counted AS (SELECT doc_id, kind, value, count(*) AS n FROM found WHERE kind <> 'CARD' OR {_luhn('value')} GROUP BY doc_id, kind, value)
SELECT doc_id, concat('<', kind, '_', CAST(row_number() OVER (PARTITION BY doc_id, kind ORDER BY value) AS STRING), '>') AS token, SHA256(value) AS value_sha256, n FROM counted"""

QUERIES["content_safety"] = r"""
SELECT doc_id, n_slur, n_secret, CASE WHEN n_secret > 0 THEN 'block' WHEN n_slur >= 3 THEN 'block' WHEN n_slur > 0 THEN 'review' ELSE 'allow' END AS action FROM (SELECT doc_id, REGEX_COUNT(lower(text), '\b(?:idiot|moron|scum|trash|loser)\b') AS n_slur, REGEX_COUNT(text, '\b\d{16}\b') AS n_secret FROM {documents}) x"""

QUERIES["prompt_fingerprints"] = """
SELECT conv_id, SHA256(content) AS cache_hash, SHA256(trim(lower(REGEX_REPLACE(content, '[ \t\n]+', ' ')))) AS semantic_hash, length(content) AS n_chars FROM (SELECT conv_id, text AS content FROM {conversations} WHERE turn = 0) x"""

QUERIES["prompt_drift"] = """
WITH a AS (SELECT source AS section, CAST(sum(n_chars) AS BIGINT) AS size FROM {documents} WHERE doc_id % 2 = 0 AND source <> 'src3' GROUP BY source),
b AS (SELECT source AS section, CAST(sum(n_chars) AS BIGINT) AS size FROM {documents} WHERE doc_id % 2 = 1 AND source <> 'src4' GROUP BY source)
SELECT coalesce(a.section, b.section) AS section, a.size AS before, b.size AS after, CASE WHEN a.section IS NULL THEN 'section_added' WHEN b.section IS NULL THEN 'section_removed' WHEN abs(a.size - b.size) * 4 > a.size THEN 'size_drift' ELSE 'same' END AS kind FROM a FULL OUTER JOIN b ON a.section = b.section"""

QUERIES["result_size_limits"] = """
SELECT doc_id, length(text) AS n_chars, CASE WHEN length(text) <= 2000 THEN 'fits' ELSE 'sandwiched' END AS verdict, SHA256(CASE WHEN length(text) <= 2000 THEN text ELSE concat(substr(text, 1, 1400), ' [cut] ', substr(text, length(text) - 599, 600)) END) AS result_sha256 FROM {documents}"""

# --- conversations ----------------------------------------------------------

QUERIES["role_sequences"] = """
WITH ordered AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM {conversations})
SELECT conv_id, count(*) AS n_turns, max(CASE WHEN k = 1 AND role <> 'system' THEN 1 ELSE 0 END) AS bad_first_role, CAST(sum(CASE WHEN role = 'system' AND k > 1 THEN 1 ELSE 0 END) AS BIGINT) AS duplicate_system, CAST(sum(CASE WHEN role = before AND role = 'assistant' THEN 1 ELSE 0 END) AS BIGINT) AS consecutive_assistant, CAST(sum(CASE WHEN role = before AND role = 'user' THEN 1 ELSE 0 END) AS BIGINT) AS consecutive_user, CAST(sum(CASE WHEN role IN ('system', 'user', 'assistant', 'tool') THEN 0 ELSE 1 END) AS BIGINT) AS unknown_role FROM ordered GROUP BY conv_id"""

_TURNS = "turns AS (SELECT conv_id, turn, role, REGEX_COUNT(text, '[^ \\t\\n\\r]+') + 2 AS tokens FROM {conversations})"

QUERIES["turn_pruning"] = f"""
WITH {_TURNS},
numbered AS (SELECT conv_id, turn, role, tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM turns WHERE role <> 'system')
SELECT conv_id, count(*) AS n_turns, CAST(sum(CASE WHEN k <= 1 OR back <= 2 THEN 1 ELSE 0 END) AS BIGINT) AS n_kept, CAST(sum(CASE WHEN k <= 1 OR back <= 2 THEN tokens ELSE 0 END) AS BIGINT) AS kept_tokens, CAST(sum(CASE WHEN k <= 1 OR back <= 2 THEN 0 ELSE tokens END) AS BIGINT) AS dropped_tokens FROM numbered GROUP BY conv_id"""

QUERIES["relevance_pruning"] = f"""
WITH {_TURNS},
scored AS (SELECT conv_id, turn, tokens, sum(tokens) OVER (PARTITION BY conv_id ORDER BY CASE WHEN role = 'system' THEN 0 ELSE 1 END, tokens, turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM turns)
SELECT conv_id, turn, tokens, CAST(running AS BIGINT) AS running, running <= 120 AS kept FROM scored"""

QUERIES["summary_window"] = f"""
WITH {_TURNS},
sized AS (SELECT conv_id, turn, tokens, CAST(sum(tokens) OVER (PARTITION BY conv_id) AS BIGINT) AS total, CAST(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS from_end FROM turns)
SELECT conv_id, max(total) AS total, CAST(sum(CASE WHEN total > 160 AND from_end > 80 THEN 1 ELSE 0 END) AS BIGINT) AS to_summarise, max(total) > 160 AS should_compress FROM sized GROUP BY conv_id"""

QUERIES["budget_allocation"] = """
WITH sections AS (SELECT l_orderkey AS prompt, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS priority, CAST(l_quantity AS BIGINT) AS tokens FROM {lineitem}),
running AS (SELECT prompt, priority, tokens, coalesce(CAST(sum(tokens) OVER (PARTITION BY prompt ORDER BY priority ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before FROM sections)
SELECT prompt, priority, tokens, greatest(0, least(tokens, 80 - before)) AS granted, CASE WHEN before + tokens <= 80 THEN 'intact' WHEN before < 80 THEN 'truncated' ELSE 'dropped' END AS status FROM running"""

QUERIES["numeric_grounding"] = r"""
WITH said AS (SELECT conv_id, turn, role, concat(text, ' ', CAST((conv_id * 7 + turn) % 23 AS STRING), ' ', CAST(turn * 1.5 AS STRING), '%') AS text FROM {conversations}),
numbers AS (SELECT conv_id, role, EXPLODE(REGEX_ALL(text, '([0-9]+(?:[.][0-9]+)?%?)', 1)) AS number FROM said),
claimed AS (SELECT conv_id, number, count(*) AS n FROM numbers WHERE role = 'assistant' GROUP BY conv_id, number),
known AS (SELECT DISTINCT conv_id, number FROM numbers WHERE role <> 'assistant')
SELECT c.conv_id, count(*) AS n_numbers, CAST(sum(CASE WHEN k.number IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS ungrounded, CASE WHEN sum(CASE WHEN k.number IS NULL THEN 1 ELSE 0 END) = 0 THEN 'grounded' ELSE 'ungrounded' END AS verdict
FROM claimed c LEFT JOIN known k ON c.conv_id = k.conv_id AND c.number = k.number GROUP BY c.conv_id"""

QUERIES["instruction_conflicts"] = r"""
WITH clauses AS (SELECT conv_id, turn, lower(text) AS text, CASE WHEN turn % 4 < 2 THEN 'always' ELSE 'never' END AS polarity FROM {conversations} WHERE role <> 'assistant'),
words AS (SELECT DISTINCT conv_id, turn, polarity, EXPLODE(REGEX_ALL(text, '([a-z]{5,})', 1)) AS word FROM clauses),
shared AS (SELECT a.conv_id, a.turn AS one, b.turn AS other, count(*) AS n FROM words a JOIN words b ON a.conv_id = b.conv_id AND a.word = b.word AND a.turn < b.turn AND a.polarity <> b.polarity GROUP BY a.conv_id, a.turn, b.turn)
SELECT conv_id, one, other, n AS shared_words FROM shared WHERE n >= 1"""

# --- payloads, grading and routing ------------------------------------------

QUERIES["partial_failures"] = """
WITH counted AS (SELECT l_orderkey, count(*) AS n, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS failed, CAST(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS ok FROM {lineitem} GROUP BY l_orderkey)
SELECT l_orderkey, n, ok, failed, n - ok - failed AS skipped, CASE WHEN ok = n THEN 'all_ok' WHEN failed = n THEN 'all_failed' WHEN ok * 2 >= n THEN 'quorum_ok' ELSE 'quorum_failed' END AS verdict FROM counted"""

QUERIES["error_taxonomy"] = """
SELECT class, attribution, retryable, count(*) AS n FROM (SELECT CASE WHEN status = 429 THEN 'rate_limited' WHEN status = 401 OR status = 403 THEN 'auth' WHEN status = 408 OR status = 504 THEN 'timeout' WHEN status >= 500 THEN 'server_error' WHEN status >= 400 THEN 'bad_request' ELSE 'unknown' END AS class, CASE WHEN status >= 500 OR status = 429 THEN 'vendor' WHEN status >= 400 THEN 'caller' ELSE 'host' END AS attribution, status = 429 OR status = 408 OR status >= 500 AS retryable FROM (SELECT CASE CAST(event_id % 9 AS INT) WHEN 0 THEN 429 WHEN 1 THEN 401 WHEN 2 THEN 403 WHEN 3 THEN 408 WHEN 4 THEN 504 WHEN 5 THEN 500 WHEN 6 THEN 400 WHEN 7 THEN 422 ELSE 0 END AS status FROM {events}) s) c GROUP BY class, attribution, retryable"""

QUERIES["argument_coercion"] = """
SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN TRY_CAST(raw AS BIGINT) IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS as_integer, CAST(sum(CASE WHEN raw IN ('true', 'false') THEN 1 ELSE 0 END) AS BIGINT) AS as_boolean, CAST(sum(CASE WHEN TRY_CAST(raw AS BIGINT) IS NULL AND raw NOT IN ('true', 'false') THEN 1 ELSE 0 END) AS BIGINT) AS uncoercible FROM (SELECT event_type, CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'true' WHEN 1 THEN concat('x', CAST(event_id AS STRING)) ELSE CAST(event_id AS STRING) END AS raw FROM {events}) x GROUP BY event_type"""

# names within two edits, a swap of neighbours being one: each name also stands with two letters swapped, and only names whose
# lengths differ by two at most meet, by length
_VARIANTS = "SELECT {0}, {0} AS variant, 0 AS cost FROM {1} UNION ALL SELECT {0}, concat(substr({0}, 1, i - 1), substr({0}, i + 1, 1), substr({0}, i, 1), substr({0}, i + 2)) AS variant, 1 AS cost FROM (SELECT {0}, EXPLODE(SERIES(1, length({0}) - 1)) AS i FROM {1} WHERE length({0}) > 1) {0}_swaps"
QUERIES["tool_name_suggestions"] = f"""
WITH asked AS (SELECT DISTINCT CASE WHEN event_id % 2 = 0 THEN concat(substr(event_type, 1, 2), 'x', substr(event_type, 3)) ELSE concat(substr(event_type, 2, 1), substr(event_type, 1, 1), substr(event_type, 3)) END AS name FROM {{events}}),
known AS (SELECT DISTINCT event_type AS tool FROM {{events}}),
names AS ({_VARIANTS.format('name', 'asked')}),
tools AS ({_VARIANTS.format('tool', 'known')}),
sized AS (SELECT name, variant, cost, EXPLODE(SERIES(length(name) - 2, length(name) + 2)) AS size FROM names),
near AS (SELECT n.name, t.tool, min(levenshtein(n.variant, t.variant) + n.cost + t.cost) AS distance FROM sized n JOIN tools t ON n.size = length(t.tool) GROUP BY n.name, t.tool),
ranked AS (SELECT name, tool, distance, row_number() OVER (PARTITION BY name ORDER BY distance, tool) AS k, lead(distance) OVER (PARTITION BY name ORDER BY distance, tool) AS runner_up FROM near WHERE distance <= 2)
SELECT name, tool AS best, CAST(distance AS BIGINT) AS distance, CASE WHEN distance = 0 THEN 'exact' WHEN runner_up = distance THEN 'ambiguous' ELSE 'suggest' END AS verdict FROM ranked WHERE k = 1"""

QUERIES["shadow_comparison"] = """
WITH prod AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM {orders} WHERE o_orderkey % 11 <> 3),
shadow AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM {orders} WHERE o_orderkey % 13 <> 4)
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN p.k IS NULL THEN 'shadow_only' WHEN s.k IS NULL THEN 'prod_only' WHEN p.s <> s.s THEN 'value_mismatch' ELSE 'same' END AS reason FROM prod p FULL OUTER JOIN shadow s ON p.k = s.k) x GROUP BY reason"""

QUERIES["trust_tiers"] = """
SELECT tier, count(*) AS n FROM (SELECT CASE greatest(CASE WHEN quality = 0 THEN 2 ELSE 0 END, CASE WHEN toxic = 1 THEN 2 ELSE 0 END, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END) WHEN 0 THEN 'auto_apply' WHEN 1 THEN 'shadow_apply' ELSE 'human_review' END AS tier FROM {labels}) x GROUP BY tier"""

QUERIES["eval_harness"] = """
SELECT d.source, count(*) AS n_cases, CAST(sum(CASE WHEN l.quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS passed FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY d.source"""

QUERIES["arbiter_winners"] = """
SELECT l_orderkey, l_suppkey AS winner, l_extendedprice AS score FROM (SELECT l_orderkey, l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_suppkey, l_linenumber) AS k FROM {lineitem}) x WHERE k = 1"""

QUERIES["permission_grants"] = """
WITH grants AS (SELECT * FROM (VALUES ('view', 20), ('click', 10), ('purchase', 5)) AS g(tool, quota)),
calls AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM {events})
SELECT c.user_id, c.event_type, count(*) AS n, CAST(sum(CASE WHEN g.tool IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS tool_not_in_grant, CAST(sum(CASE WHEN c.k > g.quota THEN 1 ELSE 0 END) AS BIGINT) AS call_quota_exhausted FROM calls c LEFT JOIN grants g ON c.event_type = g.tool GROUP BY c.user_id, c.event_type"""

QUERIES["template_versions"] = """
SELECT p_brand AS template, count(*) AS n_versions, max(p_size) AS resolved, max(CASE WHEN p_size < 25 THEN p_size END) AS resolved_below_25 FROM {part} GROUP BY p_brand"""

# --- embeddings -------------------------------------------------------------

QUERIES["embedding_guard"] = """
SELECT label, count(*) AS n, CAST(sum(CASE WHEN len <> 64 THEN 1 ELSE 0 END) AS BIGINT) AS dim_mismatch, CAST(sum(CASE WHEN vec_id % 17 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS model_id_mismatch, CASE WHEN sum(CASE WHEN len <> 64 THEN 1 ELSE 0 END) > 0 THEN 'reject' ELSE 'ok' END AS verdict FROM (SELECT vec_id, label, cardinality(embedding) AS len FROM {embeddings}) x GROUP BY label"""

QUERIES["embedding_staleness"] = """
SELECT kind, count(*) AS n FROM (SELECT CASE WHEN d.doc_id IS NULL THEN 'missing_source' WHEN e.vec_id % 5 > d.doc_id % 7 THEN 'mtime_drift' ELSE 'fresh' END AS kind FROM {embeddings} e LEFT JOIN {documents} d ON e.vec_id = d.doc_id) x GROUP BY kind"""

# --- streams in batch form --------------------------------------------------

QUERIES["chunk_gaps"] = """
WITH seqs AS (SELECT conv_id AS stream_id, turn AS seq, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_seq FROM {conversations} WHERE (conv_id + turn) % 6 <> 5)
SELECT stream_id, count(*) AS n_chunks, CAST(coalesce(sum(next_seq - seq - 1), 0) AS BIGINT) AS n_missing, min(seq) = 0 AND coalesce(sum(next_seq - seq - 1), 0) = 0 AS is_complete FROM seqs GROUP BY stream_id"""

QUERIES["cursor_verdicts"] = """
WITH arrived AS (SELECT user_id AS stream_id, event_id AS arrival, CAST(floor(abs(value)) AS BIGINT) AS seq FROM {events}),
seen AS (SELECT stream_id, arrival, seq, max(seq) OVER (PARTITION BY stream_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cursor_before FROM arrived)
SELECT stream_id, CAST(sum(CASE WHEN cursor_before IS NULL OR seq > cursor_before THEN 1 ELSE 0 END) AS BIGINT) AS accepted, CAST(sum(CASE WHEN seq = cursor_before THEN 1 ELSE 0 END) AS BIGINT) AS duplicate, CAST(sum(CASE WHEN seq < cursor_before THEN 1 ELSE 0 END) AS BIGINT) AS rewind FROM seen GROUP BY stream_id"""

QUERIES["keepalive_gaps"] = """
WITH steps AS (SELECT user_id, EPOCH(ts) - lag(EPOCH(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM {events})
SELECT user_id, count(*) AS n, max(gap) AS longest, CAST(sum(CASE WHEN gap > 86400 THEN 1 ELSE 0 END) AS BIGINT) AS dead, CAST(sum(CASE WHEN gap > 21600 AND gap <= 86400 THEN 1 ELSE 0 END) AS BIGINT) AS degraded FROM steps GROUP BY user_id"""

QUERIES["token_rate_meter"] = """
WITH timed AS (SELECT user_id, event_id, EPOCH(ts) AS t, CAST(floor(abs(value)) AS BIGINT) AS tokens FROM {events})
SELECT user_id, event_id, CAST(sum(tokens) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS BIGINT) AS tokens_in_day, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS calls_in_day FROM timed"""

QUERIES["cache_as_of"] = """
WITH written AS (SELECT user_id, event_id, EPOCH(ts) AS t, event_type, max(CASE WHEN event_type = 'purchase' THEN EPOCH(ts) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_write FROM {events})
SELECT user_id, CAST(sum(CASE WHEN t - last_write <= 172800 THEN 1 ELSE 0 END) AS BIGINT) AS hits, CAST(sum(CASE WHEN t - last_write > 172800 THEN 1 ELSE 0 END) AS BIGINT) AS expired, CAST(sum(CASE WHEN last_write IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS misses FROM written WHERE event_type = 'view' GROUP BY user_id"""

QUERIES["step_budgets"] = """
WITH steps AS (SELECT user_id, event_type AS phase, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM {events})
SELECT user_id, phase, count(*) AS steps, min(CASE WHEN k = 8 THEN event_id END) AS soft_at, min(CASE WHEN k = 10 THEN event_id END) AS hard_at FROM steps GROUP BY user_id, phase"""

QUERIES["idempotency_replays"] = """
SELECT user_id, event_type, CAST(ts AS DATE) AS day, count(*) AS n_calls, count(*) - 1 AS n_replayed, count(DISTINCT props) > 1 AS conflicting FROM {events} GROUP BY user_id, event_type, CAST(ts AS DATE)"""

# Dialect: DuckDB spells an anti join and an array's length differently.
DUCKDB_SPELLING = {" LEFT ANTI JOIN ": " ANTI JOIN ", "cardinality(embedding)": "len(embedding)"}
