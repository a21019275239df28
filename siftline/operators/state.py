"""Keyed state machines: pure steps, folded over the events of each key in order.

Each machine has a start state and ``step(state, t, kind, size) -> (state,
verdict, detail)``.  In batch, events are dealt by key and sorted within
partitions, and one pass keeps a single state: a key of any number of rows needs
no more memory.  ``siftline.streaming.keyed`` runs the same steps on a stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

State = tuple
Step = Callable[[State, float, str, float], tuple[State, str, float]]


@dataclass(frozen=True)
class Machine:
    start: State
    step: Step


def dedupe_window(seconds: float) -> Machine:
    """Forward the first of a key's requests; suppress those within ``seconds`` of the one forwarded. Detail: age."""

    def step(state: State, t: float, kind: str, size: float):
        first, hidden = state
        if first is None or t - first >= seconds:
            return (t, 0), "forward", 0.0
        return (first, hidden + 1), "suppress", t - first

    return Machine((None, 0), step)


def circuit_breaker(window: int, min_calls: int, rate: float, cooldown: float, probes: int = 1, successes: int = 2) -> Machine:
    """Closed until failures among the last ``window`` outcomes reach ``rate``; then open for ``cooldown`` seconds; then
    half open, where ``successes`` probes in a row close it and a failure opens it again. Detail: failure rate."""

    def step(state: State, t: float, kind: str, size: float):
        mode, outcomes, opened, in_a_row = state
        failed = kind == "error"
        if mode == "open" and t - opened >= cooldown:
            mode, in_a_row = "half_open", 0
        share = sum(outcomes) / len(outcomes) if outcomes else 0.0
        if mode == "open":
            return (mode, outcomes, opened, in_a_row), "denied_open", share
        if mode == "half_open":
            if failed:
                return ("open", outcomes, t, 0), "probe_failed", share
            in_a_row += 1
            if in_a_row >= successes:
                return ("closed", (), 0.0, 0), "closed", 0.0
            return (mode, outcomes, opened, in_a_row), "allow_probe", share
        outcomes = (*outcomes, int(failed))[-window:]
        share = sum(outcomes) / len(outcomes)
        if len(outcomes) >= min_calls and share >= rate:
            return ("open", outcomes, t, 0), "tripped", share
        return (mode, outcomes, opened, in_a_row), "allow", share

    return Machine(("closed", (), 0.0, 0), step)


def token_bucket(capacity: float, per_second: float) -> Machine:
    """Each event takes one token; tokens refill with time up to ``capacity``. Detail: seconds until the next token."""

    def step(state: State, t: float, kind: str, size: float):
        tokens, last = state
        tokens = capacity if last is None else min(capacity, tokens + max(0.0, t - last) * per_second)
        if tokens >= 1.0 - 1e-9:
            return (tokens - 1.0, t), "admitted", 0.0
        return (tokens, t), "throttled", (1.0 - tokens) / per_second

    return Machine((0.0, None), step)


def batching_window(seconds: float, most: int) -> Machine:
    """Calls join the open batch until it is ``seconds`` old, from its first call, or holds ``most``. Detail: place."""

    def step(state: State, t: float, kind: str, size: float):
        first, held = state
        if first is None or t - first >= seconds or held >= most:
            return (t, 1), "opened", 1.0
        held += 1
        return (first, held), "filled" if held == most else "joined", float(held)

    return Machine((None, 0), step)


def debouncer(seconds: float, characters: float) -> Machine:
    """Buffer output until ``seconds`` have gone by since the last flush or ``characters`` are held. Detail: flushed."""

    def step(state: State, t: float, kind: str, size: float):
        held, last = state
        last = t if last is None else last
        held += size
        if held >= characters or t - last >= seconds:
            return (0.0, t), "flush_size" if held >= characters else "flush_time", held
        return (held, last), "hold", 0.0

    return Machine((0.0, None), step)


def ttl_lru_cache(entries: int, ttl: float) -> Machine:
    """A cache keyed by the event's kind: hit, expired or miss; the least recently used goes first. Detail: entries."""

    def step(state: State, t: float, kind: str, size: float):
        held = list(state)  # least recent first: (kind, written)
        at = next((i for i, (k, _) in enumerate(held) if k == kind), None)
        if at is not None and t - held[at][1] <= ttl:
            held.append(held.pop(at))
            return tuple(held), "hit", float(len(held))
        verdict = "miss" if at is None else "expired"
        if at is not None:
            held.pop(at)
        held = [*held, (kind, t)]
        return tuple(held[-entries:]), verdict, float(min(len(held), entries))

    return Machine((), step)


def iteration_cap(most: int, stuck_after: int, cooldown: float) -> Machine:
    """Stop a loop after ``most`` steps; the same kind ``stuck_after`` times in a row is stuck. Detail: cooldown."""

    def step(state: State, t: float, kind: str, size: float):
        n, last, same = state
        same = same + 1 if kind == last else 1
        n += 1
        if n > most:
            return (n, kind, same), "capped", 0.0
        if same >= stuck_after:
            return (n, kind, same), "stuck", cooldown * 2 ** (same - stuck_after)
        return (n, kind, same), "continue", 0.0

    return Machine((0, None, 0), step)


def bounded_queue(capacity: float, per_second: float, most: int) -> Machine:
    """A token bucket with a queue of ``most`` in front: calls without a token wait, and are refused where the queue is
    full. Detail: seconds until a waiting call has its token, or the queue's length."""

    def step(state: State, t: float, kind: str, size: float):
        tokens, last, queue = state
        tokens = capacity if last is None else tokens + max(0.0, t - last) * per_second
        served = min(queue, int(tokens + 1e-9))  # those that wait go first
        tokens, queue = min(capacity, tokens - served), queue - served
        if not queue and tokens >= 1.0 - 1e-9:
            return (tokens - 1.0, t, 0), "admitted", 0.0
        if queue < most:
            return (tokens, t, queue + 1), "throttled", (queue + 1 - tokens) / per_second
        return (tokens, t, queue), "rejected", float(queue)

    return Machine((0.0, None, 0), step)


MACHINES = {
    "request_dedupe": dedupe_window(86_400.0),
    "circuit_breakers": circuit_breaker(8, 4, 0.5, 43_200.0),
    "retry_budgets": token_bucket(3.0, 1 / 43_200),
    "batching_windows": batching_window(172_800.0, 5),
    "output_debounce": debouncer(86_400.0, 900.0),
    "embedding_cache": ttl_lru_cache(3, 259_200.0),
    "iteration_caps": iteration_cap(50, 3, 1.0),
    "rate_limit_queues": bounded_queue(2.0, 1 / 86_400, 3),
}

_EVENTS = "SELECT user_id AS entity, event_id, epoch_us(ts) / 1e6 AS t, event_type AS kind, abs(value) AS size, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events"


def _walk(columns: dict[str, tuple[str, str]], verdict: tuple[str, str], detail: tuple[str, str]) -> str:
    """A machine as a recursive query: each column's first value and the next from ``r`` (before) and ``e`` (event)."""
    first = ", ".join(f"{a} AS {c}" for c, (a, _) in columns.items())
    following = ", ".join(f"{b} AS {c}" for c, (_, b) in columns.items())
    return f"""WITH RECURSIVE e AS ({_EVENTS}),
r AS (SELECT entity, event_id, k, {first}, {verdict[0]} AS verdict, CAST({detail[0]} AS DOUBLE) AS detail FROM e WHERE k = 1
UNION ALL SELECT e.entity, e.event_id, e.k, {following}, {verdict[1]} AS verdict, CAST({detail[1]} AS DOUBLE) AS detail FROM r JOIN e ON e.entity = r.entity AND e.k = r.k + 1)
SELECT entity, event_id, verdict, round(detail, 6) AS detail FROM r"""


_NEW = "(e.t - r.first >= {0})"
_OPENS = "(e.t - r.first >= 172800.0 OR r.held >= 5)"
_FLUSHES = "(r.held + e.size >= 900.0 OR e.t - r.last >= 86400.0)"
_TOKENS = "least(3.0, r.tokens + greatest(0.0, e.t - r.last) / 43200)"
#: DuckDB SQL of the machines whose state is a few numbers.
ORACLES = {
    "request_dedupe": _walk({"first": ("t", f"CASE WHEN {_NEW.format('86400.0')} THEN e.t ELSE r.first END")}, ("'forward'", f"CASE WHEN {_NEW.format('86400.0')} THEN 'forward' ELSE 'suppress' END"), ("0.0", f"CASE WHEN {_NEW.format('86400.0')} THEN 0.0 ELSE e.t - r.first END")),
    "batching_windows": _walk({"first": ("t", f"CASE WHEN {_OPENS} THEN e.t ELSE r.first END"), "held": ("1", f"CASE WHEN {_OPENS} THEN 1 ELSE r.held + 1 END")}, ("'opened'", f"CASE WHEN {_OPENS} THEN 'opened' WHEN r.held + 1 = 5 THEN 'filled' ELSE 'joined' END"), ("1.0", f"CASE WHEN {_OPENS} THEN 1.0 ELSE r.held + 1 END")),
    "output_debounce": _walk({"held": ("CASE WHEN size >= 900.0 THEN 0.0 ELSE size END", f"CASE WHEN {_FLUSHES} THEN 0.0 ELSE r.held + e.size END"), "last": ("t", f"CASE WHEN {_FLUSHES} THEN e.t ELSE r.last END")}, ("CASE WHEN size >= 900.0 THEN 'flush_size' ELSE 'hold' END", f"CASE WHEN r.held + e.size >= 900.0 THEN 'flush_size' WHEN {_FLUSHES} THEN 'flush_time' ELSE 'hold' END"), ("CASE WHEN size >= 900.0 THEN size ELSE 0.0 END", f"CASE WHEN {_FLUSHES} THEN r.held + e.size ELSE 0.0 END")),
    "retry_budgets": _walk({"tokens": ("2.0::DOUBLE", f"CASE WHEN {_TOKENS} >= 1.0 - 1e-9 THEN {_TOKENS} - 1.0 ELSE {_TOKENS} END"), "last": ("t", "e.t")}, ("'admitted'", f"CASE WHEN {_TOKENS} >= 1.0 - 1e-9 THEN 'admitted' ELSE 'throttled' END"), ("0.0", f"CASE WHEN {_TOKENS} >= 1.0 - 1e-9 THEN 0.0 ELSE (1.0 - {_TOKENS}) * 43200 END")),
    "iteration_caps": f"""WITH e AS ({_EVENTS}),
runs AS (SELECT *, k - row_number() OVER (PARTITION BY entity, kind ORDER BY k) AS run FROM e),
placed AS (SELECT *, row_number() OVER (PARTITION BY entity, kind, run ORDER BY k) AS same FROM runs)
SELECT entity, event_id, CASE WHEN k > 50 THEN 'capped' WHEN same >= 3 THEN 'stuck' ELSE 'continue' END AS verdict, CASE WHEN k <= 50 AND same >= 3 THEN power(2.0, same - 3) ELSE 0.0 END AS detail FROM placed""",
}

SCHEMA = "entity long, event_id long, verdict string, detail double"


def run_events(events: pd.DataFrame, machine: Machine, state: State) -> tuple[State, pd.DataFrame]:
    """Fold the ordered events of one key."""
    verdicts, details = [], []
    for t, kind, size in zip(events["t"].tolist(), events["kind"].tolist(), events["size"].tolist(), strict=True):
        state, verdict, detail = machine.step(state, t, kind, size)
        verdicts.append(verdict), details.append(round(detail, 6))
    return state, pd.DataFrame({"entity": events["entity"], "event_id": events["event_id"], "verdict": verdicts, "detail": details})


def as_events(df: DataFrame) -> DataFrame:
    """Rows of the events table as (entity, event_id, t, kind, size)."""
    return df.select(F.col("user_id").alias("entity"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("event_type").alias("kind"), F.abs("value").alias("size"))


def fold(events: DataFrame, machine: Machine) -> DataFrame:
    """Verdicts of one machine for each event, in the order of (t, event_id) within each entity."""

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, state = None, machine.start
        for frame in frames:
            for entity, rows in frame.groupby("entity", sort=False, dropna=False):
                if held is None or entity != held:
                    held, state = entity, machine.start
                state, out = run_events(rows, machine, state)
                yield out

    return events.repartition("entity").sortWithinPartitions("entity", "t", "event_id").mapInPandas(walk, SCHEMA)
