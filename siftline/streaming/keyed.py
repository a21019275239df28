"""The keyed state machines on Structured Streaming, in the order of event time."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.state import SCHEMA, Machine, run_events


def fold_stream(events: DataFrame, machine: Machine, late: str = "1 hour", idle: float = 30 * 86_400.0) -> DataFrame:
    """Verdicts for a stream of (entity, event_id, t, kind, size).

    An event waits until the watermark, ``late`` behind the latest event, has passed it; a key's events are then folded in
    the order of (t, event_id), so the verdicts are those of ``siftline.operators.state.fold``, whatever order events come
    in within that time.  Repeated events (by event_id) count once while they wait; what comes behind the watermark is
    dropped.  A key that is silent for more than ``idle`` seconds starts anew; its state, the machine's tuple and the
    waiting events, is dropped once the watermark has passed that silence.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, waiting, last = pickle.loads(held.get[0]) if held.exists else (machine.start, {}, -math.inf)
        watermark = held.getCurrentWatermarkMs() / 1000
        if not held.hasTimedOut:
            for frame in frames:
                for event_id, t, kind, size in zip(frame["event_id"].tolist(), frame["t"].tolist(), frame["kind"].tolist(), frame["size"].tolist(), strict=True):
                    if t > watermark:
                        waiting.setdefault(event_id, (t, kind, size))
        ready = sorted((t, event_id, kind, size) for event_id, (t, kind, size) in waiting.items() if t <= watermark)
        while ready:  # up to the next silence, after which the key starts anew
            if ready[0][0] - last > idle:
                state = machine.start
            n = next((i for i in range(1, len(ready)) if ready[i][0] - ready[i - 1][0] > idle), len(ready))
            rows, ready = pd.DataFrame(ready[:n], columns=["t", "event_id", "kind", "size"]), ready[n:]
            rows["entity"] = key[0]
            state, out = run_events(rows, machine, state)
            last = rows["t"].iloc[-1]
            for event_id in rows["event_id"].tolist():
                del waiting[event_id]
            yield out
        wake = min((t for t, _, _ in waiting.values()), default=last + idle)
        if not waiting and wake <= watermark:
            held.remove()
            return
        held.update((pickle.dumps((state, waiting, last)),))
        held.setTimeoutTimestamp(max(int(wake * 1000), held.getCurrentWatermarkMs() + 1))

    timed = events.withColumn("_at", F.timestamp_micros((F.col("t") * 1e6).cast("long"))).withWatermark("_at", late)
    return timed.groupBy("entity").applyInPandasWithState(update, SCHEMA, "state binary", "append", GroupStateTimeout.EventTimeTimeout)
