"""State machines: steps on hand-made events, folds against plain loops, streams against folds."""

import random

import pandas as pd
import pytest

from siftline.operators import state
from siftline.streaming.keyed import fold_stream


def verdicts(machine, events):
    s, out = machine.start, []
    for t, kind, size in events:
        s, v, _ = machine.step(s, t, kind, size)
        out.append(v)
    return out


def test_dedupe_is_anchored_at_the_first():
    assert verdicts(state.dedupe_window(10), [(0, "a", 1), (6, "a", 1), (9.9, "a", 1), (10, "a", 1), (15, "a", 1)]) == ["forward", "suppress", "suppress", "forward", "suppress"]


def test_breaker_trips_cools_and_closes():
    m = state.circuit_breaker(4, 2, 0.5, 10, successes=2)
    assert verdicts(m, [(0, "ok", 1), (1, "error", 1), (2, "ok", 1), (12, "ok", 1), (13, "ok", 1), (14, "ok", 1)]) == ["allow", "tripped", "denied_open", "allow_probe", "closed", "allow"]


def test_bucket_throttles_and_refills():
    assert verdicts(state.token_bucket(2, 1), [(0, "", 0), (0, "", 0), (0, "", 0), (1, "", 0)]) == ["admitted", "admitted", "throttled", "admitted"]


def test_queue_admits_holds_and_refuses():
    m = state.bounded_queue(1, 1, 1)
    assert verdicts(m, [(0, "", 0), (0.1, "", 0), (0.2, "", 0), (5, "", 0)]) == ["admitted", "throttled", "rejected", "admitted"]


def test_cache_expires_and_evicts():
    m = state.ttl_lru_cache(2, 5)
    assert verdicts(m, [(0, "a", 0), (1, "b", 0), (2, "a", 0), (3, "c", 0), (4, "b", 0), (20, "c", 0)]) == ["miss", "miss", "hit", "miss", "miss", "expired"]


def test_debounce_and_batches_and_caps():
    assert verdicts(state.debouncer(10, 5), [(0, "", 2), (1, "", 4), (20, "", 1)]) == ["hold", "flush_size", "flush_time"]
    assert verdicts(state.batching_window(10, 2), [(0, "", 0), (1, "", 0), (2, "", 0), (20, "", 0)]) == ["opened", "filled", "opened", "opened"]
    assert verdicts(state.iteration_cap(3, 2, 1), [(0, "a", 0), (1, "a", 0), (2, "b", 0), (3, "c", 0)]) == ["continue", "stuck", "continue", "capped"]


@pytest.mark.parametrize("name", sorted(state.MACHINES))
def test_fold_equals_a_loop(spark, sf, name):
    machine = state.MACHINES[name]
    events = state.as_events(spark.read.parquet(f"{sf}/events.parquet"))
    ours = {r["event_id"]: r["verdict"] for r in state.fold(events, machine).collect()}
    expected = {}
    for _, rows in events.toPandas().sort_values(["t", "event_id"]).groupby("entity"):
        for i, v in zip(rows["event_id"], verdicts(machine, rows[["t", "kind", "size"]].itertuples(index=False)), strict=True):
            expected[i] = v
    assert ours == expected


def streamed(spark, folder, parts, schema, machine, **options):
    """The verdicts of a stream that reads one file a batch."""
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(folder / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(folder / "in/*"))
    query = fold_stream(stream, machine, **options).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "check")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    return spark.read.parquet(str(folder / "out")).toPandas().sort_values("event_id").reset_index(drop=True)


@pytest.mark.parametrize("name", ["request_dedupe", "circuit_breakers"])
def test_stream_equals_batch_on_late_and_repeated_events(spark, sf, tmp_path, name):
    machine = state.MACHINES[name]
    events = state.as_events(spark.read.parquet(f"{sf}/events.parquet"))
    rows = events.orderBy("t", "event_id").toPandas()
    rng = random.Random(3)
    come = rows.iloc[sorted(range(len(rows)), key=lambda i: rows["t"].iloc[i] + rng.uniform(0, 80_000))]
    parts = []
    for i in range(3):
        part = come.iloc[i * len(rows) // 3 : (i + 1) * len(rows) // 3]
        parts.append(pd.concat([part, part.sample(5, random_state=i)]))  # some events come twice
    closing = rows.iloc[:1].assign(entity=-1, event_id=-1, t=rows["t"].max() + 10 * 86_400)
    out = streamed(spark, tmp_path, [*parts, closing], events.schema, machine, late="1 day", idle=1e9)
    batch = state.fold(events, machine).toPandas().sort_values("event_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(out[out["entity"] >= 0].reset_index(drop=True)[batch.columns], batch)


def test_state_of_idle_keys_goes_and_late_events_are_dropped(spark, tmp_path):
    schema = "entity long, event_id long, t double, kind string, size double"

    def rows(*items):
        return pd.DataFrame([(e, i, float(t), "a", 1.0) for e, i, t in items], columns=["entity", "event_id", "t", "kind", "size"])

    parts = [rows((1, 1, 1000)), rows((2, 2, 100_000)), rows((1, 3, 50_000), (1, 4, 100_500)), rows((2, 5, 900_000))]
    out = streamed(spark, tmp_path, parts, schema, state.iteration_cap(50, 2, 1.0), late="10 seconds", idle=60.0)
    assert dict(zip(out["event_id"], out["verdict"], strict=True)) == {1: "continue", 2: "continue", 4: "continue"}  # 3 is too late, and 4 starts anew
