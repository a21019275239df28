"""Counts over the span graphs of traces: level by level, many traces at a time.

Spans are dealt by trace and sorted within partitions; a task holds some traces of ``CHUNK`` spans together, or one longer
trace.  What a level reaches is a set, so spans that repeat or lie on cycles add no rows from level to level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Spans that are walked together; a longer trace is walked alone.
CHUNK = 500_000
#: Levels below the roots that are walked, since a cycle that a root reaches has no last one.
LEVELS = 50

COUNTS = ("n_spans", "n_roots", "n_ids", "n_orphans", "n_reached", "depth")


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, int]:
    """A number for each distinct value, -1 for null, and how many numbers there are."""
    found = column.combine_chunks().dictionary_encode()
    found = found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
    return pc.fill_null(found.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64), len(found.dictionary)


def walk(trace: np.ndarray, span: np.ndarray, parent: np.ndarray) -> dict[str, np.ndarray]:
    """``COUNTS`` of each trace.  ``trace`` numbers the traces from 0, ``span`` and ``parent`` the ids of spans, -1 for null."""
    traces, ids = int(trace.max(initial=-1)) + 1, int(max(span.max(initial=-1), parent.max(initial=-1))) + 1
    nodes, node = np.unique(np.where(span < 0, -1, trace * ids + span), return_inverse=True)
    node = node.ravel()
    named = nodes >= 0
    wanted = trace * ids + parent
    above = np.minimum(np.searchsorted(nodes, wanted), max(0, len(nodes) - 1))
    root = parent < 0
    known = ~root & (nodes[above] == wanted)
    of = nodes // max(1, ids)  # the trace of a node

    def counted(rows: np.ndarray) -> np.ndarray:
        return np.bincount(trace[rows], minlength=traces)

    depth, reached, level = np.zeros(traces, np.int64), np.zeros(len(nodes), bool), np.zeros(len(nodes), bool)
    level[node[root]] = True
    below = np.flatnonzero(known)
    for k in range(1, LEVELS + 1):
        level &= named
        reached |= level
        hit = below[level[above[below]]]
        if not len(hit):
            break
        depth[trace[hit]] = k
        level = np.zeros(len(nodes), bool)
        level[node[hit]] = True
    reached |= level & named
    return {
        "n_spans": np.bincount(trace, minlength=traces), "n_roots": counted(root), "n_ids": np.bincount(of[named], minlength=traces),
        "n_orphans": counted(~root & ~known), "n_reached": np.bincount(of[reached], minlength=traces), "depth": depth,
    }


def _counts(held: pa.Table) -> pa.RecordBatch:
    trace, traces = _codes(held.column(0))
    both, _ = _codes(pa.chunked_array([*held.column(1).chunks, *held.column(2).chunks]))
    found = walk(trace, both[: held.num_rows], both[held.num_rows :])
    first = np.zeros(traces, np.int64)
    first[trace[::-1]] = np.arange(held.num_rows)[::-1]
    names = held.column(0).combine_chunks().take(pa.array(first))
    names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
    return pa.RecordBatch.from_arrays([names, *(pa.array(found[c].astype(np.int64)) for c in COUNTS)], names=[held.column_names[0], *COUNTS])


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    rows, enough = 0, CHUNK
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < enough:
            continue
        table = pa.Table.from_batches(held)
        trace, _ = _codes(table.column(0))
        whole = int(np.flatnonzero(trace != trace[-1])[-1:].sum() + 1) if (trace != trace[-1]).any() else 0
        if whole:
            yield _counts(table.slice(0, whole))
        held, rows = table.slice(whole).to_batches(), table.num_rows - whole
        enough = max(CHUNK, 2 * rows)  # of a long trace, the end is not sought at each batch
    if rows:
        yield _counts(pa.Table.from_batches(held))


def counts(spans: DataFrame) -> DataFrame:
    """A row of trace_id and ``COUNTS`` for each trace of ``spans`` (trace_id, span_id, parent_id).

    Ids and traces are of a plain type.  Spans of no trace are counted by Spark, have no parent and are not walked.  Memory
    grows with the longest trace; no rows in, none out.
    """
    ids = F.array("span_id", "parent_id")  # one type for both
    rows = spans.select("trace_id", ids[0].alias("span_id"), ids[1].alias("parent_id"))
    kind = rows.schema["trace_id"].dataType.simpleString()
    dealt = rows.where("trace_id IS NOT NULL").repartition("trace_id").sortWithinPartitions("trace_id")
    walked = dealt.mapInArrow(_walked, f"trace_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))
    none = F.lit(0).cast("long")
    loose = rows.where("trace_id IS NULL").groupBy("trace_id").agg(F.count("*").alias("n_spans"), F.count_if(F.col("parent_id").isNull()).alias("n_roots"), F.countDistinct("span_id").alias("n_ids"), none.alias("n_orphans"), none.alias("n_reached"), none.alias("depth"))
    return walked.union(loose)
