"""Token counts by rank-synchronous array merging.

Pre-tokens of a slice of texts are one ragged numpy array.  In each round every
sequence applies its pair of lowest rank at all its places at once; what is left
when no pair can merge is counted.  Distinct pre-tokens are merged once, and a
bounded cache in each Python task remembers them between slices.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import Cache, Merges, split_at_specials, unique_spans
from .frames import arrays, map_batches
from .kernels import row_of, text_slices


@functools.cache
def merges(path: str) -> Merges:
    return Merges(path)


def count_column(column: pa.Array, model: Merges, cache: Cache) -> np.ndarray:
    """Tokens of each text of an Arrow column; a special string inside a text counts as the one token that it is."""
    specials = [s.encode() for s in model.special]
    out = []
    for part in text_slices(column):
        pieces, rows, after, _ = split_at_specials(part, specials)
        starts, ends, keys, example, inverse = unique_spans(pieces)
        found, hit = cache.get(keys)
        values, new = found.copy(), example[~hit]
        values[~hit] = model.counts(pieces.data, starts[new], ends[new])
        cache.add(keys[~hit], values[~hit])
        owner = rows[row_of(pieces.offsets, starts)]
        total = np.bincount(owner, values[inverse], part.rows) + np.bincount(rows, after >= 0, part.rows)
        out.append(total.astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def token_counts(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """Rows of ``key``, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens), one for each input row.

    ``vocabulary`` is the path of a byte-level BPE file in the tokenizers library's format; counts equal that library's
    without added begin or end tokens, truncation or padding.  It needs no shuffle.  A null or empty text has no bytes
    and no tokens; repeated rows and null keys are kept; other columns are not read; a text of any length is counted
    whole (memory grows with the longest text); no rows in, none out.
    """

    def count(batch: pa.RecordBatch, state) -> pa.RecordBatch:
        column = batch.column(1)
        tokens = count_column(column, *state)
        sizes = np.concatenate([np.diff(p.offsets) for p in text_slices(column)])
        return arrays(**{key: batch.column(0), "n_bytes": sizes.astype(np.int64), "n_tokens": tokens, "over_limit": tokens > limit})

    source = df.select(key, text)
    return map_batches(source, count, f"`{key}` {source.schema[0].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean", lambda: (merges(vocabulary), Cache()))
