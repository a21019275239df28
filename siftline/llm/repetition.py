"""Quality rules by repetition coverage: characters inside duplicated n-grams and lines, from rolling hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import arrays, map_batches
from .kernels import TextSlice, mix, per_row, segments, span_hashes, text_slices, words
from .kernels import table as byte_table

#: Largest share of word characters inside repeated n-grams (all but the first of each), by n; and inside repeated lines.
COVERAGE = {5: 0.15, 7: 0.13, 10: 0.10}
LINE_COVERAGE = 0.20
SYMBOLS = byte_table(b"#*$%&|<>")


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur at least twice, and which have occurred before."""
    _, first, inverse, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    later = np.ones(len(keys), bool)
    later[first] = False
    return (counts > 1)[inverse.ravel()], later


def _covered(count: int, at: np.ndarray, n: int) -> np.ndarray:
    """The words inside the windows of ``n`` words that begin at ``at``."""
    change = np.bincount(at, minlength=count + 1) - np.bincount(at + n, minlength=count + 1)
    return np.cumsum(change[:-1]) > 0


def measure(part: TextSlice, lengths=tuple(COVERAGE)) -> dict[str, np.ndarray]:
    """Counts for each row of a slice; the shares of characters are 0 for rows without words."""
    w = words(part)
    lead = np.zeros(len(part.data) + 1, np.int64)
    np.cumsum((part.data & 0xC0) != 0x80, out=lead[1:])
    characters = lead[w.ends] - lead[w.starts]
    out = {"n_words": np.diff(w.first), "word_chars": per_row(characters, w.first), "n_symbols": per_row(SYMBOLS[part.data], part.offsets)}
    total = np.maximum(out["word_chars"], 1)
    own = mix(np.arange(part.rows, dtype=np.uint64) + np.uint64(1))
    for n in lengths:
        grams, at = w.grams(n)
        twice, later = _repeats(grams ^ own[w.row[at]])
        if n == 5:
            out["n_repeat_words"] = per_row(_covered(len(w.row), at[twice], n), w.first)
        out[f"coverage_{n}"] = per_row(characters * _covered(len(w.row), at[later], n), w.first) / total
    # lines: the last of a row may be empty; only those with a word count
    lo, hi = segments(part.data != 10, part.offsets)
    word_before = np.searchsorted(w.starts, np.stack([lo, hi]))
    filled = word_before[1] > word_before[0]
    lo, hi = lo[filled], hi[filled]
    line_row = np.searchsorted(part.offsets, lo, "right") - 1
    _, later = _repeats(span_hashes(part.data, lo, hi) ^ own[line_row]) if len(lo) else (lo, np.zeros(0, bool))
    out["n_dup_lines"] = np.bincount(line_row[later], minlength=part.rows)
    inside = np.concatenate([[0], np.cumsum(characters)])
    line_chars = inside[np.searchsorted(w.starts, hi)] - inside[np.searchsorted(w.starts, lo)]
    out["line_coverage"] = np.bincount(line_row[later], line_chars[later], part.rows) / total
    return out


def repetition_rules(df: DataFrame, key: str = "doc_id", text: str = "text", coverage: dict[int, float] | None = None, line_coverage: float = LINE_COVERAGE, min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """One row for each input row: counts of words, word characters, symbols, repeated lines and repeated words, the
    shares of word characters inside n-grams and lines seen before in the text, base_failed, and kept.

    A text fails the base rules with fewer than ``min_words`` words or more than ``max_repeat_percent`` percent of its
    words in repeated 5-word windows; it is kept if it passes them and no share is above its limit.  There is no
    shuffle.  Null and empty texts have counts of 0 and fail; repeated rows, null keys and ties are kept as they are;
    texts are read whole, and memory grows with the longest one.
    """
    limits = dict(sorted((coverage or COVERAGE).items()))
    lengths = tuple(sorted({5, *limits}))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    shares = [*(f"coverage_{n}" for n in limits), "line_coverage"]

    def rules(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [measure(p, lengths) for p in text_slices(batch.column(1))]
        m = {k: np.concatenate([p[k] for p in parts]) for k in (*counts, *shares)}
        failed = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > max_repeat_percent * m["n_words"])
        kept = ~failed & (m["line_coverage"] <= line_coverage)
        for n, most in limits.items():
            kept &= m[f"coverage_{n}"] <= most
        return arrays(**{key: batch.column(0)}, **{k: m[k].astype(np.int64) for k in counts}, base_failed=failed, kept=kept, **{k: m[k].astype(np.float64) for k in shares})

    source = df.select(key, text)
    schema = f"`{key}` {source.schema[0].dataType.simpleString()}, " + ", ".join(f"{k} long" for k in counts) + ", base_failed boolean, kept boolean, " + ", ".join(f"{k} double" for k in shares)
    return map_batches(source, rules, schema)
