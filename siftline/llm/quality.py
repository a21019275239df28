"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives and unlabelled texts are described by some twenty shape
features.  The share of positives among unlabelled texts is estimated from a
first classifier of positives against unlabelled ones, on rows held back from
it.  A second one minimises prior * R+(positives) plus the part of negative
risk that is left, max(0, R-(unlabelled) - prior * R-(positives)).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import arrays, keep_rows, map_batches
from .kernels import LOWER, TextSlice, mix, per_row, segments, text_slices, words
from .kernels import table as byte_table

_SYMBOLS = byte_table(b"#*$%&|<>@^~_=+{}[]\\/")
_MARKS = byte_table(b"!?")
_STOPS = byte_table(b".,;:")
_DIGITS = byte_table(b"0123456789")
_UPPER = byte_table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTERS = byte_table(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + bytes(range(128, 256)))

#: Knots of the piecewise-linear basis, in quantiles of the sample.
_KNOTS = (0.02, 0.1, 0.3, 0.5, 0.7, 0.9, 0.98)


def shape_features(part: TextSlice) -> np.ndarray:
    """One row of features for each text: lengths, and shares of symbols, capitals, repeated words, pairs and lines."""
    w = words(part)
    count = np.diff(w.first)
    some, bytes_ = np.maximum(count, 1), np.maximum(np.diff(part.offsets), 1)
    of = {k: per_row(t[part.data], part.offsets) for k, t in (("symbol", _SYMBOLS), ("mark", _MARKS), ("stop", _STOPS), ("digit", _DIGITS), ("upper", _UPPER), ("letter", _LETTERS))}
    inside = np.concatenate([[0], np.cumsum(_LETTERS[part.data])])
    bare = per_row(inside[w.ends] == inside[w.starts], w.first)
    length = w.ends - w.starts
    last = part.data[w.ends - 1] if len(w.ends) else part.data
    odd_end = per_row(_SYMBOLS[last] | _MARKS[last], w.first)
    folded = words(part, mapping=LOWER)
    own = mix(np.arange(part.rows, dtype=np.uint64) + np.uint64(7))
    columns = [np.log1p(count), per_row(length, w.first) / some, np.sqrt(per_row(length * length, w.first) / some), bare / some, odd_end / some]
    columns += [of["symbol"] / some, of["mark"] / some, of["stop"] / some, of["digit"] / bytes_, of["upper"] / np.maximum(of["letter"], 1), of["letter"] / bytes_]
    for n in (1, 2, 3):
        grams, at = folded.grams(n)
        row = folded.row[at]
        _, first = np.unique(grams ^ own[row], return_index=True)
        total = np.maximum(np.bincount(row, minlength=part.rows), 1)
        columns.append(1 - np.bincount(row[first], minlength=part.rows) / total)
        if n == 1:  # repeats among so many words; long texts repeat common words
            columns.append(np.bincount(row[first], minlength=part.rows) / np.sqrt(total))
        if n == 2 and len(folded.hashes) > 1:
            columns.append(np.bincount(row[folded.hashes[at] == folded.hashes[at + 1]], minlength=part.rows) / total)
        elif n == 2:
            columns.append(np.zeros(part.rows))
    lo, hi = segments(part.data != 10, part.offsets)
    lines = np.bincount(np.searchsorted(part.offsets, lo, "right") - 1, minlength=part.rows)
    columns += [np.log1p(count / np.maximum(lines, 1)), np.log1p(lines)]
    return np.stack(columns, 1).astype(np.float64)


@dataclass(frozen=True)
class Settings:
    """``positives`` and ``unlabelled`` bound the rows that the model is fitted on."""

    positives: int = 6_000
    unlabelled: int = 12_000
    steps: int = 400
    rate: float = 0.05
    ridge: float = 1e-3


@dataclass(frozen=True)
class Model:
    knots: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float


def _basis(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Each feature as its position between neighbouring knots, so that a linear model bends at them."""
    low, high = knots[:, :-1], knots[:, 1:]
    span = np.maximum(high - low, 1e-6)
    return np.clip((x[:, :, None] - low) / span, -1, 2).reshape(len(x), -1)


def _softplus(t: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, t)


def _sigmoid(t: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(t, -60, 60)))


def _descend(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, settings: Settings) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk with logistic loss; without a prior, on plain positives against unlabelled."""
    size = positive.shape[1]
    w = np.zeros(size + 1)
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    p1, u1 = (np.concatenate([x, np.ones((len(x), 1))], 1) for x in (positive, unlabelled))
    for step in range(1, settings.steps + 1):
        sp, su = _sigmoid(p1 @ w), _sigmoid(u1 @ w)
        if prior is None:
            g = p1.T @ (sp - 1) / len(p1) + u1.T @ su / len(u1)
        else:
            rest = _softplus(u1 @ w).mean() - prior * _softplus(p1 @ w).mean()
            away = u1.T @ su / len(u1) - prior * (p1.T @ sp) / len(p1)
            g = prior * (p1.T @ (sp - 1)) / len(p1) + away if rest >= 0 else -away
        g = g + settings.ridge * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= settings.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The least ratio of unlabelled to positive shares above a score, with a margin for chance."""
    cuts = np.quantile(positive, np.linspace(0.0, 0.9, 91))
    p = (positive[:, None] >= cuts).mean(0)
    u = (unlabelled[:, None] >= cuts).mean(0)
    margin = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(unlabelled)) + 1 / np.sqrt(len(positive)))
    best = np.argmin((u + margin) / p)
    return float(np.clip(u[best] / p[best], 0.02, 0.98))


def fit(df: DataFrame, positives: DataFrame, left_out, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> Model | None:
    """Learn from trusted ``positives`` (a column ``key``) and from the texts of ``df`` as unlabelled ones.

    Both samples are bounded by ``settings`` and chosen by hashes of the key; rows where ``left_out`` (a condition on
    ``df``) holds and rows of null key are not used.  Only the features of the samples come to the driver.  None is
    returned if there is no positive or no unlabelled text.
    """
    known = positives.where(F.col(key).isNotNull()).select(F.col(key).alias("k")).distinct()
    source = df.where(F.col(key).isNotNull() & ~left_out).select(F.col(key).alias("k"), F.col(text).alias("t"))
    spread = 1 << 20

    def below(rows: int, most: int, salt: int):
        return F.pmod(F.xxhash64("k", F.lit(salt)), F.lit(spread)) < int(min(1.0, most / max(1, rows)) * spread) + (rows <= most)

    trusted = F.broadcast(known.where(below(known.count(), settings.positives, 1)).withColumn("p", F.lit(True)))
    rows = df.count()
    sample = source.join(trusted, "k", "left").where(F.col("p") | below(rows, settings.unlabelled, 2)).groupBy("k").agg(F.min("t").alias("t"), F.max("p").alias("p"))
    sample = sample.select("t", F.coalesce("p", F.lit(False)).alias("p"), below(rows, settings.unlabelled, 2).alias("u"), F.xxhash64("k").alias("o"))

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        body = np.concatenate([shape_features(p) for p in text_slices(batch.column(0))]).astype("<f8")
        return arrays(p=batch.column(1), u=batch.column(2), o=batch.column(3), x=pa.array([r.tobytes() for r in body], pa.binary()))

    found = sorted(map_batches(sample, describe, "p boolean, u boolean, o long, x binary").collect(), key=lambda r: (r["o"], bytes(r["x"])))
    x, p, u, o = (np.array([np.frombuffer(r["x"], "<f8") for r in found]), *(np.array([r[c] for r in found]) for c in "puo"))
    if not len(found) or not p.any() or not u.any():
        return None
    knots = np.maximum.accumulate(np.quantile(x[u], _KNOTS, axis=0).T, axis=1)
    knots = knots + np.arange(knots.shape[1]) * 1e-3 * np.maximum(x.std(0), 1e-3)[:, None]
    z = _basis(x, knots)
    held = (o.astype(np.int64) & 1).astype(bool)
    if (p & held).sum() < 20 or (p & ~held).sum() < 20:
        held = np.zeros(len(found), bool)
    test = held if held.any() else ~held
    w, b = _descend(z[p & ~held], z[u & ~held] if (u & ~held).any() else z[u], None, settings)
    scored = z @ w + b
    prior = estimate_prior(scored[p & test], scored[u & test] if (u & test).any() else scored[u])
    w, b = _descend(z[p], z[u], prior, settings)
    return Model(knots, w, b, prior)


def score_column(column: pa.Array, model: Model | None) -> np.ndarray:
    """Scores of an Arrow column of texts."""
    if model is None:
        return np.full(len(column), 0.5)
    return np.concatenate([_sigmoid(_basis(shape_features(p), model.knots) @ model.weight + model.bias) for p in text_slices(column)])


def scores(df: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``key`` and score (0 to 1, higher: better), one for each input row, without a shuffle.

    Texts are read whole; null texts are empty ones and score as texts of no words.  Repeated rows and null keys stay,
    other columns are not read.  Without a model every score is 0.5.  Memory grows with the longest text.
    """

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        return arrays(**{key: batch.column(0), "score": score_column(batch.column(1), model)})

    source = df.select(key, text)
    return map_batches(source, score, f"`{key}` {source.schema[0].dataType.simpleString()}, score double")


def at_least(df: DataFrame, model: Model | None, threshold: float, text: str = "text") -> DataFrame:
    """The rows of ``df`` that score the threshold or more, with all their columns, in one pass.  Null texts are empty ones
    and score as texts of no words; without a model every row stays; the rest is as in ``keep_rows``."""
    return keep_rows(df, text, lambda column: score_column(column, model) >= threshold)
