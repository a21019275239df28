"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import arrays, give_back, keep_rows, map_batches
from .kernels import LOWER, TextSlice, mix, text_slices, words
from .kernels import table as byte_table

#: Words are runs of ASCII letters and digits and of bytes beyond ASCII.
_BREAKS = ~byte_table(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" + bytes(range(128, 256)))


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the labelled rows that the model is fitted on, and ``coordinates`` the distinct coordinates of all
    of them together (4 bytes each, in one task); n-grams in fewer than ``support`` rows get no weight; the rest are
    FTRL's own constants."""

    sample: int = 12_000
    coordinates: int = 30_000_000
    bits: int = 20
    support: int = 4
    alpha: float = 4.0
    beta: float = 1.0
    l1: float = 10.0
    l2: float = 0.0
    epochs: int = 5
    skips: tuple[int, ...] = (2, 3)


@dataclass(frozen=True)
class Model:
    """Sparse weights: L1 leaves few of the 2 ** bits coordinates, so that a model is small to send."""

    bits: int
    skips: tuple[int, ...]
    bias: float
    index: np.ndarray
    weight: np.ndarray


def features(part: TextSlice, bits: int, skips: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and coordinates of the words, word pairs and skip-grams of a slice, with repeats."""
    w = words(part, _BREAKS, LOWER)
    shift = np.uint64(64 - bits)
    rows, places = [w.row], [mix(w.hashes) >> shift]
    pairs, at = w.grams(2)
    rows.append(w.row[at]), places.append(mix(pairs ^ np.uint64(2)) >> shift)
    for k in skips:
        if len(w.row) > k:
            at = np.flatnonzero(w.row[:-k] == w.row[k:])
            rows.append(w.row[at])
            places.append(mix(w.hashes[at] * np.uint64(0x9FB21C651E98DF25) + w.hashes[at + k] + np.uint64(k)) >> shift)
    return np.concatenate(rows), np.concatenate(places).astype(np.int64)


def _distinct(rows: np.ndarray, places: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((rows << bits) | places)
    return both >> bits, both & ((1 << bits) - 1)


def train(examples: list[tuple[int, np.ndarray]], settings: Settings) -> tuple[float, np.ndarray, np.ndarray]:
    """FTRL-proximal: each coordinate has its own learning rate, and is 0 until its gradients outweigh l1."""
    z, n = np.zeros(1 << settings.bits), np.zeros(1 << settings.bits)
    bias = bias_n = 0.0
    seen = np.zeros(1 << settings.bits, np.int32)
    for _, places in examples:
        seen[places] += 1
    examples = [(label, places[seen[places] >= settings.support]) for label, places in examples]

    def weights(i):
        s = z[i]
        return np.where(np.abs(s) <= settings.l1, 0.0, (np.sign(s) * settings.l1 - s) / ((settings.beta + np.sqrt(n[i])) / settings.alpha + settings.l2))

    for _ in range(settings.epochs):
        for label, places in examples:
            w = weights(places)
            p = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35)))
            g = p - label
            bias_n += g * g
            bias -= min(1.0, settings.alpha) * g / (settings.beta + np.sqrt(bias_n))
            old = n[places]
            n[places] = old + g * g
            z[places] += g - (np.sqrt(old + g * g) - np.sqrt(old)) / settings.alpha * w
    everywhere = np.flatnonzero(np.abs(z) > settings.l1)
    return bias, everywhere, weights(everywhere)


def fit(df: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> Model:
    """Learn from the rows of ``labels`` (key, label 0 or 1), at most about ``settings.sample`` of them, chosen by a hash
    of the key.  N-grams are hashed where the texts are; one task runs the online updates in the order of that hash.

    Rows of null key or label are left out; a key that has several labels counts as the largest, and one with several
    texts has the least of them.  Without any example every score is 0.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(F.col(label).cast("int")).alias("y"))
    share = min(1.0, settings.sample / max(1, labels.count()))
    chosen = known.where(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < int(share * (1 << 20)) + (share >= 1))
    source = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    sample = source.join(F.broadcast(chosen), "k").groupBy("k", "y").agg(F.min("t").alias("t")).select(F.xxhash64("k").alias("o"), "y", "t")
    bits, skips = settings.bits, settings.skips

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        bodies = []
        for part in text_slices(batch.column(2)):
            rows, places = _distinct(*features(part, bits, skips), bits)
            ends = np.searchsorted(rows, np.arange(part.rows + 1))
            bodies += [places[a:b].astype("<u4").tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return arrays(o=batch.column(0), y=batch.column(1), places=pa.array(bodies, pa.binary()))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples, room = [], settings.coordinates
        for batch in batches:
            for y, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                room -= len(b) // 4
                if room >= 0:
                    examples.append((y, np.frombuffer(b, "<i4")))
        if not examples:
            return
        bias, index, weight = train(examples, settings)
        del examples
        give_back()
        yield arrays(place=np.concatenate([[-1], index]).astype(np.int64), weight=np.concatenate([[bias], weight]))

    rows = map_batches(sample, hashed, "o long, y int, places binary").repartition(1).sortWithinPartitions("o", "places").mapInArrow(learn, "place long, weight double").collect()
    if not rows:
        return Model(bits, skips, -np.inf, np.zeros(0, np.int64), np.zeros(0))
    found = sorted((r["place"], r["weight"]) for r in rows)
    return Model(bits, skips, found[0][1], np.array([p for p, _ in found[1:]], np.int64), np.array([w for _, w in found[1:]], np.float64))


def _dense(model: Model) -> np.ndarray:
    out = np.zeros(1 << model.bits)
    out[model.index] = model.weight
    return out


def score_column(column: pa.Array, model: Model, dense: np.ndarray) -> np.ndarray:
    """Scores of an Arrow column of texts."""
    out = []
    for part in text_slices(column):
        rows, places = features(part, model.bits, model.skips)
        used = dense[places] != 0
        rows, places = _distinct(rows[used], places[used], model.bits)
        total = np.bincount(rows, dense[places], part.rows) + model.bias
        out.append(1 / (1 + np.exp(-np.clip(total, -700, 700))) if np.isfinite(model.bias) else np.zeros(part.rows))
    return np.concatenate(out)


def scores(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``key`` and score (0 to 1), one for each input row, without a shuffle.

    Texts are read whole; null and empty ones score what the bias alone gives.  Repeated rows and null keys stay, other
    columns are not read, and equal texts have equal scores.  Memory grows with the longest text.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def score(batch: pa.RecordBatch, dense: np.ndarray) -> pa.RecordBatch:
        return arrays(**{key: batch.column(0), "score": score_column(batch.column(1), sent.value, dense)})

    source = df.select(key, text)
    return map_batches(source, score, f"`{key}` {source.schema[0].dataType.simpleString()}, score double", lambda: _dense(sent.value))


def below(df: DataFrame, model: Model, threshold: float, text: str = "text") -> DataFrame:
    """The rows of ``df`` that score below the threshold, with all their columns, in one pass.  Null and empty texts score
    what the bias alone gives; the rest is as in ``keep_rows``."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    return keep_rows(df, text, lambda column, dense: score_column(column, sent.value, dense) < threshold, lambda: _dense(sent.value))
