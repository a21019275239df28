"""Best-fit packing of tokenised documents under several capacities.

A sequence has a residual of tokens, of documents and of attention cost (the
tiles that attention within each document touches: the square of its length in
tiles).  Pieces go, longest first, to the open sequence that scores
best by weighted residual norm or dot product among those where every capacity
holds.  Lengths are at most the token capacity, so the packing is decided for
counts of lengths: a plan whose size depends on that capacity and not on the
corpus.  Spark counts the lengths, ranks the pieces of each length, and looks
each rank up in the plan.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Cache, split_at_specials, unique_spans
from .frames import arrays, durable, map_batches
from .kernels import ragged, row_of, text_slices


@dataclass(frozen=True)
class Capacity:
    """What one sequence may hold, and what each capacity weighs in the choice of a sequence.

    ``attention`` counts tiles of ``tile`` x ``tile`` tokens.  With the defaults all three bind: a piece of 1024 tokens
    takes 256 of 272 tiles, so a long piece leaves room for 16 short ones at most.
    """

    tokens: int = 1024
    documents: int = 48
    attention: int = 272
    tile: int = 64
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    score: str = "norm"

    def cost(self, length: int) -> int:
        return (-(-length // self.tile)) ** 2


class _Ids:
    """The library's ids of distinct pre-tokens, remembered up to a bound."""

    def __init__(self, path: str, most: int = 1 << 18):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; each thread would keep memory of its own
        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        added = self.library.get_added_tokens_decoder()
        self.specials = {x.content.encode(): i for i, x in added.items()}
        self.cache = Cache(most)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each distinct span stand in ``flat``, and how many they are."""
        found, hit = self.cache.get(keys)
        where, new = found.copy(), np.flatnonzero(~hit)
        if self.used > 1 << 22:  # what was worked out beyond the cache's bound takes room as well
            self.cache, self.used, self.flat = Cache(self.cache.most), 0, self.flat[: 1 << 23]
            where, new = found.copy(), np.arange(len(keys))
        if len(new):
            raw = data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            lists = [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            total = int(sizes.sum())
            if self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(max(total, len(self.flat)), np.uint32)])
            self.flat[self.used : self.used + total] = np.fromiter((i for x in lists for i in x), np.uint32, total)
            where[new] = ((self.used + np.cumsum(sizes) - sizes) << 24) | sizes
            self.used += total
            self.cache.add(keys[new], where[new])
        return where >> 24, where & 0xFFFFFF


@functools.cache
def _ids(path: str) -> _Ids:
    return _Ids(path)


def documents_ids(column: pa.Array, ids: _Ids, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each slice of an Arrow column: its first row, all ids (each text's and then ``end``), and the texts' bounds."""
    for part in text_slices(column):
        pieces, rows, after, _ = split_at_specials(part, list(ids.specials))
        starts, ends, keys, example, inverse = unique_spans(pieces)
        where, sizes = ids.spans(pieces.data, starts[example], ends[example], keys)
        sizes_all = sizes[inverse]
        owner = row_of(pieces.offsets, starts)
        tokens = np.bincount(owner, sizes_all, pieces.rows).astype(np.int64) + 1  # each piece is closed by a special or the end
        closing = np.cumsum(tokens) - 1
        out = np.zeros(int(tokens.sum()), np.uint32)
        body = np.ones(len(out), bool)
        body[closing] = False
        out[body] = ids.flat[ragged(where[inverse], sizes_all)]
        numbers = np.array([*ids.specials.values(), end], np.uint32)
        out[closing] = numbers[np.where(after >= 0, after, len(ids.specials))]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(rows, tokens, part.rows).astype(np.int64))])
        yield part.first, out, bounds


def tokenised_pieces(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", tokens: int = 1024, end: int = 2, keep_ids: bool = False) -> DataFrame:
    """Pieces of each document's ids: key, piece, start, length, ids_crc32 (and ids); only documents of more than
    ``tokens`` ids are cut, and then the first piece alone may be shorter."""

    def cut(batch: pa.RecordBatch, ids: _Ids) -> pa.RecordBatch:
        row, piece, start, length, crc, lists = [], [], [], [], [], []
        for first, out, bounds in documents_ids(batch.column(1), ids, end):
            size = np.diff(bounds)
            n = -(-size // tokens)
            head = size - (n - 1) * tokens
            own = np.repeat(np.arange(len(size)), n)
            k = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            begin = np.where(k > 0, head[own] + (k - 1) * tokens, 0)
            count = np.where(k > 0, tokens, head[own])
            lo = bounds[:-1][own] + begin
            raw = memoryview(out.astype("<u4", copy=False)).cast("B")
            crc.append(np.fromiter((zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(lo.tolist(), (lo + count).tolist(), strict=True)), np.int64, len(lo)))
            row.append(first + own), piece.append(k), start.append(begin), length.append(count)
            if keep_ids:
                lists += [out[a : a + c].astype(np.int32) for a, c in zip(lo.tolist(), count.tolist(), strict=True)]
        columns = {key: batch.column(0).take(pa.array(np.concatenate(row))), "piece": np.concatenate(piece).astype(np.int32), "start": np.concatenate(start).astype(np.int64), "length": np.concatenate(length).astype(np.int64), "ids_crc32": np.concatenate(crc)}
        if keep_ids:
            columns["ids"] = pa.array(lists, pa.list_(pa.int32()))
        return arrays(**columns)

    source = df.select(key, text)
    schema = f"`{key}` {source.schema[0].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return map_batches(source, cut, schema + (", ids array<int>" if keep_ids else ""), lambda: _ids(vocabulary))


def plan(counts: dict[int, int], capacity: Capacity, shaped: dict[str, int] | None = None) -> np.ndarray:
    """Pack ``counts`` pieces of each length; many equal sequences are handled at once.

    Rows of (length, first rank, pieces of this length in each sequence, first sequence, offset), in order of length and
    rank: the piece of rank r of that length goes to sequence first + (r - first rank) // pieces, at
    offset + (r - first rank) % pieces * length.  ``shaped`` gets how many sequences with room for
    tokens the other capacities closed, how many at once they kept out of a choice, and as ``choice`` how many times
    tokens alone would have chosen another sequence.
    """
    full = np.array([capacity.tokens, capacity.documents, capacity.attention], np.float64)
    weight = np.array(capacity.weights)
    too_long = [x for x in counts if x > capacity.tokens or capacity.cost(x) > capacity.attention]
    if too_long or capacity.documents < 1:
        raise ValueError(f"no sequence holds a piece of {max(too_long, default=0)} tokens")
    room = np.zeros((64, 3), np.int64)  # residuals of groups of equal sequences
    many, begin = np.zeros(64, np.int64), np.zeros(64, np.int64)
    used = sequences = 0
    rows = []
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        need = np.array([length, 1, capacity.cost(length)])

        def fits(r: np.ndarray, need=need) -> np.ndarray:
            return (r // np.maximum(need, 1)).min(axis=-1)

        while left:
            holds = room[:used] >= need
            open_ = np.flatnonzero((many[:used] > 0) & holds.all(axis=1))
            if shaped is not None:
                kept_out = (many[:used] > 0) & holds[:, 0] & ~holds.all(axis=1)
                shaped["kept out"] = max(shaped.get("kept out", 0), int(many[:used][kept_out].sum()))
            if len(open_):
                share, demand = room[open_] / full, need / full
                score = -(weight * (share - demand) ** 2).sum(1) if capacity.score == "norm" else (weight * share * demand).sum(1)
                g = int(open_[np.argmax(score)])
                if shaped is not None:
                    shaped["choice"] = shaped.get("choice", 0) + int(room[g, 0] != room[open_, 0].min())
                residual, first, bins = room[g].copy(), int(begin[g]), int(many[g])
            else:
                g, residual = -1, full.astype(np.int64)
                first, bins = sequences, max(1, left // int(fits(residual)))
                sequences += bins
            each = int(fits(residual))
            if left >= each:
                bins_now = min(bins, left // each)
            else:
                each, bins_now = left, 1
            rows.append((length, rank, each, first, capacity.tokens - int(residual[0])))
            rank, left = rank + each * bins_now, left - each * bins_now
            if g >= 0:
                many[g], begin[g] = bins - bins_now, first + bins_now
            elif bins > bins_now:  # cannot happen: what was opened is filled
                raise AssertionError
            after = residual - each * need
            if shaped is not None and after[0] > 0 and after[1:].min() <= 0:
                shaped["closed"] = shaped.get("closed", 0) + bins_now
            if after[0] > 0 and after[1] > 0 and after[2] > 0:
                free = np.flatnonzero(many[:used] == 0)
                at = int(free[0]) if len(free) else used
                if at == len(many):
                    room, many, begin = np.concatenate([room, np.zeros_like(room)]), np.concatenate([many, np.zeros_like(many)]), np.concatenate([begin, np.zeros_like(begin)])
                room[at], many[at], begin[at] = after, bins_now, first
                used = max(used, at + 1)
    out = np.array(rows, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def pack(pieces: DataFrame, capacity: Capacity = Capacity(), order: tuple[str, ...] = ("doc_id", "piece"), rows_a_group: int = 50_000) -> DataFrame:
    """Add sequence_id and offset to pieces with a ``length`` column.

    The counts of the lengths (at most ``capacity.tokens`` rows) decide the packing on the driver.  Ranks within a
    length are numbered in groups of about ``rows_a_group`` pieces, dealt by a hash of ``order``, so that a length which
    holds most pieces is still spread over many tasks.  ``pieces`` is read several times and should be durable.
    Reruns agree; equal rows are interchangeable.
    """
    counted = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rules = plan(counted, capacity)
    groups = max(1, -(-sum(counted.values()) // rows_a_group))
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(*order), F.lit(groups)))
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("length", "_group").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ties = [c for c in pieces.columns if c not in order and pieces.schema[c].dataType.simpleString() in ("int", "bigint", "string")]
    rank = F.row_number().over(Window.partitionBy("length", "_group").orderBy(*order, *ties))
    ranked = dealt.withColumn("_rank", rank - 1).join(sizes, ["length", "_group"]).withColumn("_rank", (F.col("_rank") + F.col("_before")).cast("long"))
    ranked = ranked.select(*pieces.columns, "_rank")

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, at = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
        big = np.int64(1) << 44
        row = rules[np.searchsorted(rules[:, 0] * big + rules[:, 1], length * big + at, "right") - 1]
        k = at - row[:, 1]
        names = [c for c in batch.schema.names if c != "_rank"]
        return arrays(**{c: batch.column(batch.schema.get_field_index(c)) for c in names}, sequence_id=row[:, 3] + k // row[:, 2], offset=row[:, 4] + k % row[:, 2] * length)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return map_batches(ranked, place, f"{schema}, sequence_id long, offset long")


def pack_documents(df: DataFrame, vocabulary: str, capacity: Capacity = Capacity(), key: str = "doc_id", text: str = "text", end: int = 2, keep_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack documents: key, piece, start, length, ids_crc32 (ids), sequence_id and offset.

    A null or empty text is one piece, the end id alone.  Repeated rows and null keys are packed like any others; other
    columns are not read; no rows in, none out.
    """
    pieces = durable(tokenised_pieces(df, vocabulary, key, text, capacity.tokens, end, keep_ids))
    return pack(pieces, capacity, (key, "piece"))
