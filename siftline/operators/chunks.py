"""Chunked streams: reassembly, boundary buffers, stop sequences and checksums, folded chunk by chunk.

A chunk is (stream_id, seq, arrival, data, is_final) with binary data.  One pass
over partitions that hold whole streams in order keeps one stream's buffer; each
fold ends with a row a stream.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "stream_id long, n_chunks long, n_out long, n_units long, sha256 string, status string"


def chunked(documents: DataFrame, size: int = 48, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's UTF-8 bytes in chunks of ``size``, arriving a little out of order."""
    data = F.encode(F.col(text), "UTF-8")
    last = F.greatest(F.lit(1), F.ceil(F.length("body") / size)) - 1
    rows = documents.select(F.col(key).alias("stream_id"), data.alias("body")).withColumn("seq", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    late = F.when(F.col("seq") % 5 == 1, 3).otherwise(0)
    return rows.select("stream_id", "seq", (F.col("seq") * 2 + late).alias("arrival"), F.substring("body", (F.col("seq") * size + 1).cast("int"), F.lit(size)).alias("data"), (F.col("seq") == last).alias("is_final"))


class Reassembler:
    """Deliver chunks in order of seq, once each; hold what comes early."""

    def __init__(self):
        self.expected, self.held, self.final, self.digest, self.size, self.most = 0, {}, None, hashlib.sha256(), 0, 0

    def feed(self, seq: int, data: bytes, is_final: bool) -> None:
        if is_final:
            self.final = seq
        if seq >= self.expected:
            self.held.setdefault(seq, data)
        while self.expected in self.held:
            body = self.held.pop(self.expected)
            self.digest.update(body)
            self.size += len(body)
            self.expected += 1
        self.most = max(self.most, len(self.held))

    def end(self) -> tuple[int, int, str, str]:
        done = self.final is not None and self.expected > self.final
        return self.expected, self.size, self.digest.hexdigest(), "complete" if done else "gap"


class Utf8Buffer:
    """Emit whole characters; a sequence cut by a chunk's end waits for the next chunk."""

    def __init__(self):
        self.decoder, self.digest, self.count, self.emits = codecs.getincrementaldecoder("utf-8")(), hashlib.sha256(), 0, 0

    def feed(self, seq: int, data: bytes, is_final: bool) -> None:
        out = self.decoder.decode(data)
        self.count += len(out)
        self.emits += bool(out)
        self.digest.update(out.encode())

    def end(self) -> tuple[int, int, str, str]:
        pending = len(self.decoder.getstate()[0])
        return self.count, pending, self.digest.hexdigest(), "partial" if pending else "complete"


class LineBuffer:
    """Whole lines only; what follows the last delimiter is a line of its own at the end."""

    def __init__(self, delimiter: bytes = b"\n"):
        self.delimiter, self.held, self.lines, self.longest, self.digest = delimiter, b"", 0, 0, hashlib.sha256()

    def _take(self, line: bytes) -> None:
        self.lines += 1
        self.longest = max(self.longest, len(line))
        self.digest.update(line + b"\0")

    def feed(self, seq: int, data: bytes, is_final: bool) -> None:
        *whole, self.held = (self.held + data).split(self.delimiter)
        for line in whole:
            self._take(line)

    def end(self) -> tuple[int, int, str, str]:
        tail = bool(self.held)
        if tail:
            self._take(self.held)
        return self.lines, self.longest, self.digest.hexdigest(), "unterminated" if tail else "complete"


class StopSequences:
    """Emit what comes before the first stop sequence, even if chunks cut it."""

    def __init__(self, stops: tuple[bytes, ...] = (b". The ", b"\nA")):
        self.stops, self.held, self.emitted, self.hit, self.digest = stops, b"", 0, None, hashlib.sha256()

    def _emit(self, body: bytes) -> None:
        self.emitted += len(body)
        self.digest.update(body)

    def feed(self, seq: int, data: bytes, is_final: bool) -> None:
        if self.hit is not None:
            return
        body = self.held + data
        found = min(((at, s) for s in self.stops if (at := body.find(s)) >= 0), default=None)
        if found:
            self.hit, self.held = found[1], b""
            self._emit(body[: found[0]])
            return
        keep = max(map(len, self.stops)) - 1
        self._emit(body[: max(0, len(body) - keep)])
        self.held = body[max(0, len(body) - keep) :]

    def end(self) -> tuple[int, int, str, str]:
        self._emit(self.held)
        return int(self.hit is not None), self.emitted, self.digest.hexdigest(), "stopped" if self.hit is not None else "ended"


class Checksum:
    """A digest that exists once the final chunk was seen."""

    def __init__(self):
        self.digest, self.size, self.closed = hashlib.sha256(), 0, False

    def feed(self, seq: int, data: bytes, is_final: bool) -> None:
        self.digest.update(data)
        self.size += len(data)
        self.closed |= is_final

    def end(self) -> tuple[int, int, str, str]:
        return int(self.closed), self.size, self.digest.hexdigest(), "final" if self.closed else "open"


#: Machines, and whether they take chunks as they arrive or in order of seq.
MACHINES: dict[str, tuple[Callable, str]] = {"chunks_reassembled": (Reassembler, "arrival"), "chunks_utf8": (Utf8Buffer, "seq"), "chunks_lines": (LineBuffer, "seq"), "chunks_stopped": (StopSequences, "seq"), "chunks_checksum": (Checksum, "seq")}

_SHA = "SELECT doc_id AS stream_id, CAST(greatest(1, ceil(strlen(text) / 48.0)) AS BIGINT) AS n_chunks"
#: The same rows from whole texts.
ORACLES = {
    "chunks_reassembled": f"{_SHA}, CAST(greatest(1, ceil(strlen(text) / 48.0)) AS BIGINT) AS n_out, CAST(strlen(text) AS BIGINT) AS n_units, sha256(text) AS sha256, 'complete' AS status FROM documents",
    "chunks_utf8": f"{_SHA}, CAST(length(text) AS BIGINT) AS n_out, CAST(0 AS BIGINT) AS n_units, sha256(text) AS sha256, 'complete' AS status FROM documents",
    "chunks_lines": f"{_SHA}, CAST(len(regexp_extract_all(text, '\\n')) + (NOT suffix(text, chr(10)) AND text <> '')::INT AS BIGINT) AS n_out, CAST(coalesce(list_max(list_transform(string_split(text, chr(10)), lambda x: strlen(x))), 0) AS BIGINT) AS n_units, status FROM (SELECT *, CASE WHEN text <> '' AND NOT suffix(text, chr(10)) THEN 'unterminated' ELSE 'complete' END AS status FROM documents)",
    "chunks_stopped": f"{_SHA}, CAST(cut > 0 AS BIGINT) AS n_out, CAST(CASE WHEN cut > 0 THEN strlen(left(text, cut - 1)) ELSE strlen(text) END AS BIGINT) AS n_units, sha256(CASE WHEN cut > 0 THEN left(text, cut - 1) ELSE text END) AS sha256, CASE WHEN cut > 0 THEN 'stopped' ELSE 'ended' END AS status FROM (SELECT *, CAST(coalesce(least(nullif(instr(text, '. The '), 0), nullif(instr(text, chr(10) || 'A'), 0)), 0) AS BIGINT) AS cut FROM documents)",
    "chunks_checksum": f"{_SHA}, CAST(1 AS BIGINT) AS n_out, CAST(strlen(text) AS BIGINT) AS n_units, sha256(text) AS sha256, 'final' AS status FROM documents",
}


def fold(chunks: DataFrame, name: str) -> DataFrame:
    """One row for each stream."""
    make, order = MACHINES[name]

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, machine, count, rows = None, None, 0, []
        for frame in frames:
            for stream, seq, data, final in zip(frame["stream_id"].tolist(), frame["seq"].tolist(), frame["data"].tolist(), frame["is_final"].tolist(), strict=True):
                if machine is None or stream != held:
                    if machine is not None:
                        rows.append((held, count, *machine.end()))
                    held, machine, count = stream, make(), 0
                machine.feed(seq, bytes(data), final)
                count += 1
            if len(rows) >= 1000:
                yield pd.DataFrame(rows, columns=["stream_id", "n_chunks", "n_out", "n_units", "sha256", "status"])
                rows = []
        if machine is not None:
            rows.append((held, count, *machine.end()))
        if rows:
            yield pd.DataFrame(rows, columns=["stream_id", "n_chunks", "n_out", "n_units", "sha256", "status"])

    return chunks.repartition("stream_id").sortWithinPartitions("stream_id", order).mapInPandas(walk, SCHEMA)
