"""Media columns: Netpbm and BMP images as numpy arrays, area-resized tiles in NPY form, and difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import arrays, map_batches


def encode_pgm(samples: np.ndarray) -> bytes:
    """An 8-bit grey array as binary PGM, or an 8-bit RGB array as binary PPM."""
    kind = b"P6" if samples.ndim == 3 else b"P5"
    return b"%s\n%d %d\n255\n" % (kind, samples.shape[1], samples.shape[0]) + samples.astype(np.uint8).tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """An 8-bit RGB array as an uncompressed 24-bit BMP."""
    height, width, _ = samples.shape
    stride = -(-width * 3 // 4) * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * 3] = samples[::-1, :, ::-1].reshape(height, -1)
    return b"BM" + struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


_HEADER = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)")


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as arrays: grey (height, width) or colour (height, width, 3), 8 or 16 bit; bitmaps as 0 and 255."""
    kind, at, fields = data[:2], 2, []
    if not re.fullmatch(rb"P[1-6]", kind):
        raise ValueError("not a Netpbm image")
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = _HEADER.match(data, at)
        if not m:
            raise ValueError("broken Netpbm header")
        fields.append(int(m[1]))
        at = m.end()
    width, height, most = (*fields, 1)[:3]
    bands = 3 if kind in (b"P3", b"P6") else 1
    shape = (height, width, 3) if bands == 3 else (height, width)
    if kind == b"P1":
        bits = [c - 48 for c in re.sub(rb"#[^\n]*", b"", data[at:]) if c in b"01"]
        return np.where(np.array(bits[: width * height]).reshape(shape), 0, 255).astype(np.uint8)
    if kind in (b"P2", b"P3"):
        values = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split()[: width * height * bands], np.int64)
        return values.reshape(shape).astype(np.uint16 if most > 255 else np.uint8)
    at += 1
    if kind == b"P4":
        stride = -(-width // 8)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, stride * height, at).reshape(height, stride), axis=1)[:, :width]
        return np.where(bits, 0, 255).astype(np.uint8)
    return np.frombuffer(data, ">u2" if most > 255 else np.uint8, width * height * bands, at).reshape(shape)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits as (height, width, 3)."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    begin, header, width, height, _, depth, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if packing or depth not in (8, 24, 32):
        raise ValueError("unsupported BMP")
    rows, stride = abs(height), -(-width * depth // 32) * 4
    pixels = np.frombuffer(data, np.uint8, stride * rows, begin).reshape(rows, stride)
    if depth == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, used * 4, 14 + header).reshape(-1, 4)
        colour = palette[pixels[:, :width]][:, :, 2::-1]
    else:
        n = depth // 8
        colour = pixels[:, : width * n].reshape(rows, width, n)[:, :, 2::-1]
    return colour[::-1] if height > 0 else colour


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def _edges(size: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    cuts = np.arange(parts + 1) * size / parts
    whole = np.minimum(cuts.astype(np.int64), size)
    return whole, cuts - whole


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the source area under each target pixel, borders weighted by their share, from an integral image."""
    grey = image.astype(np.float64)
    if grey.ndim == 3:
        grey = grey @ np.array([0.299, 0.587, 0.114])
    total = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    np.cumsum(np.cumsum(grey, 0), 1, out=total[1:, 1:])
    for axis, parts in ((0, height), (1, width)):
        whole, share = _edges(grey.shape[axis], parts)
        after = np.minimum(whole + 1, grey.shape[axis])
        shape = (-1, 1) if axis == 0 else (1, -1)
        total = np.take(total, whole, axis) * (1 - share.reshape(shape)) + np.take(total, after, axis) * share.reshape(shape)
    area = grey.shape[0] * grey.shape[1] / (height * width)
    return np.diff(np.diff(total, axis=0), axis=1) / area


def difference_hash(image: np.ndarray, side: int = 8) -> str:
    """``side`` x ``side`` bits in hex: whether each pixel of the reduced image is brighter than its left neighbour."""
    small = np.round(area_resize(image, side, side + 1), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tile(image: np.ndarray, height: int, width: int) -> bytes:
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(image, height, width)), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def image_features(df: DataFrame, key: str = "doc_id", media: str = "media", tile: int = 16) -> DataFrame:
    """Decode each image of a binary column: height, width, an NPY tile of ``tile`` x ``tile`` and the difference hash.

    Images are read row by row without a shuffle.  Null, empty or broken images give null features; repeated rows stay;
    other columns are not read; one image is in memory at a time besides its batch; no rows in, none out.
    """

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for data in batch.column(1).to_pylist():
            try:
                image = decode(data or b"")
                out.append((*image.shape[:2], npy_tile(image, tile, tile), difference_hash(image)) if image.size else (None,) * 4)
            except (ValueError, struct.error):
                out.append((None,) * 4)
        h, w, t, f = zip(*out, strict=True)
        return arrays(**{key: batch.column(0)}, height=pa.array(h, pa.int32()), width=pa.array(w, pa.int32()), tile=pa.array(t, pa.binary()), feature=pa.array(f, pa.string()))

    source = df.select(key, media)
    return map_batches(source, features, f"`{key}` {source.schema[0].dataType.simpleString()}, height int, width int, tile binary, feature string")


def texts_as_media(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 64, keep_media: bool = False, tile: int = 16) -> DataFrame:
    """Store texts as grey Netpbm images of ``width`` columns, read them back, and describe what was read.

    The payload is the UTF-8 text and as many 0 bytes as make it a positive multiple of ``width``.  Returned are its
    sizes and checksums, those of the stored image, the NPY tile's checksum and the difference hash; with
    ``keep_media`` also the image and the tile.  Null texts are empty ones; equal texts give equal values; nothing is
    shuffled, and one text is in memory at a time besides its batch.  Repeated rows and null keys stay, other columns are
    not read; no rows in, none out.
    """

    def store(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_sha256", "media", "tile")}
        for value in batch.column(1):
            raw = (value.as_py() or "").encode()
            size = max(width, -(-len(raw) // width) * width)
            media = encode_pgm(np.frombuffer(raw.ljust(size, b"\0"), np.uint8).reshape(-1, width))
            image = decode(media)
            back = image.tobytes()
            small = npy_tile(image, tile, tile)
            row = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(image), hashlib.sha256(small).hexdigest(), media if keep_media else None, small if keep_media else None)
            for c, x in zip(columns.values(), row, strict=True):
                c.append(x)
        kinds = {k: pa.int64() for k in ("n_bytes", "payload_bytes", "tail_crc32", "media_bytes")} | {k: pa.binary() for k in ("media", "tile")}
        out = {k: pa.array(v, kinds.get(k, pa.string())) for k, v in columns.items() if keep_media or k not in ("media", "tile")}
        return arrays(**{key: batch.column(0)}, **out)

    source = df.select(key, text)
    schema = f"`{key}` {source.schema[0].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string"
    return map_batches(source, store, schema + (", media binary, tile binary" if keep_media else ""))
