"""Media columns: PNG in binary columns.

Bytes become rows of 8-bit grey samples, are filtered row by row, deflated into zlib chunks and framed with
checksums. Reading tests the signature and every chunk's checksum, inflates, undoes the five filter types with
numpy, and yields the samples. A feature is the sign pattern of the low-frequency cosine coefficients of the
picture scaled to 32 x 32.

Defined results: null and empty texts are one unit of zero bytes; equal texts give equal values; repeated rows
come back each; an empty table gives no rows; other columns are dropped. Damaged pictures raise ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from korvane.llm.common import batches, prepare, text_bytes, whole_text

SIGNATURE = b"\x89PNG\r\n\x1a\n"
SIDE, LOW = 32, 8
#: Bytes of compressed data a chunk.
CHUNK = 1 << 16


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def filter_rows(rows: np.ndarray) -> np.ndarray:
    """Each row with the type byte of the cheapest of none, sub and up by the sum of signed differences."""
    left = rows.copy()
    left[:, 1:] -= rows[:, :-1]
    up = rows.copy()
    up[1:] -= rows[:-1]
    made = np.stack([rows, left, up])
    cost = np.minimum(made, 256 - made.astype(np.int16)).sum(axis=2)
    kind = np.argmin(cost, axis=0)
    out = np.empty((rows.shape[0], rows.shape[1] + 1), np.uint8)
    out[:, 0] = kind
    out[:, 1:] = made[kind, np.arange(rows.shape[0])]
    return out


def unfilter_rows(data: np.ndarray) -> np.ndarray:
    """Undoes the filter types 0 to 4 of 8-bit grey rows. Runs of rows that only look up, or not at all, are one cumulative sum."""
    kind, rows = data[:, 0], data[:, 1:].copy()
    if (kind > 4).any():
        raise ValueError("unknown filter type")
    sub = kind == 1
    if sub.any():
        rows[sub] = np.cumsum(rows[sub], axis=1, dtype=np.uint8)
    hard = np.flatnonzero(kind >= 3)
    at = 0
    for stop in [*hard, len(kind)]:
        _undo_up(kind, rows, at, stop)
        if stop < len(kind):
            above = rows[stop - 1] if stop else np.zeros(rows.shape[1], np.uint8)
            rows[stop] = _undo_average(rows[stop], above) if kind[stop] == 3 else _undo_paeth(rows[stop], above)
        at = stop + 1
    return rows


def _undo_up(kind: np.ndarray, rows: np.ndarray, start: int, stop: int) -> None:
    """Rows start to stop hold types 0 to 2 only, with sub already undone: sum up each run that follows a plain row."""
    ups = np.flatnonzero(kind[start:stop] == 2) + start
    if not len(ups):
        return
    heads = np.flatnonzero(np.diff(ups, prepend=-2) != 1)
    for a, b in zip(heads, [*heads[1:], len(ups)], strict=True):
        i, j = ups[a], ups[b - 1] + 1
        first = i - 1 if i else i
        rows[first:j] = np.cumsum(rows[first:j], axis=0, dtype=np.uint8)


def _undo_average(row: np.ndarray, above: np.ndarray) -> np.ndarray:
    out, left = row.tolist(), 0
    for i, b in enumerate(above.tolist()):
        left = out[i] = (out[i] + (left + b) // 2) & 255
    return np.array(out, np.uint8)


def _undo_paeth(row: np.ndarray, above: np.ndarray) -> np.ndarray:
    out, a, c = row.tolist(), 0, 0
    for i, b in enumerate(above.tolist()):
        pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
        a = out[i] = (out[i] + (a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c)) & 255
        c = b
    return np.array(out, np.uint8)


def write_png(samples: np.ndarray, level: int = 1) -> bytes:
    """An 8-bit grey PNG of a two-dimensional array."""
    height, width = samples.shape
    packed = zlib.compress(filter_rows(samples).tobytes(), level)
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return b"".join([SIGNATURE, _chunk(b"IHDR", head), *(_chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK)), _chunk(b"IEND", b"")])


def read_png(data: bytes) -> np.ndarray:
    """Samples of an 8-bit grey PNG; every checksum is tested."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, parts, ended = 8, b"", [], False
    while at < len(data) and not ended:
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body, crc = data[at + 8 : at + 8 + size], data[at + 8 + size : at + 12 + size]
        if len(crc) != 4 or zlib.crc32(body, zlib.crc32(kind)) != int.from_bytes(crc, "big"):
            raise ValueError(f"checksum of chunk {kind!r} at byte {at}")
        if kind == b"IHDR":
            head = body
        elif kind == b"IDAT":
            parts.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if not ended or not head:
        raise ValueError("cut short")
    width, height, *rest = struct.unpack(">IIBBBBB", head)
    if rest != [8, 0, 0, 0, 0]:
        raise ValueError("only 8-bit grey without interlacing is stored here")
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
    return unfilter_rows(raw.reshape(height, width + 1))


def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi / n * (np.arange(n)[None, :] + 0.5) * np.arange(k)[:, None])


BASIS = _cosines(SIDE, LOW)


def scaled(samples: np.ndarray, side: int = SIDE) -> np.ndarray:
    """Mean brightness of side x side cells; a smaller picture repeats its samples."""
    out = samples.astype(np.float64)
    for axis in (0, 1):
        n = out.shape[axis]
        if n < side:
            out = np.take(out, np.arange(side) * n // side, axis=axis)
        else:
            cut = np.arange(side) * n // side
            size = np.diff(np.append(cut, n))
            out = np.add.reduceat(out, cut, axis=axis) / (size[:, None] if axis == 0 else size[None, :])
    return out


def cosine_hash(samples: np.ndarray) -> int:
    """64 bits: which of the 8 x 8 lowest cosine coefficients lie above their median (the constant one apart)."""
    low = (BASIS @ scaled(samples) @ BASIS.T).ravel()
    low[0] = 0.0
    bits = np.packbits(low > np.median(low[1:]))
    return int.from_bytes(bits.tobytes(), "big")


MEDIA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
FEATURES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()),
    T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()),
])


def _store(unit: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            texts = text_bytes(b.column(1))
            media = [write_png(np.frombuffer(t + bytes(-len(t) % unit or (0 if t else unit)), np.uint8).reshape(-1, unit)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=MEDIA.names)

    return run


def _read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(it):
        rows = []
        for doc, n, media in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            samples = read_png(media)
            raw = samples.tobytes()
            rows.append((doc, n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-samples.shape[1] :]), len(media), hashlib.sha256(media).hexdigest(), f"{cosine_hash(samples):016x}"))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if FEATURES[i].dataType == T.StringType() else pa.int64()) for i, c in enumerate(zip(*rows, strict=True))], names=FEATURES.names)


def store(docs: DataFrame, unit: int = 64) -> DataFrame:
    """doc_id, n_bytes and the picture of each text, ``unit`` samples a row, in a binary column."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(_store(unit), MEDIA)


def features(media: DataFrame) -> DataFrame:
    """What is read back from stored pictures: sizes, digests, the checksum of the last row, and the cosine hash."""
    prepare(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read, FEATURES)
