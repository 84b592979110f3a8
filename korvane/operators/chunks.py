"""Chunks of texts: token windows with overlap and sentence snap, and the upkeep of a chunk table."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A token is a run of word characters or one other visible character.
TOKEN = re.compile(r"\w+|\S")
ENDS = ".!?"
CHUNKS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("chunk", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("n_tokens", T.IntegerType())])


def boundaries(n: int, stops: np.ndarray, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """First token and end of each window over ``n`` tokens; ``stops`` are the ends of sentences.

    Where each possible window would end is laid out for all tokens at once: ``size`` tokens on, or at the last stop
    before that if the stop lies in the window's last quarter. The windows are then read off.
    """
    first = np.arange(n)
    full = np.minimum(first + size, n)
    stop_before = np.zeros(n + 1, np.int64)
    stop_before[stops] = stops
    snapped = np.maximum.accumulate(stop_before)[full]
    near = (full < n) & (full - snapped <= size // 4) & (snapped > first)
    end_of = np.where(near, snapped, full)
    next_of = np.maximum(end_of - overlap, first + 1)
    at = 0
    while at < n:
        yield at, int(end_of[at])
        at = n if end_of[at] == n else int(next_of[at])


def windows(text: str, size: int, overlap: int) -> list[tuple[str, int]]:
    """Texts and token counts of windows of ``size`` tokens, each beginning ``overlap`` tokens before the end of the one before."""
    spans = np.array([m.span() for m in TOKEN.finditer(text)], np.int64).reshape(-1, 2)
    stops = np.array([i for i, (_, b) in enumerate(spans.tolist(), 1) if text[b - 1] in ENDS], np.int64)
    return [(text[spans[i, 0] : spans[j - 1, 1]], j - i) for i, j in boundaries(len(spans), stops, size, overlap)]


def chunks(docs: DataFrame, size: int = 256, overlap: int = 32) -> DataFrame:
    """(doc_id, chunk, text, n_tokens) of the windows of every whole text; null and blank texts have none."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = windows(text or "", size, overlap)
                if found:
                    n = len(found)
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([t for t, _ in found]), pa.array([k for _, k in found], pa.int32())], names=CHUNKS.names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, CHUNKS)


def upkeep(fresh: DataFrame, held: DataFrame, vectors: DataFrame) -> DataFrame:
    """(doc_id, chunk, action): what brings a chunk table (doc_id, chunk, text) and its vectors (doc_id, chunk) up to date.

    ``insert`` and ``update`` write a chunk and embed it, ``delete`` drops a chunk whose text is gone, ``embed`` fills a
    hole of the vectors, ``drop_vector`` removes a vector without a chunk. Chunks that agree need nothing.
    """
    key = ["doc_id", "chunk"]
    a = fresh.select(*key, F.sha2("text", 256).alias("new"))
    b = held.select(*key, F.sha2("text", 256).alias("old"))
    v = vectors.select(*key, F.lit(True).alias("vector"))
    both = a.join(b, key, "full_outer").join(v, key, "full_outer")
    action = (
        F.when(F.col("new").isNull() & F.col("old").isNull(), "drop_vector")
        .when(F.col("new").isNull(), "delete")
        .when(F.col("old").isNull(), "insert")
        .when(F.col("new") != F.col("old"), "update")
        .when(F.col("vector").isNull(), "embed")
    )
    return both.withColumn("action", action).where("action is not null").select(*key, "action")
