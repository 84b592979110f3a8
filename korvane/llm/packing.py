"""Concatenate and cut: documents packed into sequences without gaps.

Pass one tokenises every document once and writes its ids with the ids before it in its own partition.
Partition totals (one row a partition) become global offsets by a prefix sum. Pass two cuts each document
at multiples of the sequence length; no token is shuffled. Where a window straddles two documents or two
partitions, each side gives its own boundary record with the same sequence_id.

Defined results: null and empty texts give the end id alone; ties, repeated rows and repeated ids are packed
one after another, each on its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from korvane.llm.common import Stages, batches, prepare, text_bytes, whole_text

TOKENS = T.StructType([
    T.StructField("part", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("before", T.LongType()),
    T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.BinaryType()),
])
PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()), T.StructField("ids", T.BinaryType()),
])

_encoders: dict[str, PieceCache] = {}


class PieceCache(dict):
    """Pre-split piece -> its ids as little-endian bytes. Bounded: emptied when full."""

    LIMIT = 250_000

    def __init__(self, json_file: str):
        import regex
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(json_file)
        self.wide = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.findall = regex.compile(PATTERN).findall
        self.special = {t.content: self._pack([i]) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.encode_piece = self._ranks(os.path.splitext(json_file)[0] + ".tiktoken") or self._by_tokenizer

    def _ranks(self, path: str):
        """The same vocabulary as ranks, if it lies beside the file: its encoder is faster for single pieces."""
        if not os.path.exists(path):
            return None
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if any(self.tokenizer.token_to_id(t) is None for t in ("a", "Ġthe")):
            return None
        core = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        return lambda piece: core.encode_single_piece(piece.encode())

    def _by_tokenizer(self, piece: str) -> list[int]:
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.wide).tobytes()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.LIMIT:
            self.clear()
        out = self._pack(self.encode_piece(piece))
        if len(piece) < 64:
            self[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a whole text; literals of special tokens are their own ids, as the library has it."""
        parts = self.split(text) if self.split and any(s in text for s in self.special) else [text]
        get = self.__getitem__
        return b"".join(self.special[p] if self.split and p in self.special else b"".join(map(get, self.findall(p))) for p in parts)


def encoder(json_file: str) -> PieceCache:
    """One a Python worker; it outlives a task."""
    if json_file not in _encoders:
        _encoders[json_file] = PieceCache(json_file)
    return _encoders[json_file]


def _tokenise(json_file: str, end_id: int | None):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, before = encoder(json_file), TaskContext.get().partitionId(), 0
        end = b"" if end_id is None else np.array([end_id], enc.wide).tobytes()
        for b in batches(it):
            ids = [enc.encode(t.decode()) + end for t in text_bytes(b.column(1))]
            n = np.fromiter((len(x) // enc.wide.itemsize for x in ids), np.int64, len(ids))
            starts = before + np.concatenate([[0], np.cumsum(n)[:-1]])
            before += int(n.sum())
            if enc.wide.itemsize == 4:
                packed = ids
            else:
                packed = ids
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part)), b.column(0), pa.array(starts), pa.array(n), pa.array(packed, pa.binary())], names=TOKENS.names)

    return run


def _cut(length: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            out: list[tuple] = []
            docs, at, totals, ids = (b.column(i).to_pylist() for i in range(4))
            for doc, g, n, raw in zip(docs, at, totals, ids, strict=True):
                wide = np.frombuffer(raw, f"<u{len(raw) // n}" if n else "<u4").astype("<u4").tobytes()
                start = 0
                while start < n:
                    seq, off = divmod(g + start, length)
                    size = min(length - off, n - start)
                    own = wide[4 * start : 4 * (start + size)]
                    out.append((doc, start, size, zlib.crc32(own), n, seq, off, own))
                    start += size
            cols = list(zip(*out, strict=True)) if out else [()] * 8
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:7]), pa.array(cols[7], pa.binary())], names=PIECES.names)

    return run


def pack(docs: DataFrame, json_file: str, length: int = 2048, end_id: int | None = 1) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids as little-endian uint32)."""
    spark = prepare(docs.sparkSession)
    stages = Stages(spark, "packing")
    tokens = stages.write(docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(_tokenise(json_file, end_id), TOKENS))
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n")).orderBy("part").collect()  # a row a partition, whatever the rows
    offsets, total = [], 0
    for r in totals:
        offsets.append((r["part"], total))
        total += r["n"]
    small = spark.createDataFrame(offsets, "part long, base long")
    small = F.broadcast(small) if len(offsets) <= 1_000_000 else small
    placed = tokens.join(small, "part").select("doc_id", (F.col("base") + F.col("before")).alias("at"), "doc_tokens", "ids")
    return placed.mapInArrow(_cut(length), PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, length, ids. A group holds at most one sequence's ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    joined = F.aggregate(F.col("p"), F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("p")).select("sequence_id", "length", joined.alias("ids"))
