"""Token counts of every prefix, by dynamic programming over the tokenization automaton.

A byte-level vocabulary is compiled into the automaton of :mod:`korvane.llm.bpe`, which names the last token of the
encoding of each prefix of a pre-split piece. With it the count of a prefix is one more than the count of the prefix
before that token. Pieces are encoded one by one, so counts add up over a text; where the end of a prefix changes how
it is split (inside white space, a contraction or a special string) the change is worked out from the splitting rule.

``prefix_counts`` stores, for each document, by how much each character (code point) changes the count. ``count_at``
and ``longest_within`` answer truncation and budget questions from these, without tokenising again. Counts can fall
(two tokens merge when a letter comes), so the longest prefix within a budget is looked for, not the first one over it.

Defined results: null and empty texts have no characters and no tokens; strings of special tokens inside texts are
special tokens, as the library has it, and plain text while incomplete; one row comes back for each row, repeated rows
included; an empty table gives no rows; other columns are dropped by ``prefix_counts`` and kept by the questions. A budget
or place that is null gives null, one below zero counts as zero, a place behind the text's end counts as the end.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from korvane.llm.bpe import MergeAutomaton, WordTable, byte_letters
from korvane.llm.common import batches, prepare, text_bytes, whole_text

#: Contractions of three letters: cut after two, they are an apostrophe and a letter (fixed by the splitting pattern).
CONTRACTIONS = ("'re", "'ve", "'ll")


class PrefixTable(WordTable):
    """The automaton's table, asked for counts. Its rows stay bounded inside one long piece too."""

    def counts(self, symbols: bytes) -> list[int]:
        """The number of tokens of each prefix, the empty one first."""
        if len(self.states) > self.LIMIT:
            self._reset()
        row, size, out = self.rows[0], self.size, [0]
        for i, s in enumerate(symbols, 1):
            if s in row:
                row, token = row[s]
            else:
                if len(self.states) > 2 * self.LIMIT:
                    kept = self.states[row[None]]
                    self._reset()
                    row = self._row(kept)
                got = row[s] = self._step(row[None], s)
                row, token = got
            out.append(out[i - size[token]] + 1)
        return out

    def _row(self, key: tuple) -> dict:
        if key not in self.number:
            n = self.number[key] = len(self.states)
            self.states.append(key)
            self.rows.append({None: n})
        return self.rows[self.number[key]]


class PrefixCounter(dict):
    """Piece -> change of the count by each of its characters, as int16. Bounded: what is full makes way, and what is asked for again comes back; one a worker."""

    LIMIT = 250_000

    def __init__(self, json_file: str):
        import regex
        from public_tokenizers import PATTERN

        with open(json_file, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        symbol = {vocab[c]: b for b, c in enumerate(byte_letters())}
        spelled, merges = {t: (s,) for t, s in symbol.items()}, []
        for m in spec["model"]["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            merges.append((u, v, w))
            spelled.setdefault(w, spelled[u] + spelled[v])
        self.older: dict[str, bytes] = {}
        self.table = PrefixTable(MergeAutomaton(list(symbol), merges), spelled)
        self.findall = regex.compile(PATTERN).findall
        self.spaces = regex.compile(r"\s{2,}(?=\S)").finditer
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None

    def total(self, piece: str) -> int:
        return int(np.frombuffer(self[piece], np.int16).sum())

    def _keep(self, piece: str, out: bytes) -> None:
        if len(self) >= self.LIMIT:
            self.older = dict(self)
            self.clear()
        self[piece] = out

    def __missing__(self, piece: str) -> bytes:
        if (out := self.older.get(piece)) is not None:
            self._keep(piece, out)
            return out
        raw = piece.encode()
        n = self.table.counts(raw)
        if piece in CONTRACTIONS:
            n[2] = n[1] + self.total(piece[1])
        if len(raw) > len(piece):  # the places where a character begins, and the end
            n = [x for x, byte in zip(n, raw + b"a", strict=True) if byte & 0xC0 != 0x80]
        out = array("h", map(sub, n[1:], n)).tobytes()
        if len(piece) < 64:
            self._keep(piece, out)
        return out

    def _plain(self, text: str) -> tuple[np.ndarray, list[str]]:
        pieces = self.findall(text)
        out = np.frombuffer(b"".join(map(self.__getitem__, pieces)), np.int16).copy()
        for m in self.spaces(text):  # cut behind it, all of the white space is one piece; its last character goes to what follows
            run, end = m.group(), m.end()
            here = self.total(run) - self.total(run[:-1])
            out[end] += out[end - 1] - here
            out[end - 1] = here
        return out, pieces

    def changes(self, text: str) -> np.ndarray:
        """By how much each character of a text changes the count of its prefix."""
        if not self.split or not any(s in text for s in self.special):
            return self._plain(text)[0]
        parts, out, last = self.split(text), [], ""
        for i, p in enumerate(parts):
            if i % 2 == 0:
                change, pieces = self._plain(p)
                out.append(change)
                last = pieces[-1] if pieces else ""
                continue
            open_ = self._plain(last + p[:-1])[0].astype(np.int64).cumsum()  # incomplete, it is plain text after the last piece
            at = np.concatenate([[self.total(last) if last else 0], open_[len(last) :], [(self.total(last) if last else 0) + 1]])
            out.append(np.diff(at).astype(np.int16))
        return np.concatenate(out)


_counters: dict[str, PrefixCounter] = {}


def counter(json_file: str) -> PrefixCounter:
    if json_file not in _counters:
        _counters[json_file] = PrefixCounter(json_file)
    return _counters[json_file]


COUNTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_chars", T.LongType()),
    T.StructField("n_tokens", T.LongType()), T.StructField("changes", T.BinaryType()),
])


def _count(json_file: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(json_file)
        for b in batches(it):
            raw = text_bytes(b.column(1))
            got = [c.changes(t.decode()) for t in raw]
            cols = [[len(t) for t in raw], [len(x) for x in got], [int(x.sum(dtype=np.int64)) for x in got]]
            packed = pa.array([zlib.compress(x.tobytes(), 1) for x in got], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in cols), packed], names=COUNTS.names)

    return run


def prefix_counts(docs: DataFrame, json_file: str) -> DataFrame:
    """doc_id, n_bytes, n_chars, n_tokens and ``changes``: compressed, by how much each character changes the count."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(_count(json_file), COUNTS)


def counts_of(changes: bytes) -> np.ndarray:
    """The count of every prefix, the empty one first."""
    return np.concatenate([[0], np.frombuffer(zlib.decompress(changes), np.int16).astype(np.int64).cumsum()])


def _asked(stored: DataFrame, question: Column, name: str, answer) -> DataFrame:
    names = stored.columns
    asked = stored.select(F.struct("*").alias("row"), F.col("changes").alias("changes"), question.cast("long").alias("asked"))
    schema = T.StructType([T.StructField("row", stored.schema), T.StructField(name, T.LongType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            pairs = zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)
            out = [None if q is None or c is None else int(answer(counts_of(c), max(q, 0))) for c, q in pairs]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], names=["row", name])

    return asked.mapInArrow(run, schema).select(*(F.col("row").getField(c).alias(c) for c in names), name)


def count_at(stored: DataFrame, characters: Column, name: str = "tokens") -> DataFrame:
    """The rows with the token count of their prefix of so many characters."""
    return _asked(stored, characters, name, lambda n, q: n[min(q, len(n) - 1)])


def longest_within(stored: DataFrame, budget: Column, name: str = "characters") -> DataFrame:
    """The rows with the length, in characters, of their longest prefix of at most so many tokens."""
    return _asked(stored, budget, name, lambda n, q: np.flatnonzero(n <= q)[-1])
