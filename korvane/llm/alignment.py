"""Alignment of two tokenizers' ids over the same bytes, and how often two ids are linked in the whole corpus.

Both tokenizers see a space and the text. The cumulative ends of each one's tokens are kept in a dictionary from end to
index; the sorted keys that both hold cut the two id lists into groups, and within a group every pair of tokens whose
bytes overlap is a link. A text is worked on in chunks that begin at a space after something else: neither tokenizer has
a token across such a place, so both end there, and a chunk that comes again is looked up.

The links of whole corpora are counted without shuffling a row a link. Documents are taken in blocks of bounded size;
a block names its distinct id pairs once and its documents refer to them by place. Pair totals come from one
aggregation over (block, pair) rows and go back to the blocks that asked.

Defined results: null and empty texts, and texts whose tokens do not spell a space and the text (the second vocabulary's
own sign for a space occurs in them), have no tokens: zeros and ''. Strings of special tokens are plain text. One row comes
back for each row, repeated rows included, and repeated rows count each; an empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain, count, product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from korvane.llm.bpe import byte_letters
from korvane.llm.common import Stages, batches, prepare, text_bytes, whole_text
from korvane.llm.packing import PieceCache

#: The sign of the second vocabulary for a space.
SPACE = "▁"
#: Bytes of text in a block; a longer document is one.
BLOCK = 1 << 23

Group = tuple[list[int], list[int]]
Chunk = tuple[int, int, int, bytes, bytes] | tuple[()]


def cuts(a: list[int], b: list[int], size_a: list[int], size_b: list[int]) -> tuple[list[int], list[int]]:
    """How many ids of each list lie before each common end, in order; ``size`` are the bytes of each id."""
    index_a, index_b = (dict(zip(accumulate(map(size.__getitem__, ids)), count(1))) for ids, size in ((a, size_a), (b, size_b)))
    both = sorted(index_a.keys() & index_b.keys())
    return list(map(index_a.__getitem__, both)), list(map(index_b.__getitem__, both))


def groups(a: list[int], b: list[int], size_a: list[int], size_b: list[int]) -> list[Group]:
    """The two id lists cut where tokens of both end."""
    to_a, to_b = cuts(a, b, size_a, size_b)
    return [(a[i:i2], b[j:j2]) for i, i2, j, j2 in zip([0, *to_a], to_a, [0, *to_b], to_b)]


def links(group: Group, size_a: list[int], size_b: list[int]) -> list[tuple[int, int]]:
    """The overlapping pairs of a group, in order: where one token ends, the next of its side takes its place."""
    a, b = group
    if len(a) == 1 or len(b) == 1:
        return list(product(a, b))
    out, ends_a, ends_b, i, j = [], list(accumulate(size_a[t] for t in a)), list(accumulate(size_b[t] for t in b)), 0, 0
    while i < len(a) and j < len(b):
        out.append((a[i], b[j]))
        x, y = ends_a[i], ends_b[j]
        i, j = i + (x <= y), j + (y <= x)
    return out


class PieceIds(PieceCache):
    """Pre-split piece -> its ids. Only pieces are asked for, so strings of special tokens are plain text."""

    def _pack(self, ids: list[int]) -> list[int]:
        return list(ids)


class Aligner:
    """Both tokenizers, and aligned chunks. Bounded: what is full makes way, and what comes again comes back; one a worker."""

    LIMIT = 300_000

    def __init__(self, byte_file: str, piece_file: str):
        import sentencepiece

        self.first = PieceIds(byte_file)
        value = {c: b for b, c in enumerate(byte_letters())}
        names = self.first.tokenizer.get_vocab(with_added_tokens=False)
        spell_a = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            spell_a[i] = bytes(value[c] for c in name) if all(c in value for c in name) else name.encode()
        self.second = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        pieces = [self.second.id_to_piece(i) for i in range(self.second.vocab_size())]
        spell_b = [bytes.fromhex(p[3:5]) if self.second.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.spell_a, self.spell_b = spell_a.__getitem__, spell_b.__getitem__
        self.size_a, self.size_b = list(map(len, spell_a)), list(map(len, spell_b))
        # a piece over such a place would make chunks depend on each other
        apart = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.chunks = re.compile(r"(?<=\S)(?= )").split if apart else lambda text: [text]
        self.known: dict[str, Chunk] = {}
        self.older: dict[str, Chunk] = {}

    def _second(self, chunks: list[str]) -> list[list[int]]:
        """It puts a space before each text, but makes no token of no text, not even that of the space."""
        space = [self.second.piece_to_id(SPACE)]
        return [x or space for x in self.second.encode([c[1:] for c in chunks], num_threads=1)]

    def _aligned(self, chunks: list[str]) -> list[Chunk]:
        """New chunks, as one text: both sides end where a chunk ends. If they don't spell it, each chunk is tried by itself."""
        split, ids = self.first.findall, self.first.__getitem__
        first, second = [list(chain.from_iterable(map(ids, split(c)))) for c in chunks], self._second(chunks)
        a, b = list(chain.from_iterable(first)), list(chain.from_iterable(second))
        raw = "".join(chunks).encode()
        if b"".join(map(self.spell_a, a)) != raw or b"".join(map(self.spell_b, b)) != raw:
            return [()] if len(chunks) == 1 else [x for c in chunks for x in self._aligned([c])]
        size_a, size_b, out, at, i, j = self.size_a, self.size_b, [], 0, 0, 0
        to_a, to_b = cuts(a, b, size_a, size_b)
        end_a = end_b = 0
        for x, y in zip(map(len, first), map(len, second), strict=True):
            begun, said, found, end_a, end_b = at, [], [], end_a + x, end_b + y
            while i < end_a:
                i2, j2 = to_a[at], to_b[at]
                at += 1
                if i2 - i == 1 == j2 - j:
                    v, w = a[i], b[j]
                    said.append(f"{v}|{w}")
                    found.append(v << 32 | w)
                else:
                    g = a[i:i2], b[j:j2]
                    said.append(f"{','.join(map(str, g[0]))}|{','.join(map(str, g[1]))}")
                    found += [v << 32 | w for v, w in links(g, size_a, size_b)]
                i, j = i2, j2
            if i != end_a or j != end_b:  # a chunk's end is not an end of both
                return [z for c in chunks for z in self._aligned([c])]
            out.append((x, y, at - begun, ";".join(said).encode(), array("q", found).tobytes()))
        return out

    def look_up(self, chunks: list[str]) -> list[Chunk]:
        """The aligned form of every chunk: token counts, number and text of groups, links as int64 of first id << 32 | second id; empty if the tokens spell something else."""
        known, older = self.known, self.older
        new = set(chunks).difference(known)
        if new:
            made = {c: older[c] for c in new if c in older}
            rest = list(new.difference(made))
            made |= zip(rest, self._aligned(rest), strict=True)
            if len(known) + len(made) > self.LIMIT:
                made |= {c: known[c] for c in set(chunks).intersection(known)}
                self.older, self.known = known, {}
            known = self.known
            known |= made
        out = list(map(known.__getitem__, chunks))
        for c in new:
            if len(c) >= 64:
                del known[c]
        return out

    def align(self, text: str) -> tuple[int, int, int, bytes, bytes]:
        """Counts, groups as text and links of a whole text."""
        got = self.look_up(self.chunks(" " + text)) if text else []
        if not got or () in got:
            return 0, 0, 0, b"", b""
        a, b, g, said, found = zip(*got, strict=True)
        return sum(a), sum(b), sum(g), b";".join(said), b"".join(found)


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(byte_file: str, piece_file: str) -> Aligner:
    key = byte_file, piece_file
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


_L, _B = T.LongType(), T.BinaryType()
#: Rows of documents, and one row a block with its distinct pairs and how often it holds each.
MADE = T.StructType([
    T.StructField("block", _L), T.StructField("of_block", T.BooleanType()), T.StructField("doc_id", _L), T.StructField("n_a", _L), T.StructField("n_b", _L),
    T.StructField("n_groups", _L), T.StructField("groups_sha256", T.StringType()), T.StructField("groups", _B), T.StructField("links", _B), T.StructField("times", _B),
])
ASKED = T.StructType([T.StructField("block", _L), T.StructField("place", T.IntegerType()), T.StructField("pair", _L), T.StructField("n", _L)])
DONE = T.StructType([
    T.StructField("doc_id", _L), T.StructField("n_a", _L), T.StructField("n_b", _L), T.StructField("n_groups", _L), T.StructField("n_links", _L),
    T.StructField("n_best", _L), T.StructField("count_sum", _L), T.StructField("groups_sha256", T.StringType()), T.StructField("groups", _B),
])


def _make(byte_file: str, piece_file: str, keep: bool, size: int):
    def finish(block: int, rows: list[tuple], found: list[bytes], per_doc: list[int]) -> pa.RecordBatch:
        every = np.frombuffer(b"".join(found), np.int64)
        place, pairs = pd.factorize(every)
        times, place, ends = np.bincount(place, minlength=len(pairs)), place.astype("<u4"), np.cumsum(per_doc)
        own = [place[e - n : e].tobytes() for e, n in zip(ends, per_doc, strict=True)]
        full = [(block, False, *r, x, None) for r, x in zip(rows, own, strict=True)]
        full.append((block, True, None, None, None, None, None, None, pairs.astype("<i8").tobytes(), times.astype("<i8").tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*full, strict=True), KINDS, strict=True)], names=MADE.names)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = aligner(byte_file, piece_file)
        block, held, rows, found, per_doc = TaskContext.get().partitionId() << 32, 0, [], [], []
        for b in batches(it):
            for doc, raw in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), strict=True):
                a, n, g, said, got = made.align(raw.decode())
                rows.append((doc, a, n, g, hashlib.sha256(said).hexdigest() if a else "", said if keep else None))
                per_doc.append(len(got) // 8)
                found.append(got)
                held += len(raw)
                if held >= size:
                    yield finish(block, rows, found, per_doc)
                    block, held, rows, found, per_doc = block + 1, 0, [], [], []
        if rows:
            yield finish(block, rows, found, per_doc)

    return run


KINDS = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary()]


def _ask(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(it):
        for block, pairs, times in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            pair, n = np.frombuffer(pairs, "<i8"), np.frombuffer(times, "<i8")
            for i in range(0, len(pair), 1 << 16):
                part = slice(i, i + (1 << 16))
                size = len(pair[part])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, block)), pa.array(np.arange(i, i + size, dtype=np.int32)), pa.array(pair[part]), pa.array(n[part])], names=ASKED.names)


def _answer(docs: pa.Table, told: pa.Table) -> pa.Table:
    """One block: its documents and the totals of its pairs."""
    order = told.column("place").to_numpy()
    total, best = np.zeros(len(order), np.int64), np.zeros(len(order), bool)
    total[order], best[order] = told.column("total").to_numpy(), told.column("best").to_numpy(zero_copy_only=False)
    own = [np.frombuffer(x, "<u4") for x in docs.column("links").to_pylist()]
    sums = [[len(x) for x in own], [int(best[x].sum()) for x in own], [int(total[x].sum()) for x in own]]
    cols = [docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")] + [pa.array(x, pa.int64()) for x in sums] + [docs.column("groups_sha256"), docs.column("groups")]
    return pa.table(cols, names=DONE.names)


class Alignment:
    """Documents of a corpus aligned once, in written tables of the shared folder."""

    def __init__(self, docs: DataFrame, byte_file: str, piece_file: str, keep: bool = False, block: int = BLOCK):
        self.stages = Stages(prepare(docs.sparkSession), "alignment")
        rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
        self.made = self.stages.write(rows.mapInArrow(_make(byte_file, piece_file, keep, block), MADE))
        of_blocks = self.made.where("of_block").select("block", "links", "times")
        self.asked = self.stages.write(of_blocks.mapInArrow(_ask, ASKED))
        totals = self.asked.groupBy("pair").agg(F.sum("n").alias("total"))
        second = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
        most = totals.groupBy(second.alias("b")).agg(F.max("total").alias("most"))  # a row an id of the second vocabulary
        self.totals = self.stages.write(totals.join(most, second == F.col("b")).select("pair", "total", (F.col("total") == F.col("most")).alias("best")))

    def pairs(self) -> DataFrame:
        """Every linked id pair of the corpus: a_id, b_id, how many links hold it, whether it is the most frequent of its b_id."""
        return self.totals.select(F.shiftrightunsigned("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b_id"), F.col("total").alias("n"), "best")

    def documents(self) -> DataFrame:
        """One row a document; ``groups`` holds its groups as text if they were to be kept."""
        told = self.asked.join(self.totals, "pair").select("block", "place", "total", "best")
        docs = self.made.where("not of_block").drop("of_block", "times")
        return docs.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_answer, DONE)
