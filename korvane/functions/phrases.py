"""Many phrases found in texts in one pass: a trie over words, leftmost first, the longest of those that begin at one word.

A dictionary of proven size (:data:`HELD` words, counted) is compiled once a task and every text is walked once. A
greater one is spread by first words: texts meet only the phrases that begin with a word of theirs, each meeting is
verified, and the same choice is made from what was found. Both ways give the same rows.

Defined results: words are runs of letters and digits, compared without regard to case, so a phrase never matches inside a word;
null and empty texts have no match; phrases without a word are left out; of phrases with the same words the smallest id counts;
matches don't overlap unless that is asked for; repeated rows match each; other columns of the texts are kept by ``mask``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile(r"[^\W_]+")
#: Words of a dictionary that every task may hold.
HELD = 2_000_000
#: Rows of matches handed on at once.
ROWS = 8192

FOUND = T.StructType([T.StructField("text_id", T.LongType()), T.StructField("phrase_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("words", T.LongType())])


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """The words of a text with their places in it."""
    return [(m.group().casefold(), *m.span()) for m in WORD.finditer(text or "")]


class Trie:
    """Phrases by their words; ``None`` as a key holds the id of the phrase that ends there."""

    def __init__(self, phrases: list[tuple[int, list[str]]]):
        self.root: dict = {}
        for own, ws in phrases:
            if ws:
                at = self.root
                for w in ws:
                    at = at.setdefault(w, {})
                at[None] = min(own, at.get(None, own))

    def longest(self, ws: list[tuple[str, int, int]], i: int) -> tuple[int, int] | None:
        """Id and end of the longest phrase that begins at word ``i``."""
        at, best = self.root, None
        while i < len(ws) and (at := at.get(ws[i][0])) is not None:
            i += 1
            if None in at:
                best = at[None], i
        return best

    def find(self, text: str | None, overlapping: bool = False) -> list[tuple[int, int, int, int]]:
        """(phrase, start, stop, words) of the matches of a text, in order; with ``overlapping``, one for each word that a phrase begins at."""
        ws, out, i = spans(text), [], 0
        while i < len(ws):
            got = self.longest(ws, i)
            if got:
                out.append((got[0], ws[i][1], ws[got[1] - 1][2], got[1] - i))
            i = got[1] if got and not overlapping else i + 1
        return out


def _words(text: str | None) -> list[str]:
    return [w for w, _, _ in spans(text)]


def _split(df: DataFrame, own: str) -> DataFrame:
    """own, ws: the words of each phrase, as an array."""
    schema = T.StructType([T.StructField("own", T.LongType()), T.StructField("ws", T.ArrayType(T.StringType()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_words(t) for t in b.column(1).to_pylist()], pa.list_(pa.string()))], names=schema.names)

    return df.where(F.col(own).isNotNull()).select(F.col(own).cast("long"), "text").mapInArrow(run, schema).where(F.size("ws") > 0)


def dictionary(phrases: DataFrame) -> list[tuple[int, list[str]]] | None:
    """The phrases (phrase_id, text), if all their words together are few enough to be held; else None."""
    ws = _split(phrases, "phrase_id")
    total = ws.agg(F.sum(F.size("ws"))).first()[0] or 0
    return [(r["own"], list(r["ws"])) for r in ws.collect()] if total <= HELD else None  # HELD words at most


def _walked(texts: DataFrame, make: Callable[[], Trie], overlapping: bool = False) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = make()
        for b in it:
            out = [(own, *m) for own, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for m in trie.find(t, overlapping)]
            for i in range(0, len(out), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out[i : i + ROWS], strict=True)], names=FOUND.names)

    return texts.select(F.col("text_id").cast("long"), "text").mapInArrow(run, FOUND)


def _met(texts: DataFrame, phrases: DataFrame, overlapping: bool = False) -> DataFrame:
    """The same by a join on first words, for dictionaries of any size."""
    placed = T.StructType([T.StructField("text_id", T.LongType()), T.StructField("row", T.LongType()), T.StructField("ws", T.ArrayType(T.StructType([T.StructField("w", T.StringType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])))])

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("w", pa.string()), ("a", pa.int64()), ("b", pa.int64())]))
        for b in it:
            ws = [[{"w": w, "a": i, "b": j} for w, i, j in spans(t)] for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ws, kind)], names=placed.names)

    def choose(held: pa.Table) -> pa.Table:
        free, out = 0, []
        for first, size, own, start, stop, text in sorted(zip(*(held.column(c).to_pylist() for c in ("i", "size", "own", "start", "stop", "text_id")), strict=True), key=lambda r: (r[0], -r[1], r[2])):
            if first >= free:
                out.append((text, own, start, stop, size))
                free = first + size
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [()] * 5)], names=FOUND.names)

    rows = texts.select(F.col("text_id").cast("long"), F.monotonically_increasing_id().alias("row"), "text").mapInArrow(cut, placed)
    known = _split(phrases, "phrase_id").groupBy("ws").agg(F.min("own").alias("own")).select("own", "ws", F.col("ws")[0].alias("head"))
    each = rows.select("text_id", "row", "ws", F.posexplode("ws").alias("i", "x")).select("text_id", "row", F.col("ws").alias("held"), "i", F.col("x.w").alias("head"))
    size = F.size("ws")
    same = F.transform(F.slice("held", F.col("i") + 1, size), lambda x: x["w"]) == F.col("ws")
    hits = each.join(known, "head").where(same).select("text_id", "row", "i", size.alias("size"), "own", F.col("held")[F.col("i")]["a"].alias("start"), F.col("held")[F.col("i") + size - 1]["b"].alias("stop"))
    longest = hits.groupBy("text_id", "row", "i").agg(F.max(F.struct("size", -F.col("own"), "own", "start", "stop")).alias("m")).select("text_id", "row", "i", "m.size", "m.own", "m.start", "m.stop")
    if overlapping:
        return longest.select("text_id", F.col("own").alias("phrase_id"), "start", "stop", F.col("size").cast("long").alias("words"))
    return longest.groupBy("row").applyInArrow(choose, FOUND)


def find(texts: DataFrame, phrases: DataFrame, overlapping: bool = False) -> DataFrame:
    """text_id, phrase_id, start, stop, words: every match in texts (text_id, text) of phrases (phrase_id, text).

    With ``overlapping``, a match takes no word from others: at each word the longest phrase that begins there is a match.
    """
    held = dictionary(phrases)
    return _met(texts, phrases, overlapping) if held is None else _walked(texts, lambda: Trie(held), overlapping)


def longest(texts: DataFrame, phrases: DataFrame, overlapping: bool = False) -> DataFrame:
    """text_id, phrase_id, words: of a text's matches the one of most words, ties to the smaller id; with ``overlapping``, of all phrases that the text holds."""
    best = F.max(F.struct("words", (-F.col("phrase_id")).alias("less"))).alias("best")
    return find(texts, phrases, overlapping).groupBy("text_id").agg(best).select("text_id", (-F.col("best.less")).alias("phrase_id"), "best.words")


def mask(texts: DataFrame, phrases: DataFrame, column: str = "text") -> DataFrame:
    """The rows with the matches of phrases (phrase_id, text, kind) in a column replaced by ``<kind>``, all in one pass."""
    held = dictionary(phrases)
    if held is None:
        raise ValueError(f"more than {HELD} words to mask by: split the phrases")
    kinds = {r["phrase_id"]: r["kind"] for r in phrases.where("phrase_id is not null").groupBy("phrase_id").agg(F.min("kind").alias("kind")).collect()}  # as many as phrases
    at = texts.columns.index(column)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(held)
        for b in it:
            out = []
            for t in b.column(at).to_pylist():
                parts, end = [], 0
                for own, start, stop, _ in trie.find(t):
                    parts += [t[end:start], f"<{kinds[own]}>"]
                    end = stop
                out.append(None if t is None else "".join([*parts, t[end:]]))
            cols = list(b.columns)
            cols[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return texts.mapInArrow(run, texts.schema)
