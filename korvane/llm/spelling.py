"""Spelling variants: words one edit apart, found by pivotal grams, and the frequent form that each leads to.

Bigrams are put in one order, rare ones first. A word's prefix are its three first bigrams in that order (with all that
tie with the third); two that don't overlap are its pivots, chosen by dynamic programming for the fewest words in all.
One edit spoils one pivot at most, so of two words one edit apart, one has a pivot that is untouched and in the other's
prefix. The index holds prefixes, the queries are pivots, and position limits make their keys: the edit is before or
behind the untouched bigram, so all on its other side is equal, and so is one half of what is left on the edit's own
side. What shares a key is verified by the edit distance itself.

Words come from whole texts and are counted in each task before they are shuffled. Words, their near words and the
forms are tables of the shared folder; chains of forms are followed by doubling, and since each form is ``ratio`` times
as frequent, the number of rounds follows from the largest count.

Defined results: null and empty texts have no words, a null doc_id spells as the empty text in the damage rule; equal
counts are settled by the smallest word in code-point order; repeated rows count each; an empty table, or one without any
word of the asked length and count, gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from korvane.llm.common import Stages, batches, prepare, text_bytes, whole_text

#: Code points of a word's letters; only A-Z have a lower case here.
RUN = "[A-Za-zÀ-ÿ]+"
LOWER = {c: c + 32 for c in range(65, 91)}
#: One edit: three bigrams make a prefix, two disjoint ones the pivots.
EDITS = 1
SIZE = 2
PREFIX, PIVOTS = SIZE * EDITS + 1, EDITS + 1
#: Bigrams whose frequency is looked up; rarer ones count as not seen, which keeps the order total and the table small.
HELD = 1 << 16
#: Distinct words that a task counts before it hands them on.
FLUSH = 400_000

COUNTED = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])
MARKED = T.StructType([*COUNTED.fields, T.StructField("prefix", T.ArrayType(T.IntegerType())), T.StructField("pivots", T.ArrayType(T.IntegerType()))])


def damaged(doc: str, word: str, every: int) -> str:
    """The word, less one code point if ``every`` divides the checksum of document and word."""
    h = zlib.crc32(f"{doc}:{word}".encode())
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def _count(least: int, every: int | None):
    find = re.compile(RUN).findall

    def handed(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=COUNTED.names)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches(it):
            for doc, raw in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), strict=True):
                own = Counter(find(raw.decode().translate(LOWER)))
                for word, n in own.items():
                    w = damaged(doc or "", word, every) if every else word
                    if len(w) >= least:
                        held[w] += n
                if len(held) >= FLUSH:
                    yield handed(held)
                    held.clear()
        if held:
            yield handed(held)

    return run


def count_words(docs: DataFrame, least: int = 6, every: int | None = None) -> DataFrame:
    """word and n of all words of ``least`` code points and more; with ``every``, words are damaged first as in :func:`damaged`."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("string"), whole_text().alias("text"))
    return rows.mapInArrow(_count(least, every), COUNTED).groupBy("word").agg(F.sum("n").alias("n"))


def choose(grams: list[tuple[int, int]], picks: int = PIVOTS) -> list[int]:
    """Positions of ``picks`` grams (position, cost) that don't overlap and cost least together."""
    grams = sorted(grams)
    best: list[list[tuple[float, tuple[int, ...]]]] = [[(0.0, ())] * (len(grams) + 1)]
    for _ in range(picks):
        row: list[tuple[float, tuple[int, ...]]] = [(math.inf, ())]
        for i, (at, cost) in enumerate(grams):
            free = sum(1 for p, _ in grams[:i] if p + SIZE <= at)  # those that end before this one begins
            before, chosen = best[-1][free]
            row.append(min(row[-1], (before + cost, (*chosen, at))))
        best.append(row)
    return list(best[-1][-1][1])


def marks(word: str, often: dict[str, int]) -> tuple[list[int], list[int]]:
    """Positions of the prefix and of the pivots of a word of four code points or more."""
    grams = sorted((often.get(g, 0), g, i) for i, g in enumerate(word[i : i + SIZE] for i in range(len(word) - 1)))
    last = grams[PREFIX - 1][:2]
    prefix = [i for n, g, i in grams if (n, g) <= last]
    return prefix, choose([(i, n) for n, _, i in grams[:PREFIX]])


def _mark(often: dict[str, int]):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            got = [marks(w, often) for w in b.column(0).to_pylist()]
            places = [pa.array([g[i] for g in got], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *places], names=MARKED.names)

    return run


def _keyed(words: DataFrame, positions: str, asking: bool) -> DataFrame:
    """A row for each position, partner's length, side of the edit and half that stays equal."""
    rows = words.select("word", "n", F.length("word").alias("size"), F.explode(positions).alias("at"))
    rows = rows.select("*", F.explode(F.array(*map(F.lit, (-1, 0, 1)))).alias("more"))
    word, size, at = F.col("word"), F.col("size"), F.col("at")
    both = [size, size + F.col("more")] if asking else [size + F.col("more"), size]

    def part(start: Column | int, length: Column) -> Column:
        return word.substr(F.lit(start) if isinstance(start, int) else start, length)

    behind, tail = F.least(*both) - at - SIZE, size - at
    before = F.least(*both) - tail
    half, half_b = F.shiftright(behind, 1), F.shiftright(before, 1)
    keys = [
        F.when(behind >= 0, F.xxhash64(F.lit(1), *both, at, part(1, at + SIZE + half))),
        F.when(behind >= 0, F.xxhash64(F.lit(2), *both, at, part(1, at + SIZE), part(size - behind + half + 1, behind - half))),
        F.when(before >= 0, F.xxhash64(F.lit(3), *both, tail, part(size - tail - half_b + 1, tail + half_b))),
        F.when(before >= 0, F.xxhash64(F.lit(4), *both, tail, part(1, before - half_b), part(at + 1, tail))),
    ]
    return rows.select("word", "n", F.explode(F.array(*keys)).alias("key")).where("key IS NOT NULL")


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs of words (a < b) exactly one edit apart, with their n. ``words`` are distinct, of four code points or more."""
    grams = words.select(F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("i"), "word").select(F.col("word").substr(F.col("i"), F.lit(SIZE)).alias("gram"))
    often = {r["gram"]: r["n"] for r in grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "gram").limit(HELD).collect()}  # HELD rows at most
    marked = words.select("word", "n").mapInArrow(_mark(often), MARKED)
    index = _keyed(marked, "prefix", False)
    asked = _keyed(marked, "pivots", True).select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
    found = index.join(asked.hint("merge"), "key").where((F.col("word") != F.col("other")) & (F.levenshtein("word", "other", EDITS) == EDITS))
    one, two = F.struct("word", "n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"))
    pairs = found.select(F.least(one, two).alias("x"), F.greatest(one, two).alias("y")).distinct()
    return pairs.select(F.col("x.word").alias("a"), F.col("x.n").alias("a_n"), F.col("y.word").alias("b"), F.col("y.n").alias("b_n"))


def _beside(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A left join that shuffles both sides: the tables grow with the words, and small files unpack to much more in the driver than their size tells."""
    return left.join(right.hint("merge"), key, "left")


def group_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of distinct words with their counts."""
    spark = prepare(words.sparkSession)
    stages = Stages(spark, "spelling")
    words = stages.write(words.select("word", "n"))
    pairs = stages.write(near_pairs(words))
    ways = [F.struct(F.col(x).alias("word"), F.col(y).alias("near"), F.col(f"{y}_n").alias("near_n")) for x, y in (("a", "b"), ("b", "a"))]
    near = pairs.select(F.explode(F.array(*ways)).alias("w")).select("w.*")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    joined = _beside(words, best, "word").withColumn("form_n", -F.col("best.less"))
    strong = F.col("form_n") >= ratio * F.col("n")
    forms = stages.write(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.near")).alias("form"), F.when(strong, F.col("form_n")).alias("form_n")))
    most = forms.agg(F.max("form_n")).first()[0] or 1
    steps = int(math.log(most, max(ratio, 2))) + 1  # each form has ``ratio`` times the count of the word before it
    hops = forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(steps.bit_length()):
        further = hops.select(F.col("word").alias("root"), F.col("root").alias("next"))
        hops = stages.write(_beside(hops, further, "root").select("word", F.coalesce("next", "root").alias("root")))
    return _beside(forms, hops, "word").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
