"""Compression-distance classification of toxic text.

Two pairs of zstandard dictionaries are trained on labelled texts, in each pair one on toxic and one on ordinary
text. A window's distance is how many bytes shorter the toxic dictionary makes it than the ordinary one.

* Passage windows are :data:`SPAN` words in a row. The ordinary dictionary is trained on all windows of ordinary texts,
  the toxic one on those windows of toxic texts that hold a telling part (below; on all of them where no part tells).
* Word windows are one word with its boundaries, spelled out so that lengths tell its beginning apart. Here the toxic
  dictionary is trained on the parts of words (beginnings and whole words) that occur in more toxic than ordinary
  texts, by a likelihood-ratio test whose cut-off grows with the number of parts tested; the ordinary one on the words
  of ordinary texts. Parts that the trainer leaves out are appended, so that rare kinds (a language with few texts) are
  held like common ones, and so are beginnings that ordinary words share with a part.

In both pairs the toxic dictionary follows the ordinary one in compression: what it saves is what it adds.

Thresholds on these distances give counts and densities a document. Each kind of window is calibrated by itself, with
equal weight for both classes, on texts that the dictionaries were not trained on: halves of the sample take turns. A
document's evidence is the sum of both log-odds. The score 0.5 is put where these held-out texts are told apart best, an ordinary text marked counting :data:`DEAR` times a toxic one
missed. The final dictionaries are trained on all of the sample.

Learning takes a bounded sample: ``rows`` labelled documents at most, a quarter of them toxic at most, in hash order,
none of over ``longest`` characters, no more in all than ``total`` characters; a dictionary is trained on ``pieces`` windows
of these at most, drawn evenly. Scoring covers every whole text, with the same windows at every size of corpus.

Defined results: null and empty texts score what no window at all scores. A sample that teaches nothing (no label of
one kind, or so few that the held-out texts are not told apart beyond chance) gives every text the base rate of the
labels, and ``keep_ordinary`` then keeps every row: without evidence nothing is rejected. Labels that are null or of unknown documents are not used; of several texts
with one doc_id the alphabetically last is learnt from, and all are scored; repeated rows score alike; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import random
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from korvane.llm.common import batches, prepare, text_bytes, whole_text

#: Words are runs of letters: capitals A-Z are lowered, other ASCII separates, bytes from 128 are letters.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
#: Bytes that spell a letter in a word window. They follow from all letters up to it, so windows match in beginnings only.
SPELL = 3
#: A word's beginning in a window.
HEAD = bytes(range(1, 13))
#: Letters (bytes) of a word that word windows tell apart; a longer word counts by its beginning.
LONGEST = 11
#: Words of a passage window.
SPAN = 16
#: Bytes of the dictionaries: ordinary words, toxic words, ordinary passages, toxic passages.
USUAL, MARKED, PASSAGES, TOXIC_PASSAGES = 2048 * SPELL, 4096, 24576, 8192
#: Features of the passages, the last ones of a text.
WIDE = 3
#: An ordinary text marked as toxic weighs as many toxic texts missed.
DEAR = 5
#: Odds against chance that held-out texts must be told apart by.
SURE = 1e-3
#: Bytes saved by which word windows are told apart.
DEPTHS = np.array([5, 6, 8, 10, 12])
#: Windows that a dictionary is trained on.
PIECES = 40_000
CACHE = 200_000


def words(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


def passages(ws: list[bytes]) -> list[bytes]:
    return [b" %b " % b" ".join(ws[i : i + SPAN]) for i in range(0, len(ws), SPAN)]


def window(word: bytes, whole: bool = True) -> bytes:
    """A word or, if not ``whole``, a beginning of one, spelled out."""
    at, out = 0, [HEAD]
    for letter in word[:LONGEST] + b" " * (whole and len(word) < LONGEST):
        at = zlib.crc32(b"%c" % letter, at)
        out.append((at & 0xFFFFFF).to_bytes(SPELL, "little"))
    return b"".join(out)


def _parts(word: bytes) -> list[tuple[bytes, bool]]:
    """Beginnings of three bytes and more, and the whole word."""
    return [(word[:i], False) for i in range(3, min(len(word), LONGEST) + 1)] + [(word, True)] * (len(word) < LONGEST)


class Corpus:
    """Labelled texts as numbers of their distinct words."""

    def __init__(self, texts: list[bytes], y: np.ndarray):
        number: dict[bytes, int] = {}
        self.texts, self.y = texts, y
        self.ids = [np.array([number.setdefault(w, len(number)) for w in words(t)], np.int32) for t in texts]
        self.words = list(number)

    def pairs(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, word) of the picked texts; a word counts where no text before had it between the same neighbours."""
        size = np.array([len(self.ids[i]) for i in pick], np.int64)
        flat = np.concatenate([self.ids[i] for i in pick]) if len(pick) else np.zeros(0, np.int32)
        own = np.repeat(np.arange(len(pick), dtype=np.int64), size)
        edge = np.flatnonzero(np.diff(own)) + 1
        before, after = np.append(-1, flat[:-1]), np.append(flat[1:], -1)
        before[edge], after[edge - 1] = -1, -1
        key = sum((x.astype(np.uint64) + np.uint64(2)) * np.uint64(m) for x, m in ((before, 0x9E3779B97F4A7C15), (flat, 0xC2B2AE3D27D4EB4F), (after, 0x165667B19E3779F9)))
        first = np.unique(key, return_index=True)[1]
        found = np.unique(own[first] * len(self.words) + flat[first])
        return found // len(self.words), found % len(self.words)


def telling_parts(c: Corpus, pick: np.ndarray) -> list[tuple[bytes, bool]]:
    """The parts that mark toxic texts among the picked ones: always the most significant, on the words that none before it explains."""
    kinds = [pick[c.y[pick] == 1], pick[c.y[pick] == 0]]
    na, nb = map(len, kinds)
    (ta, wa), (tb, wb) = map(c.pairs, kinds)

    def ratio(x: int, y: int) -> float:
        if x < 3 or x * nb <= 2 * (y + 1) * na:
            return 0.0
        return 2 * (x * math.log(x * (na + nb) / ((x + y) * na)) + (y * math.log(y * (na + nb) / ((x + y) * nb)) if y else 0))

    distinct = np.unique(wa)
    cut = 2 * math.log(max(2, LONGEST * len(distinct)))
    # words that a part of them which is common enough could mark, by ever longer beginnings
    alive, often = distinct, set()
    for n in range(3, LONGEST + 2):  # the last round is that of whole words
        number: dict[tuple[bytes, bool], int] = {}
        part = np.full(len(c.words), -1, np.int64)
        for i in alive.tolist():
            w = c.words[i]
            if p := (w[:n], False) if n <= LONGEST and len(w) >= n else (w, True) if n > LONGEST and len(w) < LONGEST else None:
                part[i] = number.setdefault(p, len(number))
        held = part[wa] >= 0
        count = np.bincount(np.unique(ta[held] * (len(number) + 1) + part[wa[held]]) % (len(number) + 1), minlength=len(number))
        good = np.array([ratio(int(x), 0) >= cut for x in count[: len(number)]], bool)
        often |= {p for p, i in number.items() if good[i]}
        if n <= LONGEST:
            alive = np.array([i for i in (alive.tolist() if n < LONGEST else distinct.tolist()) if n == LONGEST or part[i] >= 0 and good[part[i]]], np.int64)
    holders: dict[tuple[bytes, bool], dict[int, tuple[set[int], set[int]]]] = defaultdict(dict)  # part -> word -> its texts
    known: dict[int, tuple[set[int], set[int]] | None] = {}
    for kind, (texts, own) in enumerate(((ta, wa), (tb, wb))):
        for i, w in zip(texts.tolist(), own.tolist(), strict=True):
            if w not in known:
                held = [p for p in _parts(c.words[w]) if p in often]
                known[w] = (set(), set()) if held else None
                for p in held:
                    holders[p][w] = known[w]
            if known[w]:
                known[w][kind].add(i)

    def worth(p: tuple[bytes, bool]) -> float:
        return ratio(*(len(set().union(*(sets[kind] for sets in holders[p].values()))) for kind in (0, 1)))

    queue = [(-r, -len(p[0]), p) for p in holders if (r := worth(p)) >= cut]
    heapq.heapify(queue)
    out = []
    while queue:
        r, n, p = heapq.heappop(queue)
        if (now := worth(p)) < -r - 1e-9:  # words went to other parts meanwhile
            if now >= cut:
                heapq.heappush(queue, (-now, n, p))
            continue
        out.append(p)
        for w in list(holders[p]):
            for q in _parts(c.words[w]):
                holders[q].pop(w, None)
    return out


def _dictionary(size: int, pieces: list[bytes], most: int, k: int = 32) -> bytes:
    """A dictionary trained on at most ``most`` of the pieces, drawn evenly, a few a sample."""
    random.Random(1).shuffle(pieces)
    samples = [b"".join(pieces[i : i + 6]) for i in range(0, min(len(pieces), most), 6)]
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=6, level=3).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: they are the dictionary
        return b"".join(dict.fromkeys(pieces[:most]))[-size:] or HEAD


def _compressor(raw: bytes, strategy: int, target: int, log: int = 13, least: int = 4) -> Callable[[bytes], bytes]:
    params = zstandard.ZstdCompressionParameters(
        window_log=log + 2, chain_log=log, hash_log=log, search_log=6, min_match=least, target_length=target, strategy=strategy,
        write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params).compress


class Words(dict):
    """Word -> bytes that the toxic dictionary, put behind the ordinary one, saves. Bounded."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.a, self.b = (_compressor(raw + HEAD, zstandard.STRATEGY_BTULTRA2, 256) for raw in (ordinary, ordinary + toxic + HEAD))

    def __missing__(self, word: bytes) -> int:
        w = window(word)
        saved = min(int(DEPTHS[-1]), max(0, len(self.a(w)) - len(self.b(w))))
        if len(self) >= CACHE:
            self.clear()
        self[word] = saved
        return saved


@dataclass
class Dictionaries:
    """What distances need: the dictionaries of ordinary and toxic words and passages."""

    words: tuple[bytes, bytes] = (HEAD, HEAD)
    passages: tuple[bytes, bytes] = (HEAD, HEAD)


class Windows:
    """Distances of a text's windows, summed up as features."""

    def __init__(self, d: Dictionaries):
        self.word = Words(*d.words)
        ordinary, toxic = d.passages
        self.a, self.b = (_compressor(raw, zstandard.STRATEGY_DFAST, 0, 14, 5) for raw in (ordinary, ordinary + toxic))

    def gains(self, ws: list[bytes]) -> np.ndarray:
        """Bytes that the toxic passages save in each passage window."""
        a, b = self.a, self.b
        return np.array([len(a(p)) - len(b(p)) for p in passages(ws)] or [0], float)

    def features(self, text: bytes) -> np.ndarray:
        ws, word = words(text), self.word
        saved = np.bincount(np.fromiter([word[w[:LONGEST]] for w in ws], np.int64, len(ws)), minlength=DEPTHS[-1] + 1)
        least = saved[::-1].cumsum()[::-1][DEPTHS]
        density = 200.0 / (len(ws) + 10)
        gain = self.gains(ws)
        wide = [np.clip(gain.mean() / 2, -1, 1), np.clip(gain.max() / 16, -1, 1), (gain >= 4).mean()]
        return np.concatenate([[1.0], np.log1p(density * least), least >= 1, least >= 2, wide])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 2.0) -> np.ndarray:
    """Weights of a logistic curve; both classes weigh the same."""
    each = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    w, r = np.zeros(x.shape[1]), np.eye(x.shape[1]) * ridge
    r[0, 0] = 1e-6
    for _ in range(40):
        p = _curve(x @ w)
        w -= np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + r, x.T @ (each * (p - y)) + r @ w)
    return w


def _curve(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    """Dictionaries and calibrated weights; without weights nothing was learnt and every text scores ``base``."""

    dictionaries: Dictionaries = field(default_factory=Dictionaries)
    weights: list[float] = field(default_factory=list)
    base: float = 0.0

    def windows(self) -> Windows:
        return Windows(self.dictionaries)

    def score(self, text: bytes, windows: Windows) -> float:
        return float(_curve(windows.features(text) @ np.array(self.weights))) if self.weights else self.base


def train(c: Corpus, pick: np.ndarray, pieces: int = PIECES) -> Dictionaries:
    """Both pairs of dictionaries, from the picked texts."""
    toxic, plain = pick[c.y[pick] == 1], pick[c.y[pick] == 0]
    parts = telling_parts(c, pick)
    spelled = [window(*p) for p in parts]
    at = {p: i for i, p in reversed(list(enumerate(parts)))}
    own = [min((at[p] for p in _parts(w) if p in at), default=-1) for w in c.words]  # the first part that a word has
    found = [spelled[own[w]] for i in toxic for w in np.unique(c.ids[i]).tolist() if own[w] >= 0]
    marked = _dictionary(MARKED, found, pieces)
    marked += b"".join(p for p in reversed(spelled) if p not in marked)
    once = [np.unique(c.ids[i]) for i in plain]
    flat = np.concatenate(once) if once else np.zeros(0, np.int32)
    drawn = np.random.default_rng(1).permutation(flat)[:pieces]
    usual = _dictionary(USUAL, [window(c.words[w]) for w in drawn.tolist()], pieces, 64)
    begun = {p[:i] for p, _ in parts for i in range(1, len(p) + 1)}
    often: Counter = Counter()
    for w, n in enumerate(np.bincount(flat, minlength=len(c.words)).tolist()):
        if n and own[w] < 0:
            often[next((c.words[w][:i] for i in range(LONGEST, 0, -1) if c.words[w][:i] in begun), b"")] += n
    usual += b"".join(window(p, False) for p, n in sorted(often.items()) if p and n >= max(3, len(plain) / 500))
    tells = {w for w, p in zip(c.words, own, strict=True) if p >= 0}
    spread = [[p for i in kind for p in passages(words(c.texts[i]))] for kind in (plain, toxic)]
    spread[1] = [p for p in spread[1] if not tells.isdisjoint(p.split())] or spread[1]
    wide = tuple(_dictionary(size, p, pieces, 48) for size, p in zip((PASSAGES, TOXIC_PASSAGES), spread, strict=True))
    return Dictionaries((usual, marked), wide)


def threshold(z: np.ndarray, y: np.ndarray) -> float | None:
    """Where held-out values are told apart best; None if chance alone would often do as well."""
    order = np.argsort(-z, kind="stable")
    v, t = z[order], np.cumsum(y[order])
    f = np.arange(1, len(y) + 1) - t
    ends = np.append(np.flatnonzero(np.diff(v)), len(v) - 1)  # ties stay together
    gain = t[ends] / y.sum() - DEAR * f[ends] / (len(y) - y.sum())
    best = int(gain.argmax())
    if gain[best] <= 0 or best == len(ends) - 1:
        return None
    k = ends[best]
    # the chance that as many as k + 1 texts drawn blindly hold as many toxic ones, for any of the cuts tried
    n, drawn, hit, lg = len(y), int(k) + 1, int(t[k]), math.lgamma
    choose = lambda a, b: lg(a + 1) - lg(b + 1) - lg(a - b + 1)
    pos = int(y.sum())
    tail = sum(math.exp(choose(pos, i) + choose(n - pos, drawn - i) - choose(n, drawn)) for i in range(hit, min(pos, drawn) + 1) if drawn - i <= n - pos)
    return float(v[k] + v[k + 1]) / 2 if tail * math.log2(n + 1) < SURE else None


def fit(texts: list[bytes], labels: list[int], pieces: int = PIECES) -> Model:
    """Calibrates on halves in turn, then trains the dictionaries on all texts."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Model(base=float(y.mean()) if len(y) else 0.0)
    half = np.zeros(len(y), bool)
    for v in (0, 1):
        half[np.flatnonzero(y == v)[::2]] = True
    base, least = float(y.mean()), min(int(y.sum()), int((1 - y).sum()))
    if least < 2:  # a half would lack a kind
        return Model(base=base)
    c, x = Corpus(texts, y), np.zeros((len(y), len(Windows(Dictionaries()).features(b""))))
    for learnt in (half, ~half):
        win = Windows(train(c, np.flatnonzero(learnt), pieces))
        for i in np.flatnonzero(~learnt):
            x[i] = win.features(texts[i])
    w = np.zeros(x.shape[1])
    for own in (np.arange(x.shape[1] - WIDE), np.append(0, np.arange(x.shape[1] - WIDE, x.shape[1]))):
        w[own] += _logistic(x[:, own], y)  # the constant 1 belongs to both
    cut = threshold(x @ w, y)
    if cut is None:
        return Model(base=base)
    w[0] -= cut  # the first feature is 1: the score 0.5 lies at the threshold
    return Model(train(c, np.arange(len(y)), pieces), w.tolist(), base)


def fold_of(column: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(5))


MODEL = T.StructType([
    T.StructField("words", T.ArrayType(T.BinaryType())), T.StructField("passages", T.ArrayType(T.BinaryType())),
    T.StructField("weights", T.ArrayType(T.DoubleType())), T.StructField("base", T.DoubleType()),
])


def _fitted(pieces: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((i, t, y) for b in batches(it) for i, t, y in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), b.column(2).to_pylist(), strict=True))
        m = fit([t for _, t, _ in got], [int(y) for _, _, y in got], pieces)
        d = m.dictionaries
        kinds = pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.float64()), pa.float64()
        cols = [pa.array([x], kind) for x, kind in zip((list(d.words), list(d.passages), m.weights, m.base), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(cols, names=MODEL.names)

    return run


def learn(docs: DataFrame, labels: DataFrame, rows: int = 3000, longest: int = 200_000, pieces: int = PIECES, total: int = 60_000_000) -> Model:
    """Fits on at most ``rows`` labelled documents of the folds 1 to 4 and of ``longest`` characters, in hash order, ``total`` characters at most.

    A task fits the sample; only the model, a row of some kilobytes, comes to the driver, which holds no texts.
    """
    mine = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold_of() != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    picked = [mine.where(F.col("toxic") == v).orderBy(*order).limit(n) for v, n in ((1, rows // 4), (0, rows - rows // 4))]
    few = picked[0].unionByName(picked[1])
    texts = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).where(F.length("text") <= longest)
    found = texts.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.first("toxic").alias("toxic"))  # ``rows`` at most
    so_far = F.sum(F.length("text")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    sample = found.withColumn("so_far", so_far).where(F.col("so_far") <= total).select("doc_id", "text", "toxic")
    prepare(docs.sparkSession)
    got = sample.coalesce(1).mapInArrow(_fitted(pieces), MODEL).collect()  # one row; none of an empty sample
    return Model(Dictionaries(*(tuple(map(bytes, got[0][k])) for k in ("words", "passages"))), got[0]["weights"], got[0]["base"]) if got else Model()


SCORES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])


def _scorer(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        win = model.windows()
        for b in batches(it):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(t, win) for t in text_bytes(b.column(1))], pa.float64())], names=SCORES.names)

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every whole text."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(_scorer(model), SCORES)


def keep_ordinary(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs``, all columns, whose whole text scores under the threshold; all rows if the model has learnt nothing."""
    if not model.weights:
        return docs
    prepare(docs.sparkSession)
    at, names = docs.columns.index("text"), docs.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        win = model.windows()
        for b in batches(it):
            ok = pa.array([model.score(t, win) < threshold for t in text_bytes(b.column(at))])
            yield pa.RecordBatch.from_arrays(b.columns, names=names).filter(ok)

    return docs.mapInArrow(run, docs.schema)
