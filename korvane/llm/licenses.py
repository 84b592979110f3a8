"""License scans: winnowed fingerprints, an inverted index, banded alignment.

Texts and templates are lowered and reduced to words of letters and digits with one space between. Hashes of
all 16-letter grams are winnowed: the least of each 8 in a row is a fingerprint, so a stretch of 23 letters in common
has one in common. Fingerprints of :data:`TEMPLATES` templates at a time form the inverted index, which is what bounds it; a text's fingerprints found there propose a template at a place, and each place is settled by
a banded alignment of words, which reports how much of the template is matched, and where.

Defined results: null and empty texts, and texts that match no template, give no rows; each row of a repeated
document is scanned and reports for itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from korvane.llm.common import batches, prepare, text_bytes, whole_text
from korvane.llm.suffixes import POSITION, gram_hashes
from korvane.llm.templates import NOTICES

GRAM, WINDOW, BAND = 16, 8, 6
#: Templates of one index; more are scanned for in several turns.
TEMPLATES = 5000
KEPT = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
FOUND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("license", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("matched_words", T.LongType()), T.StructField("template_words", T.LongType()), T.StructField("coverage", T.DoubleType())])


def winnow(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the fingerprints of a reduced text."""
    hashes, places = [], []
    step = POSITION - GRAM - WINDOW
    for base in range(0, max(1, len(text) - GRAM + 1), step):
        data = np.frombuffer(text[base : base + POSITION], np.uint8)
        if len(data) < GRAM:
            continue
        g = gram_hashes(data, GRAM)
        least = (g & np.uint64((1 << 64) - 1 - POSITION)) | np.arange(len(g), dtype=np.uint64)
        for width in (1, 2, 4):
            if len(least) > width:
                least = np.minimum(least[:-width], least[width:])
        at = np.unique((least & np.uint64(POSITION)).astype(np.int64))
        hashes.append(g[at])
        places.append(at + base)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(places)


class Index:
    """Fingerprint -> (template, place)."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words = [templates[n].encode().translate(KEPT).split() for n in self.names]
        postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, ws in enumerate(self.words):
            h, at = winnow(b" ".join(ws))
            for x, p in zip(h.tolist(), at.tolist(), strict=True):
                postings[x].append((i, p))
        self.postings = dict(postings)
        self.keys = np.array(sorted(postings), np.uint64)

    def scan(self, text: bytes, least: float) -> list[tuple]:
        """(license, start, stop, matched words, template words, coverage) in bytes of the text."""
        ws = text.translate(KEPT).split()
        h, at = winnow(b" ".join(ws))
        if not len(h) or not len(self.keys):
            return []
        hit = self.keys[np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)] == h
        if not hit.any():
            return []
        starts = np.cumsum([0, *(len(w) + 1 for w in ws)])
        spans = [m.span() for m in WORD.finditer(text)]
        places: dict[int, list[int]] = defaultdict(list)  # template -> word at which it would begin
        for x, p in zip(h[hit].tolist(), at[hit].tolist(), strict=True):
            for t, q in self.postings[x]:
                own = self.words[t]
                before = np.searchsorted(_starts(tuple(own)), q, "right") - 1
                places[t].append(int(np.searchsorted(starts, p, "right") - 1 - before))
        out = []
        for t, begins in sorted(places.items()):
            done = -(1 << 60)
            for b in sorted(begins):
                if b < done + max(1, min(BAND, len(self.words[t]) // 2)):  # the band reaches this place too
                    continue
                done = b
                pairs = align(self.words[t], ws, b)
                cover = len(pairs) / len(self.words[t])
                if cover >= least:
                    out.append((self.names[t], spans[pairs[0]][0], spans[pairs[-1]][1], len(pairs), len(self.words[t]), cover))
        return _widest(out)


def _widest(found: list[tuple]) -> list[tuple]:
    """Without a template's weaker finds that overlap its better ones; spans kept of one template never overlap, so only neighbours are asked."""
    out: list[tuple] = []
    taken: dict[str, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))
    for f in sorted(found, key=lambda f: (-f[5], f[1], f[0])):
        starts, stops = taken[f[0]]
        i = bisect.bisect_left(starts, f[2])  # spans before i begin before this one ends
        if not i or stops[i - 1] <= f[1]:
            j = bisect.bisect_left(starts, f[1])
            starts.insert(j, f[1])
            stops.insert(j, f[2])
            out.append(f)
    return sorted(out, key=lambda f: (f[1], f[0]))


@functools.lru_cache(TEMPLATES)
def _starts(words: tuple[bytes, ...]) -> np.ndarray:
    return np.cumsum([0, *(len(w) + 1 for w in words)])


def align(template: list[bytes], text: list[bytes], begin: int) -> list[int]:
    """Words of the text matched, in order, by a longest common subsequence within ``BAND`` words of the diagonal from ``begin``."""
    width = 2 * BAND + 1
    best = [0] * width
    back: list[list[int]] = []
    for i, w in enumerate(template):
        new, step = [0] * width, [0] * width
        for d in range(width):
            j = begin + i + d - BAND
            up = best[d + 1] if d + 1 < width else -1  # this template word is skipped
            left = new[d - 1] if d else -1  # this text word is skipped
            diag = best[d] + 1 if 0 <= j < len(text) and text[j] == w else -1
            new[d] = max(up, left, diag, 0)
            step[d] = 3 if diag == new[d] and diag > 0 else 1 if up == new[d] and up >= left else 2 if left == new[d] else 0
        back.append(step)
        best = new
    i, d, pairs = len(template) - 1, max(range(width), key=lambda x: (best[x], -abs(x - BAND))), []
    while i >= 0 and 0 <= d < width:
        s = back[i][d]
        if s == 3:
            pairs.append(begin + i + d - BAND)
            i -= 1
        elif s == 1:
            i, d = i - 1, d + 1
        elif s == 2:
            d -= 1
        else:
            break
    return pairs[::-1]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.8) -> DataFrame:
    """A row for each template found in a whole text, with the share of its words matched and the span in bytes."""
    prepare(docs.sparkSession)
    chosen = sorted((NOTICES if templates is None else templates).items())
    turns = [_scan(docs, dict(chosen[i : i + TEMPLATES]), coverage) for i in range(0, max(1, len(chosen)), TEMPLATES)]
    return functools.reduce(DataFrame.unionByName, turns)


def _scan(docs: DataFrame, chosen: dict[str, str], coverage: float) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(chosen)
        for b in batches(it):
            rows = [(d, *f) for d, t in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), strict=True) for f in index.scan(t, coverage)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=FOUND.names)

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(run, FOUND)
