"""Suffix-array dedup: repeated byte strings by difference-cover blockwise suffix sorting.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier, in a smaller doc_id or earlier in the
same document. Strings are judged on the input and never cross documents.

Which suffixes can have a partner is decided first, without loss: the least 24-byte gram by hash of each string of
LENGTH bytes (leftmost of equals) is its anchor; equal strings have equal anchors, so only suffixes whose anchor
occurs twice go on. An anchor is also the suffix's bucket: consecutive suffixes of one bucket travel as one
slice of text. A task sorts one block of whole buckets at a time. Equal slices of a bucket are settled on sight. The
rest are sorted by their first 31 bytes; longer ties are resolved by ranks of the difference-cover sample
{1, 5, 11, 24, 25, 27} modulo 31, computed once a block: two suffixes are compared at the first shift that
brings both into the sample. Neighbours with a common prefix of LENGTH bytes are one class; all but its first
member are covered. A bucket with more distinct slices than ``most`` is not sorted in one task: it is split by
the longest prefix there is, all LENGTH bytes of a string, and its parts are dealt out and settled like any bucket.

Defined results: null and empty texts and texts under LENGTH bytes lose nothing; exact copies of a whole text of at
least LENGTH bytes lose all of it; rows that agree in doc_id and text are one document and are treated alike; of
different texts with one doc_id the order is by hash; documents without doc_id come last; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from korvane.llm.common import Stages, batches, packed, partitions, prepare, text_bytes, unpacked, whole_text

LENGTH, GRAM = 100, 24
SPAN = LENGTH - GRAM + 1  # grams in a string
#: A perfect difference cover and its period.
COVER, PERIOD = (1, 5, 11, 24, 25, 27), 31
#: Text of one block of anchors (its positions fit into 20 bits), and of one block of buckets.
BLOCK, POSITION = 1 << 19, (1 << 20) - 1
LAST = (1 << 63) - 1

_SLICE = T.StructType([T.StructField("h", T.LongType()), T.StructField("s", T.IntegerType()), T.StructField("c", T.IntegerType()), T.StructField("a", T.IntegerType())])
PARCEL = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("known", T.BooleanType()), *(T.StructField(n, T.BinaryType()) for n in ("docs", "own", "h", "s", "ca", "marks"))])
REPEATED = T.StructType([T.StructField("did", T.LongType()), T.StructField("tie", T.LongType()), *_SLICE.fields])
SLICES = T.StructType([T.StructField("h", T.LongType()), T.StructField("did", T.LongType()), T.StructField("tie", T.LongType()), T.StructField("s", T.IntegerType()), T.StructField("c", T.IntegerType()), T.StructField("a", T.IntegerType()), T.StructField("text", T.BinaryType())])
SPANS = T.StructType([T.StructField("did", T.LongType()), T.StructField("tie", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("rest", T.BinaryType())])
CUT = T.StructType([T.StructField("did", T.LongType()), T.StructField("tie", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())])


@functools.cache
def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    n = POSITION + 1
    return np.cumprod(np.full(n, base, np.uint64)), np.cumprod(np.full(n, pow(base, -1, 1 << 64), np.uint64))


def gram_hashes(data: np.ndarray, size: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` bytes, by wrapping prefix sums."""
    n = len(data)
    up, down = _powers(base)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[size:] - sums[:-size]) * down[: n - size + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """For texts laid end to end: hash, text number, first string, strings and anchor (from the first string on) of each slice."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    if len(data) < LENGTH or not (size >= LENGTH).any():
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    g = gram_hashes(data, GRAM)
    least = (g & np.uint64((1 << 64) - 1 - POSITION)) | np.arange(len(g), dtype=np.uint64)
    width = 1
    while 2 * width <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < SPAN:
        least = np.minimum(least[: len(least) - (SPAN - width)], least[SPAN - width :])
    at = (least & np.uint64(POSITION)).astype(np.int64)  # anchor of each string
    end = np.cumsum(size)
    text = np.repeat(np.arange(len(texts)), size)[: len(at)]
    start = np.arange(len(at))
    ok = start + LENGTH <= end[text]
    new = ok.copy()
    new[1:] &= ~(ok[:-1] & (at[1:] == at[:-1]) & (text[1:] == text[:-1]))
    first = np.flatnonzero(new)
    run = np.cumsum(new)[ok] - 1
    count = np.bincount(run, minlength=len(first))
    own = text[first]
    return g[at[first]].view(np.int64), own, first - (end - size)[own], count, at[first] - first


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, int, list[bytes]]]:
    """(number of the first text, its offset, texts): short texts together, a long text in overlapping pieces."""
    held: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        if held and size + len(t) > BLOCK:
            yield i - len(held), 0, held
            held, size = [], 0
        if len(t) <= BLOCK:
            held.append(t)
            size += len(t)
        else:
            step = BLOCK - LENGTH + 1
            for at in range(0, len(t) - LENGTH + 1, step):
                yield i, at, [t[at : at + BLOCK]]
    if held:
        yield len(texts) - len(held), 0, held


#: Slices that a task gathers before it sends parcels.
FLUSH = 1 << 20


def _pack(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def _open(x: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), kind)


def _parcels(buckets: int):
    """Slices by bucket of their anchor, packed. Of anchors that a task sees twice only a mark goes to the bucket; their slices are known and travel with any."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        docs: list[np.ndarray] = []
        rows = n_docs = flushes = 0

        def row(bucket: int, known: bool, pick: np.ndarray, marks: np.ndarray, cols: list[np.ndarray], names: np.ndarray) -> pa.RecordBatch:
            own, h, s, ca = (c[pick] for c in cols)
            used, own = np.unique(own, return_inverse=True)
            parts = [_pack(names[used]), _pack(own.astype(np.uint32)), h.tobytes(), _pack(s), _pack(ca), marks.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([known]), *(pa.array([x], pa.binary()) for x in parts)], names=PARCEL.names)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, docs, rows, n_docs, flushes
            if not rows:
                return
            cols = [np.concatenate([x[i] for x in held]) for i in range(4)]
            names, h = np.concatenate(docs), cols[1].view(np.uint64)
            _, first, inverse, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            twice = count[inverse] > 1
            yield row(flushes % buckets, True, np.flatnonzero(twice), np.zeros(0, np.int64), cols, names)
            single, marks = np.flatnonzero(~twice), cols[1][first[count > 1]]
            of, of_mark = h[single] % np.uint64(buckets), marks.view(np.uint64) % np.uint64(buckets)
            single, marks = single[np.argsort(of, kind="stable")], marks[np.argsort(of_mark, kind="stable")]
            cut, cut_marks = (np.concatenate([[0], np.cumsum(np.bincount(x.astype(np.int64), minlength=buckets))]) for x in (of, of_mark))
            for i in range(buckets):
                p, m = single[cut[i] : cut[i + 1]], marks[cut_marks[i] : cut_marks[i + 1]]
                if len(p) or len(m):
                    yield row(i, False, p, m, cols, names)
            held, docs, rows, n_docs, flushes = [], [], 0, 0, flushes + 1

        for b in batches(it):
            texts = text_bytes(b.column(2))
            for base, off, block in _blocks(texts):
                h, own, s, c, a = anchors(block)
                held.append((own + (base + n_docs), h, (s + off).astype(np.int32), np.stack([c, a], axis=1).astype(np.uint8)))
                rows += len(h)
            docs.append(np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(2)], axis=1))
            n_docs += len(texts)
            if rows >= FLUSH:
                yield from flush()
        yield from flush()

    return run


def _repeated(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slices whose anchor is in two parcels of its bucket, or marked; known ones pass."""

    def out(parcel: tuple, keep: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        docs, own, h, s, ca = (_open(parcel[0], np.int64).reshape(-1, 2), _open(parcel[1], np.uint32), np.frombuffer(parcel[2], np.int64), _open(parcel[3], np.int32), _open(parcel[4], np.uint8).reshape(-1, 2))
        if keep is not None:
            own, h, s, ca = own[keep], h[keep], s[keep], ca[keep]
        for i in range(0, len(h), 20_000):
            j = slice(i, i + 20_000)
            yield pa.RecordBatch.from_arrays([pa.array(docs[own[j], 0]), pa.array(docs[own[j], 1]), pa.array(h[j]), pa.array(s[j]), pa.array(ca[j, 0].astype(np.int32)), pa.array(ca[j, 1].astype(np.int32))], names=REPEATED.names)

    held: list[tuple] = []
    now = None

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal held
        if held:
            every = [np.frombuffer(p[2], np.int64) for p in held]
            marks = np.concatenate([np.frombuffer(p[5], np.int64) for p in held])
            seen, count = np.unique(np.concatenate([*every, marks, marks]), return_counts=True)
            twice = seen[count > 1]
            for p, h in zip(held, every, strict=True):
                at = np.minimum(np.searchsorted(twice, h), max(0, len(twice) - 1))
                yield from out(p, twice[at] == h if len(twice) else np.zeros(len(h), bool))
        held = []

    for b in batches(it):
        for bucket, known, *parcel in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
            if bucket != now:
                yield from close()
                now = bucket
            if known:
                yield from out(tuple(parcel), None)
            else:
                held.append(tuple(parcel))
    yield from close()


def _slices(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices with their text. One equal to an earlier slice that this task has sent is settled here: it goes without text, under any key."""
    sent: dict[bytes, list[int]] = {}
    for b in batches(it):
        texts = text_bytes(b.column(2))
        lists = b.column(3)
        n = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        own = np.repeat(np.arange(len(texts)), n)
        h, s, c, a = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
        did, tie = (b.column(i).to_numpy(zero_copy_only=False)[own] for i in range(2))
        text = [texts[o][x : x + y] for o, x, y in zip(own.tolist(), s.tolist(), (c + (LENGTH - 1)).tolist(), strict=True)]
        key = h.copy()
        for i, (t, *at) in enumerate(zip(text, did.tolist(), tie.tolist(), s.tolist(), strict=True)):
            if sent.setdefault(t, at) < at:
                text[i], key[i] = None, xxhash.xxh64_intdigest(b"%d,%d,%d" % tuple(at)) >> 1
        if len(sent) > 100_000:
            sent.clear()
        h = key
        for i in range(0, len(h), 8192):
            j = slice(i, i + 8192)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[j]) for x in (h, did, tie, s, c, a)), pa.array(text[j], pa.binary())], names=SLICES.names)


def _words(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each position on, as numbers that sort like the bytes."""
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)[at]).view(">u8").ravel().astype(np.uint64)


def _names(*keys: np.ndarray) -> np.ndarray:
    """Ranks from 1 of tuples of keys, first key first; equal tuples share one."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) + 1
    return out


def _shifts() -> np.ndarray:
    """For each two residues, the first shift that brings both into the cover."""
    inside = np.zeros(PERIOD, bool)
    inside[list(COVER)] = True
    i, j, k = np.ogrid[:PERIOD, :PERIOD, :PERIOD]
    both = inside[(i + k) % PERIOD] & inside[(j + k) % PERIOD]
    assert both.any(axis=2).all()
    return both.argmax(axis=2)


SHIFT = _shifts()


def sort_block(texts: list[bytes], strings: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffix order of the first ``strings`` suffixes of each slice: slice and offset in that order, and whether each has LENGTH bytes in common with the one before. Slices are laid so that anchors are multiples of the period."""
    size = strings + LENGTH - 1
    base, at = np.empty(len(texts), np.int64), 0
    for i, (n, a) in enumerate(zip(size.tolist(), anchor.tolist(), strict=True)):
        at += -(at + a) % PERIOD
        base[i] = at
        at += n
    data = np.zeros(at + 2 * PERIOD + LENGTH + 8, np.uint8)
    for b, t in zip(base.tolist(), texts, strict=True):
        data[b : b + len(t)] = np.frombuffer(t, np.uint8)
    own = np.repeat(np.arange(len(texts)), strings)
    offset = np.arange(len(own)) - np.repeat(np.cumsum(strings) - strings, strings)
    start = base[own] + offset

    bytes_of = np.repeat(np.arange(len(texts)), size)
    every = base[bytes_of] + np.arange(len(bytes_of)) - np.repeat(np.cumsum(size) - size, size)
    sampled = np.isin(every % PERIOD, COVER)
    sample, sample_of = every[sampled], bytes_of[sampled]
    # first 31 bytes of suffixes and sample positions in one sort
    where = np.concatenate([start, sample])
    first = _names(*(_words(data, where + 8 * i) for i in range(3)), _words(data, where + 24) >> np.uint64(8))
    head = first[: len(start)]
    # sample ranks to 31, 62, then 124 bytes; past a slice's end the rank is 0
    rank = np.zeros(len(data), np.int64)
    rank[sample] = first[len(start) :]
    end = base + size
    for step in (PERIOD, 2 * PERIOD):
        beyond = sample + step
        nxt = np.where(beyond < end[sample_of], rank[np.minimum(beyond, len(data) - 1)], 0)
        rank[sample] = _names(rank[sample], nxt)
    residue = start % PERIOD
    tail = rank[start + SHIFT[residue, residue]]
    order = np.lexsort((tail, residue, head))
    order = _mixed(order, head, residue, start, rank)
    s = start[order]
    same = np.zeros(len(s), bool)
    same[1:] = head[order][1:] == head[order][:-1]
    check = np.flatnonzero(same)
    for i in [*range(PERIOD, LENGTH - 8, 8), LENGTH - 8]:
        check = check[_words(data, s[check] + i) == _words(data, s[check - 1] + i)]
    same[:] = False
    same[check] = True
    return own[order], offset[order], same, order


def _mixed(order: np.ndarray, head: np.ndarray, residue: np.ndarray, start: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Long ties between suffixes of different residues: one of each run of equal rank is compared, at the shift of both residues."""
    h, r = head[order], residue[order]
    edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    stop = np.append(edge[1:], len(order))
    mixed = np.flatnonzero(r[edge] != r[stop - 1])
    if not len(mixed):
        return order
    out = order.copy()
    tail = rank[start[order] + SHIFT[r, r]]
    for g in mixed.tolist():
        i, j = int(edge[g]), int(stop[g])
        new = np.flatnonzero(np.concatenate([[True], (r[i + 1 : j] != r[i : j - 1]) | (tail[i + 1 : j] != tail[i : j - 1])])) + i
        ends = np.append(new[1:], j)

        def before(x: int, y: int) -> int:
            p, q = start[order[x]], start[order[y]]
            k = SHIFT[r[x], r[y]]
            return int(rank[p + k] - rank[q + k])

        runs = sorted(range(len(new)), key=functools.cmp_to_key(lambda x, y: before(new[x], new[y]) or x - y))
        out[i:j] = np.concatenate([order[new[x] : ends[x]] for x in runs])
    return out


def covered(texts: list[bytes], place: np.ndarray, strings: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slice, first and past-last string of each run of strings that also occur at a smaller (place, offset)."""
    own, offset, same, _ = sort_block(texts, strings, anchor)
    kind = np.cumsum(~same) - 1
    position = place[own] * (LENGTH + 1) + offset
    least = np.minimum.reduceat(position, np.flatnonzero(~same))
    later = position > least[kind]
    o, f = own[later], offset[later]
    order = np.lexsort((f, o))
    o, f = o[order], f[order]
    if not len(o):
        return o, f, f
    head = np.concatenate([[True], (o[1:] != o[:-1]) | (f[1:] != f[:-1] + 1)])
    i = np.flatnonzero(head)
    return o[i], f[i], f[np.append(i[1:], len(f)) - 1] + 1


def _buckets(most: int, block: int = 12_000):
    """Blocks of whole buckets, rows in order of bucket and position."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        ready: list[tuple] = []  # slices of closed buckets with several texts
        bucket: dict[bytes, tuple] = {}
        now, over = None, False

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal done
            for i in range(0, len(done), 20_000):
                cols = list(zip(*done[i : i + 20_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.binary())], names=SPANS.names)
            done = []

        def settle() -> None:
            nonlocal ready
            if not ready:
                return
            did, tie, s, c, a = (np.array([r[i] for r in ready], np.int64) for i in range(5))
            order = np.lexsort((s, tie, did))
            new = np.concatenate([[True], (did[order][1:] != did[order][:-1]) | (tie[order][1:] != tie[order][:-1]) | (s[order][1:] != s[order][:-1])])
            place = np.empty(len(order), np.int64)
            place[order] = np.cumsum(new)
            o, f, g = covered([r[5] for r in ready], place, c, a)
            done.extend(zip(did[o].tolist(), tie[o].tolist(), (s[o] + f).tolist(), (s[o] + g + LENGTH - 1).tolist(), [None] * len(o), strict=True))
            ready = []

        def close() -> None:
            nonlocal bucket, over
            if over:
                done.extend((*v[:4], v[5]) for v in bucket.values())  # its strings are told by count
            elif len(bucket) > 1:
                ready.extend(bucket.values())
            bucket, over = {}, False

        for b in batches(it):
            cols = [b.column(i).to_pylist() for i in range(7)]
            for h, did, tie, s, c, a, text in zip(*cols, strict=True):
                if text is None:
                    done.append((did, tie, s, s + c + LENGTH - 1, None))
                    continue
                if h != now:
                    close()
                    now = h
                    if len(ready) >= block:
                        settle()
                seen = bucket.get(text)
                if seen is not None:
                    if seen[:3] != (did, tie, s):  # rows come in order of position, so this one is later
                        done.append((did, tie, s, s + c + LENGTH - 1, None))
                    continue
                bucket[text] = (did, tie, s, c, a, text)
                if len(bucket) > most:
                    over = True
                    done.extend((*v[:4], v[5]) for v in bucket.values())  # its strings are told by count
                    bucket = {}
                elif over and len(bucket) * 20 > most:
                    done.extend((*v[:4], v[5]) for v in bucket.values())  # its strings are told by count
                    bucket = {}
                if len(done) >= 20_000:
                    yield from emit()
            if len(done) >= 20_000:
                yield from emit()
        close()
        settle()
        yield from emit()

    return run


def _strings(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings of overfull buckets as slices of one string each, in buckets by their own bytes. One equal to an earlier string that this task has sent is settled here."""
    sent: dict[bytes, list[int]] = {}
    for b in batches(it):
        for did, tie, s, c, text in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            keys = gram_hashes(np.frombuffer(text, np.uint8), LENGTH)[:c].view(np.int64).tolist()
            strings: list[bytes | None] = [text[i : i + LENGTH] for i in range(c)]
            for i, t in enumerate(strings):
                if sent.setdefault(t, [did, tie, s + i]) < [did, tie, s + i]:
                    strings[i], keys[i] = None, xxhash.xxh64_intdigest(b"%d,%d,%d" % (did, tie, s + i)) >> 1
            if len(sent) > 200_000:
                sent.clear()
            same = [pa.array([x] * c, k) for x, k in ((did, pa.int64()), (tie, pa.int64()), (1, pa.int32()), (0, pa.int32()))]
            at = pa.array((s + np.arange(c)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), same[0], same[1], at, same[2], same[3], pa.array(strings, pa.binary())], names=SLICES.names)


def _cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(it):
        rows = []
        for did, tie, text, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), text_bytes(b.column(2)), b.column(3).to_pylist(), strict=True):
            kept, at, n = [], 0, 0
            for p in sorted(spans, key=lambda p: p["start"]):
                if p["start"] > at or not n:
                    kept.append(text[at : p["start"]])
                    n += 1
                at = max(at, p["stop"])
            kept.append(text[at:])
            left = b"".join(kept)
            rows.append((did, tie, len(text) - len(left), n, left))
        cols = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())], names=CUT.names)


def repeats(docs: DataFrame, most: int = 20_000) -> DataFrame:
    """doc_id, tie (hash of the text), n_bytes, n_removed, n_spans, sha (of all bytes) and kept (the bytes left; null where nothing goes)."""
    spark = prepare(docs.sparkSession)
    stages = Stages(spark, "suffixes")
    text = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).withColumn("tie", F.xxhash64("text"))
    did = F.coalesce("doc_id", F.lit(LAST)).alias("did")
    found = stages.write(text.select("doc_id", "tie", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("sha")))
    several = found.groupBy("sha").agg(F.min(did).alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = stages.write(found.select(did, "tie", "sha", "n_bytes").join(several, "sha").where(f"did > first and n_bytes >= {LENGTH}").select("did", "tie").distinct())
    n = partitions(spark)
    parcels = text.select(did, "tie", "text").mapInArrow(_parcels(n), PARCEL).repartition(n, "bucket").sortWithinPartitions("bucket")
    twice = stages.write(parcels.mapInArrow(_repeated, REPEATED).join(copies, ["did", "tie"], "left_anti"))
    mine = twice.groupBy("did", "tie").agg(F.collect_list(F.struct("h", "s", "c", "a")).alias("slices"))
    some = stages.write(text.select(did, "tie", "text").join(mine, ["did", "tie"]).select("did", "tie", "text", "slices"))
    stages.drop(twice)
    dealt = some.mapInArrow(_slices, SLICES).repartition(n, "h").sortWithinPartitions("h", "did", "tie", "s")
    spans = stages.write(dealt.mapInArrow(_buckets(most), SPANS))
    # buckets too large for one task, split by whole strings: equal strings meet, and their bytes are compared
    large = spans.where("rest is not null").select("did", "tie", F.col("start").alias("s"), F.col("stop").alias("c"), "rest").mapInArrow(_strings, SLICES)
    more = large.repartition(n, "h").sortWithinPartitions("h", "did", "tie", "s").mapInArrow(_buckets(most), SPANS)
    # a bucket by the hash of a whole string holds that string; were it overfull again, its rows would be no spans, so the job fails
    split = F.raise_error(F.lit("a bucket of equal strings holds too many different ones")).cast("int")
    more = more.select("did", "tie", "start", F.when(F.col("rest").isNull(), F.col("stop")).otherwise(split).alias("stop"))
    listed = spans.where("rest is null").select("did", "tie", "start", "stop").unionByName(more).groupBy("did", "tie").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    cut = stages.write(some.dropDuplicates(["did", "tie"]).select("did", "tie", "text").join(listed, ["did", "tie"]).mapInArrow(_cut, CUT))
    whole = copies.select("did", "tie", F.lit(True).alias("whole"))
    out = found.select("doc_id", did, "tie", "n_bytes", "sha").join(cut, ["did", "tie"], "left").join(whole, ["did", "tie"], "left")
    gone = F.col("whole").isNotNull()
    return out.select(
        "doc_id", "tie", "n_bytes", "sha",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )


def dedup_strings(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with the repeated bytes gone from text and n_chars following it. Bytes of a letter that was cut through go with it."""
    found = repeats(docs).where("kept is not null").select(F.coalesce("doc_id", F.lit(LAST)).alias("did"), "tie", "kept").dropDuplicates(["did", "tie"])
    left = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("did"), F.xxhash64(whole_text()).alias("tie"), packed(docs))
    valid = F.try_validate_utf8(F.col("kept").cast("string"))
    whole = F.coalesce(valid, F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "\ufffd", ""))
    text = F.when(F.col("kept").isNull(), F.col("_row")["text"]).otherwise(whole)
    return unpacked(left.join(found, ["did", "tie"], "left"), docs.columns, {"text": text, "n_chars": F.length(text).cast("long")})
