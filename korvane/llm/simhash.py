"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints of whole texts are compared only inside buckets. With ``cut`` (64 bits, a small radius) the bits are cut into
parts, and two fingerprints within ``radius`` bits share all but ``radius`` of the parts: each choice of shared
parts is one bucket key, and no link is lost. With ``band`` (wide fingerprints, a large radius) each run of ``band``
bits is a key, and the first ``MEASURED`` words are compared.
``keep_one`` takes fingerprints over distinct shingles and these only pick candidates: at 1024 bits, bands of 16 and a radius of
62 in 256 bits, texts of many shingles with a Jaccard similarity of 0.8 differ in 39 of these on average, unrelated ones in 128, and
they share one of the 64 bands with probability 0.99. Texts linked so, directly or through others, are then compared by their
whole shingle sets, and only links of a similarity of 0.8 and more count. A bucket holds about one unrelated text for each 65,536
documents; a corpus of very many more documents wants wider bands and more words.
Inside a bucket the fingerprints lie as vertical bit planes; a plane at a time updates the distances of 64 lanes a word in
carry-save counters, and a block is abandoned once all its lanes are beyond the radius. Equal fingerprints are
one vertex. A large bucket is cut into chunks and compared chunk pair by chunk pair in many tasks. Each block returns
a spanning forest of its links, never all pairs; components are joined by alternating large-star and
small-star steps over written tables.

Defined results: null and empty texts, and texts without words, have fingerprint zero and link like any other;
one row comes back for each row, repeated rows and repeated ids included; an empty table gives no rows; rows without
doc_id get the component of their fingerprint, null if no numbered document has one; other columns are
ignored by ``near_duplicates`` and kept by ``keep_one``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from korvane.llm.common import Stages, batches, partitions, prepare, text_bytes, whole_text

#: Words of a wide fingerprint whose bits are compared; all of them give bucket keys.
MEASURED = 4
#: Rows found without links in a large block before the others without links are sought together.
LONERS = 8
#: The least Jaccard similarity of 5-word shingles that makes two texts copies, as a fraction.
SHARE, WHOLE = 4, 5
ONE, ALL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)
PRINTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.BinaryType())])
KEYS = T.StructType([T.StructField("t", T.LongType()), T.StructField("key", T.LongType()), T.StructField("fp", T.BinaryType()), T.StructField("v", T.LongType())])
SETS = T.StructType([*PRINTS.fields, T.StructField("kind", T.BinaryType())])
LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _mixed(h: np.ndarray, word: int) -> np.ndarray:
    """The hashes themselves for word 0, other functions of them for further words."""
    if not word:
        return h
    h = h + np.uint64(0x9E3779B97F4A7C15 * word & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the words have each bit, high bits first; counted in bytes, 255 rows at a time."""
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    whole = len(bits) // 255 * 255
    out = bits[whole:].sum(axis=0, dtype=np.uint8).astype(np.int64)
    return out + bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)


def _hashes(text: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """Hashes of the word shingles in order; a text of fewer words is one shingle, one without words has none."""
    ws = text.lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    n = max(1, len(ws) - shingle + 1)
    last = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts, ends = [0, *(last[: n - 1] + 1).tolist()], last[len(ws) - n :].tolist()
    joined, digest = b" ".join(ws), xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)), np.uint64, n)


def _majority(h: np.ndarray, words: int) -> bytes:
    """Bits set in over half of the hashes; 8 bytes a word, high bits first."""
    counts, step = np.zeros((words, 64), np.int64), 1 << 14
    for i in range(0, len(h), step):
        for w in range(words):
            counts[w] += _bit_counts(_mixed(h[i : i + step], w))
    return np.packbits(2 * counts > len(h)).tobytes()


def fingerprint(text: bytes, shingle: int = 3, words: int = 1, seed: int = 42) -> bytes:
    """Bits set in over half of the hashes of the word shingles, repeats included; 8 bytes a word, high bits first."""
    return _majority(_hashes(text, shingle, seed), words)


def _prints(shingle: int, words: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            fp = [fingerprint(t, shingle, words) for t in text_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.binary())], names=PRINTS.names)

    return run


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1) -> DataFrame:
    """doc_id and its fingerprint, 8 bytes a word."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(_prints(shingle, words), PRINTS)


def _numbers(column: pa.Array, words: int) -> np.ndarray:
    """Fingerprints as rows of unsigned words."""
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, words)


def _keyed(words: int, radius: int, cut: int, band: int):
    """Bucket keys of each fingerprint."""
    edge = [64 * i // cut for i in range(cut + 1)] if cut else []
    masks = [sum(((1 << edge[i + 1] - edge[i]) - 1) << edge[i] for i in c) for c in itertools.combinations(range(cut), cut - radius)] if cut else []

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            fp = _numbers(b.column(1), words)
            if band:
                bits = np.unpackbits(fp.astype(">u8").view(np.uint8).reshape(len(fp), -1), axis=1)
                bits = bits[:, : bits.shape[1] // band * band].reshape(len(fp), -1, band)
                keys = list((bits.astype(np.int64) << np.arange(band)).sum(axis=2).T)
            else:
                keys = [(fp[:, 0] & np.uint64(m)).view(np.int64) for m in masks]
            shown = pa.array([x[: 8 * MEASURED] for x in b.column(1).to_pylist()], pa.binary())
            for t, key in enumerate(keys):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), t)), pa.array(np.ascontiguousarray(key)), shown, b.column(0)], names=KEYS.names)

    return run


def planes(fp: np.ndarray) -> np.ndarray:
    """Vertical bit planes of rows of words: bit i of lane word j of plane p is bit p of fingerprint 64 * j + i."""
    bits = np.zeros((-(-len(fp) // 64) * 64, 64 * fp.shape[1]), np.uint8)
    bits[: len(fp)] = np.unpackbits(np.ascontiguousarray(fp).astype("<u8").view(np.uint8).reshape(len(fp), -1), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def near(fp: np.ndarray, lanes: np.ndarray, live: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint (row) the lanes within the radius, as bits. ``lanes``: planes x (rows or 1) x lane words; ``live``: lanes to look at.

    Carry-save counters: ``c[j]`` holds bit j of each lane's distance; ``far`` marks lanes past the radius. Rows
    with no lane left are dropped every eight planes.
    """
    need = radius.bit_length()
    shape = (len(fp), lanes.shape[2])
    out = np.zeros(shape, np.uint64)
    rows = np.arange(shape[0])
    far = np.broadcast_to(~live, shape).copy()
    c = [np.zeros(shape, np.uint64) for _ in range(need)]
    shared = lanes.shape[1] == 1
    for p in range(lanes.shape[0]):
        plane = lanes[p] if shared else lanes[p][rows]
        carry = plane ^ (((fp[rows, p // 64] >> np.uint64(p % 64)) & ONE) * ALL)[:, None]
        for j in range(need):
            c[j], carry = c[j] ^ carry, c[j] & carry
        far |= carry
        if p % 8 == 7:
            far |= _above(c, radius)
            alive = (~far).any(axis=1)
            if not alive.all():
                if not alive.any():
                    return out
                rows, far, c = rows[alive], far[alive], [x[alive] for x in c]
    out[rows] = ~far
    return out


def _above(c: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is over the radius."""
    over, equal = np.zeros_like(c[0]), np.full_like(c[0], ALL)
    for j in range(len(c) - 1, -1, -1):
        if radius >> j & 1:
            equal &= c[j]
        else:
            over |= equal & c[j]
            equal &= ~c[j]
    return over


def forest(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of one large block, as index pairs, by breadth over rows of lane bits."""
    n = len(fp)
    lanes = planes(fp)[:, None, :]
    words = lanes.shape[2]
    left = np.zeros(words * 64, np.uint8)
    left[:n] = 1
    left = np.packbits(left, bitorder="little").view("<u8")
    a, b, alone = [], [], 0
    while left.any():
        if alone == LONERS:  # mostly unrelated rows: those without any link go at once
            index = np.flatnonzero(np.unpackbits(left.view(np.uint8), bitorder="little"))
            for i in range(0, len(index), 256):
                rows = index[i : i + 256]
                hit = near(fp[rows], lanes, left[None, :], radius)
                lone = rows[np.bitwise_count(hit).sum(axis=1) == 1]
                np.bitwise_and.at(left, lone // 64, ~(ONE << (lone % 64).astype(np.uint64)))
            alone += 1
            continue
        w = int(np.flatnonzero(left)[0])
        root = 64 * w + (int(left[w]) & -int(left[w])).bit_length() - 1
        left[w] &= ~(ONE << np.uint64(root % 64))
        front, before = np.array([root]), len(a)
        while len(front):
            nxt = np.zeros(words, np.uint64)
            for i in range(0, len(front), 256):
                nxt |= np.bitwise_or.reduce(near(fp[front[i : i + 256]], lanes, left[None, :], radius), axis=0)
            left &= ~nxt
            front = np.flatnonzero(np.unpackbits(nxt.view(np.uint8), bitorder="little"))
            a += [root] * len(front)
            b += front.tolist()
        alone += alone < LONERS and len(a) == before
    return np.array(a, np.int64), np.array(b, np.int64)


def small_blocks(fp: np.ndarray, start: np.ndarray, size: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of many blocks of 2 to 64 fingerprints at once: blocks are packed into words of lanes, a row looks at its own word."""
    word, lane, used, w = np.empty(len(size), np.int64), np.empty(len(size), np.int64), 0, 0
    for i, s in enumerate(size.tolist()):
        if used + s > 64:
            w, used = w + 1, 0
        word[i], lane[i] = w, used
        used += s
    block = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(block)) - np.repeat(np.cumsum(size) - size, size)
    index = start[block] + at
    place = word[block] * 64 + lane[block] + at
    laid = np.zeros(((w + 1) * 64, fp.shape[1]), np.uint64)
    laid[place] = fp[index]
    lanes = planes(laid)[:, word[block]][:, :, None]
    before = ((ONE << at.astype(np.uint64)) - ONE) << lane[block].astype(np.uint64)  # earlier lanes of the same block
    hit = near(fp[index], lanes, before[:, None], radius)[:, 0]
    bits = np.unpackbits(np.ascontiguousarray(hit).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, bit = np.nonzero(bits)
    return index[row], start[block[row]] + bit - lane[block[row]]


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Drops links that close a cycle."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    keep = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        p, q = root(x), root(y)
        if p != q:
            up[p] = q
            keep.append(i)
    return a[keep], b[keep]


def _compare(radius: int, words: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rows = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            if not held:
                return
            k1, k2, fp, v = (np.concatenate([h[i] for h in held]) for i in range(4))
            new = np.flatnonzero(np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]))
            end = len(k1) if last else int(new[-1])
            held = [] if end == len(k1) else [(k1[end:], k2[end:], fp[end:], v[end:])]
            rows = len(k1) - end
            start = new if last else new[:-1]
            size = np.diff(np.append(start, end))
            few = (size > 1) & (size <= 64)
            pairs = [small_blocks(fp, start[few], size[few], radius)] if few.any() else []
            for s, n in zip(start[size > 64].tolist(), size[size > 64].tolist(), strict=True):
                a, b = forest(fp[s : s + n], radius)
                pairs.append((a + s, b + s))
            if pairs:
                a, b = (v[np.concatenate([p[i] for p in pairs])] for i in range(2))
                a, b = _spanning(a, b)
                for i in range(0, len(a), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 50_000]), pa.array(b[i : i + 50_000])], names=LINKS.names)

        for b in batches(it):
            k1, k2, v = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
            held.append((k1, k2, _numbers(b.column(2), words), v))
            rows += b.num_rows
            if rows >= 30_000:
                yield from flush(False)
        yield from flush(True)

    return run


def links(vertices: DataFrame, radius: int = 2, words: int = 1, cut: int = 4, band: int = 0, chunk: int = 8192) -> DataFrame:
    """Spanning links (a, b) between vertices (v, fp) with distinct fp. ``cut`` parts, more for larger corpora; or keys of ``band`` bits."""
    if not band and not (0 < radius < cut and words == 1):
        raise ValueError("cut must be over the radius, the radius over 0, and the fingerprint one word")
    rows = vertices.select("v", "fp").mapInArrow(_keyed(words, radius, 0 if band else cut, band), KEYS)
    large = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > chunk)
    # a bucket of c > 1 chunks: member chunk i takes part in the pairs (i, j), one task's block each
    inside = rows.join(large, ["t", "key"], "left")
    chunks = F.ceil(F.coalesce("n", F.lit(1)) / chunk).cast("int")
    own = F.pmod(F.xxhash64("v"), chunks).cast("int")
    pairs = F.when(chunks == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0), chunks - 1), lambda j: F.least(own, j).cast("long") * (1 << 31) + F.greatest(own, j))
    )
    blocks = inside.select("t", "key", F.explode(pairs).alias("pair"), "fp", "v")
    blocks = blocks.select(F.xxhash64("t", "key", "pair").alias("k1"), F.xxhash64("key", "pair", "t").alias("k2"), "fp", "v")
    dealt = blocks.repartition(partitions(vertices.sparkSession), "k1", "k2").sortWithinPartitions("k1", "k2")
    return dealt.mapInArrow(_compare(radius, min(words, MEASURED)), LINKS)


def components(edges: DataFrame, stages: Stages) -> DataFrame:
    """(v, component): the least vertex reachable, for each vertex that has an edge. Large-star and small-star in turn until nothing moves."""
    e = stages.write(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u < v").distinct())
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        down = large.select(F.col("v").alias("x"), F.col("u").alias("y"))
        low = down.groupBy("x").agg(F.min("y").alias("m"))
        small = down.join(low, "x").select(F.col("m").alias("u"), F.col("y").alias("v")).union(low.select(F.col("m").alias("u"), F.col("x").alias("v"))).where("u < v").distinct()
        nxt = stages.write(small)
        # done when each vertex hangs from one root and no root hangs from another
        check = nxt.groupBy("v").agg(F.count("*").alias("n"))
        open_ = check.where("n > 1").limit(1).count() or nxt.select("u").distinct().join(nxt.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count()
        stages.drop(e)
        e = nxt
        if not open_:
            return e.select("v", F.col("u").alias("component"))


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3, words: int = 1, cut: int = 4, band: int = 0, chunk: int = 8192) -> DataFrame:
    """doc_id, fp and component_id: the smallest doc_id reachable over fingerprints ``radius`` bits apart or less (null where none of them has a doc_id)."""
    spark = prepare(docs.sparkSession)
    stages = Stages(spark, "simhash")
    prints = stages.write(fingerprints(docs, shingle, words))
    # fingerprints are linked under numbers of their own: those of rows without doc_id join others too
    vertices = stages.write(prints.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("v", F.monotonically_increasing_id()))
    found = components(links(vertices, radius, words, cut, band, chunk), stages)
    named = vertices.join(found, "v", "left").select("fp", "least", F.coalesce("component", "v").alias("c"))
    names = named.groupBy("c").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(names, "c").select("fp", "component_id"), "fp", "left").select("doc_id", "fp", "component_id")


def _set_prints(shingle: int, words: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            sets = [np.unique(_hashes(t, shingle)) for t in text_bytes(b.column(1))]
            fp, kind = [_majority(h, words) for h in sets], [xxhash.xxh128_digest(h.tobytes()) for h in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.binary()), pa.array(kind, pa.binary())], names=SETS.names)

    return run


def agreeing(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """A spanning forest, as index pairs, of the sets whose Jaccard similarity is SHARE / WHOLE or more; exact."""
    size = np.array([len(x) for x in sets])
    kinds, flat = np.unique(np.concatenate(sets), return_inverse=True)
    edge = np.append(0, np.cumsum(size))
    own = [flat[edge[i] : edge[i + 1]] for i in range(len(sets))]
    mark, left = np.zeros(len(kinds), np.uint8), np.arange(len(sets))
    a, b = [], []
    while len(left):
        root = int(left[0])
        left, flat, stack = left[1:], flat[size[root] :], [root]
        while stack and len(left):
            x = stack.pop()
            mark[own[x]] = 1
            shared = np.diff(np.append(0, np.cumsum(mark[flat], dtype=np.int64))[np.append(0, np.cumsum(size[left]))])
            mark[own[x]] = 0
            hit = (SHARE + WHOLE) * shared >= SHARE * (size[left] + size[x])
            if hit.any():
                new = left[hit].tolist()
                a, b, stack = a + [root] * len(new), b + new, stack + new
                left, flat = left[~hit], flat[np.repeat(~hit, size[left])]
    return a, b


def _confirm(shingle: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, v, sets = None, [], []

        def settled() -> Iterator[pa.RecordBatch]:
            if len(v) > 1:
                a, b = agreeing(sets)
                yield pa.RecordBatch.from_arrays([pa.array([v[i] for i in x], pa.int64()) for x in (a, b)], names=LINKS.names)

        for batch in batches(it):
            for c, p, x, t in zip(*(batch.column(i).to_pylist() for i in range(3)), text_bytes(batch.column(3)), strict=True):
                if (c, p) != group:
                    yield from settled()
                    group, v, sets = (c, p), [], []
                v.append(x)
                sets.append(np.unique(_hashes(t, shingle)))
        yield from settled()

    return run


def confirmed(docs: DataFrame, found: DataFrame, stages: Stages, shingle: int, chunk: int = 1024, size: int = 1 << 24) -> DataFrame:
    """Spanning links (a, b) of exact similarity among the texts of each candidate component; a large one is compared chunk pair by chunk pair."""
    members = found.select("v", "component").union(found.select(F.col("component").alias("v"), "component").distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("v"), whole_text().alias("text"))
    held = stages.write(texts.join(members, "v").select("component", "v", "text"))
    sizes = held.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / chunk), F.ceil(F.sum(F.octet_length("text")) / size), F.lit(1)).cast("int").alias("chunks"))
    own, chunks = F.pmod(F.xxhash64("v"), F.col("chunks")).cast("int"), F.col("chunks")
    pairs = F.when(chunks == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0), chunks - 1), lambda j: F.least(own, j).cast("long") * (1 << 31) + F.greatest(own, j))
    )
    blocks = held.join(sizes, "component").select("component", F.explode(pairs).alias("pair"), "v", "text")
    dealt = blocks.repartition(partitions(docs.sparkSession), "component", "pair").sortWithinPartitions("component", "pair")
    return dealt.mapInArrow(_confirm(shingle), LINKS)


def copies(docs: DataFrame, shingle: int = 5, words: int = 16, radius: int = 62, band: int = 16) -> DataFrame:
    """doc_id and component_id, the smallest doc_id reachable over texts whose shingle sets have a Jaccard similarity of SHARE / WHOLE or more."""
    spark = prepare(docs.sparkSession)
    stages = Stages(spark, "copies")
    prints = stages.write(docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(_set_prints(shingle, words), SETS))
    vertices = stages.write(prints.groupBy("kind").agg(F.min("doc_id").alias("v"), F.min("fp").alias("fp")).where("v is not null"))
    likely = components(links(vertices, radius, words, 0, band), stages)
    found = components(confirmed(docs, likely, stages, shingle), stages)
    named = vertices.join(found, "v", "left").select("kind", F.coalesce("component", "v").alias("component_id"))
    return prints.join(named, "kind", "left").select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of similar texts, that of the smallest doc_id: at least 0.8 of all their 5-word shingles shared.

    Rows that repeat a doc_id stay or go together; rows without doc_id, and those alone in their group, stay.
    """
    found = copies(docs.where("doc_id is not null"))
    gone = found.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
