"""Records between stores: checksums in key order, copies that must agree, one-to-one matches of two feeds."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator
from heapq import heapify, heappop, heapreplace
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_digests(table: DataFrame, key: str, columns: list[str], fold: int = 1000) -> DataFrame:
    """bucket, n, digest: a digest of the rows of each ``fold`` consecutive keys, in key order.

    Cells are written with a mark for null; a bucket's digest is that of its rows' digests, so nothing longer than
    ``fold`` digests is held, and equal tables have equal digests whatever their partitions.
    """
    cell = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~"))
    row = F.sha2(F.concat_ws("\u0001", *(cell(c) for c in columns)), 256)
    rows = table.select(F.floor(F.col(key) / fold).cast("long").alias("bucket"), F.col(key).alias("k"), row.alias("h"))
    inside = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), "")
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sha2(inside, 256).alias("digest"))


def copy_faults(source: DataFrame, copy: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """bucket, fault of the key ranges that a copy lacks, has too much, or holds otherwise."""
    a, b = row_digests(source, key, columns), row_digests(copy, key, columns)
    both = a.select("bucket", F.col("digest").alias("a")).join(b.select("bucket", F.col("digest").alias("b")), "bucket", "full_outer")
    fault = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "added").when(F.col("a") != F.col("b"), "different")
    return both.select("bucket", fault.alias("fault")).where("fault is not null")


#: Entries of ranked choices that a task keeps for token sets that it has met.
CHOICES = 1_000_000


class _Free:
    """The free right rows of one minute: a queue of each token set, and for a left token set the queues by shared tokens."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.queues: list[deque[int]] = []  # places in ids, rising
        self.number: dict[tuple, int] = {}
        self.holding: dict[str, list[tuple[int, int]]] = {}  # token -> (queue, times)
        self.ranked: dict[tuple, list[tuple[int, list[tuple[int, int]]]]] = {}
        self.kept = 0

    def add(self, own: int | None, tokens: tuple) -> None:
        if tokens not in self.number:
            self.number[tokens] = len(self.queues)
            for token, times in tokens:
                self.holding.setdefault(token, []).append((len(self.queues), times))
            self.queues.append(deque())
        self.queues[self.number[tokens]].append(len(self.ids))
        self.ids.append(own)

    def _choices(self, tokens: tuple) -> list[tuple[int, list[tuple[int, int]]]]:
        """(shared, heap of (first free place, queue)), most shared first."""
        if tokens not in self.ranked:
            shared: Counter[int] = Counter()
            for token, times in tokens:
                for queue, held in self.holding.get(token, ()):
                    shared[queue] += times * held
            levels: dict[int, list[tuple[int, int]]] = {}
            for queue, n in shared.items():
                if self.queues[queue]:
                    levels.setdefault(n, []).append((self.queues[queue][0], queue))
            for heap in levels.values():
                heapify(heap)
            if self.kept > CHOICES:
                self.ranked, self.kept = {}, 0
            self.kept += len(shared)
            self.ranked[tokens] = sorted(levels.items(), reverse=True)
        return self.ranked[tokens]

    def take(self, tokens: tuple) -> tuple[int | None, int] | None:
        """The best free row's id and how many tokens it shares; it is free no more."""
        for n, heap in self._choices(tokens):
            while heap:
                place, queue = heap[0]
                free = self.queues[queue]
                if free and free[0] == place:
                    return self.ids[free.popleft()], n
                if free:
                    heapreplace(heap, (free[0], queue))
                else:
                    heappop(heap)
        return None


def _consume(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by minute, right ones first, and by id; each left row takes its best right row that is still free. Only the right rows of one minute are held."""
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("minute", "asks", "id", "tokens")), strict=True))
    minute, free, out = None, _Free(), []
    for (at, asks, own), same in groupby(rows, key=lambda r: r[:3]):
        if at != minute:
            minute, free = at, _Free()
        tokens = tuple(sorted(Counter(t for r in same for t in r[3]).items()))
        if not asks:
            free.add(own, tokens)
        elif got := free.take(tokens):
            out.append((own, *got))
            if len(out) == MATCHED:
                yield pa.RecordBatch.from_pylist([dict(zip(MATCHES.names, r, strict=True)) for r in out], MATCHES)
                out = []
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip(MATCHES.names, r, strict=True)) for r in out], MATCHES)


#: Rows of matches handed on at once.
MATCHED = 8192
MATCHES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("shared", pa.int32())])


def match_feeds(left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b, shared: rows of two feeds (id, ts, tokens) of one minute, matched by most shared tokens, each right row once.

    Left rows choose in order of id; ties go to the smaller right id; rows that share no token are no match. The rows of
    one minute are the work of one task, in order; no pair is made: right rows wait in a queue of each token set, and a left
    row looks at the first of each queue, so a minute costs its rows and its pairs of distinct token sets.
    """
    kept = F.filter(F.array_distinct("tokens"), lambda t: t.isNotNull())
    side = lambda t, asks: t.select(F.date_trunc("minute", "ts").alias("minute"), F.lit(asks).alias("asks"), F.col("id").cast("long").alias("id"), kept.alias("tokens")).where(F.col("minute").isNotNull() & (F.size("tokens") > 0))
    dealt = side(right, 0).unionByName(side(left, 1)).repartition("minute").sortWithinPartitions("minute", "asks", "id")
    return dealt.mapInArrow(_consume, "a long, b long, shared int")
