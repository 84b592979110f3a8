"""Exact top-k by inner product over a vector-approximation file.

Components become integers, floor(scale * x). The file holds blocks of vectors: ids, one quantised cell a
component with the block's own marks, and, in a column of its own, the exact integers. A search scans ids, cells and
marks only: cell edges bound each score from both sides, and a vector stays while its upper bound reaches the kth
best lower bound. Exact vectors are then read in order of the upper bound: a first few for each query,
then, with the kth exact score known, what could still reach it; after that the kth result is certain.

Queries go out in blocks of fixed size, one block's scan at a time, so nothing that is broadcast or held by the driver
grows with the data. Of identical vectors in a partition only the k + 1 of smallest id enter the file: no others can be
among any query's k, ties going to the smaller id; this is exact. Repeated rows enter it once, with their number.

Defined results: null vectors, vectors with null or non-finite components or of another length than most, and rows
without vec_id take no part; each of several identical rows is a candidate and may take a rank of its own; rows with the
query's own vec_id are not its candidates; of several queries with one vec_id the least vector is asked; fewer than k
candidates give fewer rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from korvane.llm.common import Stages, batches, prepare

BLOCK, CELLS, QUERIES, FIRST = 1024, 256, 1024, 4
FILE = T.StructType([T.StructField("part", T.LongType()), T.StructField("block", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("cells", T.BinaryType()), T.StructField("marks", T.BinaryType()), T.StructField("times", T.BinaryType()), T.StructField("exact", T.BinaryType())])
BOUNDS = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("part", T.LongType()), T.StructField("block", T.LongType()), T.StructField("at", T.LongType()), T.StructField("lower", T.DoubleType()), T.StructField("upper", T.DoubleType())])
FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType()), T.StructField("times", T.LongType())])


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def valid(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id and integer components of the rows that take part."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    ok = F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) == dims) & fine
    return vectors.where(ok).select(F.col("vec_id").cast("long"), F.transform(e, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))


def _build(dims: int, copies: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(zero_copy_only=False), _matrix(b.column(1), dims), b.column(2).to_numpy(zero_copy_only=False)) for b in batches(it)]
        if not got:
            return
        ids, v, times = (np.concatenate([g[i] for g in got]) for i in range(3))
        order = np.lexsort((ids, *v.T[:8]))
        ids, v, times = ids[order], np.ascontiguousarray(v[order]), times[order]
        rows = v.view(np.dtype((np.void, v.itemsize * dims))).ravel()
        _, kind = np.unique(rows, return_inverse=True)
        order = np.lexsort((ids, kind))
        kind = kind[order]
        head = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
        rank = np.arange(len(kind)) - np.repeat(head, np.diff(np.append(head, len(kind))))
        order = np.sort(order[rank < copies])
        part = TaskContext.get().partitionId()
        for n, i in enumerate(range(0, len(order), BLOCK)):
            pick = order[i : i + BLOCK]
            x = v[pick]
            low, high = x.min(axis=0), x.max(axis=0)
            step = np.maximum(1, -(-(high - low + 1) // CELLS))
            cells = ((x - low) // step).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([n], pa.int64()), *(pa.array([a.tobytes()], pa.binary()) for a in (ids[pick], cells, np.stack([low, step]), times[pick], x))], names=FILE.names)

    return run


def build(vectors: DataFrame, dims: int, k: int, scale: int = 1024) -> DataFrame:
    """The file: blocks of ids, cells, marks (least value and step by component) and exact integers."""
    rows = valid(vectors, dims, scale)
    # repeats of a row are counted, so bounds count each row once
    return rows.groupBy("vec_id", "v").agg(F.count("*").alias("times")).mapInArrow(_build(dims, k + 1), FILE)


def _scan(queries: np.ndarray, query_ids: np.ndarray, dims: int, k: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not len(query_ids):
            return
        q = queries.T.astype(np.float64)
        plus, minus = np.maximum(q, 0), np.minimum(q, 0)
        best = np.full((0, q.shape[1]), -np.inf)
        kept: list[tuple] = []
        for b in batches(it):
            for part, block, ids, cells, marks in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                ids = np.frombuffer(ids, np.int64)
                low, step = np.frombuffer(marks, np.int64).reshape(2, dims)
                lo = (np.frombuffer(cells, np.uint8).reshape(-1, dims) * step + low).astype(np.float64)
                hi = lo + (step - 1)
                upper, lower = hi @ plus + lo @ minus, lo @ plus + hi @ minus
                own = ids[:, None] == query_ids[None, :]
                upper[own] = lower[own] = -np.inf
                best = np.concatenate([best, lower])
                if len(best) > k:
                    best = -np.partition(-best, k - 1, axis=0)[:k]
                floor = best.min(axis=0) if len(best) >= k else np.full(q.shape[1], -np.inf)
                at, of = np.nonzero((upper >= floor) & ~own)
                kept.append((of, ids[at], np.full(len(at), part), np.full(len(at), block), at, lower[at, of], upper[at, of]))
        if not kept:
            return
        of, *cols = (np.concatenate([x[i] for x in kept]) for i in range(7))
        floor = best.min(axis=0) if len(best) >= k else np.full(q.shape[1], -np.inf)
        stay = cols[-1] >= floor[of]
        out = [query_ids[of[stay]], *(c[stay] for c in cols)]
        for i in range(0, len(out[0]), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 50_000]) for c in out], names=BOUNDS.names)

    return run


def _score(dims: int):
    schema = FOUND.names

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            out: list[list] = [[], [], [], []]
            for exact, times, wanted in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                x, n = np.frombuffer(exact, np.int64).reshape(-1, dims), np.frombuffer(times, np.int64)
                for w in wanted:
                    out[0].append(w["query_id"])
                    out[1].append(w["vec_id"])
                    out[2].append(int(x[w["at"]] @ np.array(w["q"], np.int64)))
                    out[3].append(int(n[w["at"]]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=schema)

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products over all vectors."""
    spark = prepare(vectors.sparkSession)
    stages = Stages(spark, "vafile")
    sizes = vectors.where("embedding is not null").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    dims = sizes[0]["d"] if sizes else 0
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    file = stages.write(build(vectors, dims, k, scale))
    every = valid(queries, dims, scale).groupBy("vec_id").agg(F.min("v").alias("v")).withColumnRenamed("vec_id", "query_id")
    every = stages.write(every)
    blocks = every.count() // QUERIES + 1
    asked = stages.write(every.withColumn("deal", F.pmod(F.xxhash64("query_id"), F.lit(blocks))))

    def scans() -> Iterator[DataFrame]:  # a block of queries at a time goes to every task; its size doesn't grow with the table
        for i in range(blocks):
            rows = asked.where(F.col("deal") == i).collect()
            ids, q = np.array([r["query_id"] for r in rows], np.int64), np.array([r["v"] for r in rows], np.int64).reshape(-1, dims)
            yield file.select("part", "block", "ids", "cells", "marks").mapInArrow(_scan(q, ids, dims, k), BOUNDS).withColumn("deal", F.lit(i).cast("long"))

    bounds = stages.gather(scans())
    by_lower = Window.partitionBy("query_id").orderBy(F.desc("lower"))
    floor = bounds.select("query_id", "lower").withColumn("n", F.row_number().over(by_lower)).where(F.col("n") <= k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("lower")).otherwise(F.lit(float("-inf"))).alias("floor"))
    open_ = stages.write(bounds.join(floor, "query_id").where("upper >= floor").drop("lower", "floor"))
    by_upper = Window.partitionBy("query_id").orderBy(F.desc("upper"), "vec_id", "part", "block", "at")
    promising = stages.write(open_.withColumn("turn", F.row_number().over(by_upper)).where(F.col("turn") <= FIRST * k).drop("turn"))

    def exact(c: DataFrame) -> DataFrame:  # a block of vectors with a block of queries: neither side of a group grows with the table
        wanted = c.join(asked.select("query_id", F.col("v").alias("q")), "query_id").groupBy("part", "block", "deal").agg(F.collect_list(F.struct("query_id", "vec_id", "at", "q")).alias("wanted"))
        return file.join(wanted, ["part", "block"]).select("exact", "times", "wanted").mapInArrow(_score(dims), FOUND)

    first = stages.write(exact(promising))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("n", F.row_number().over(best)).where(F.col("n") == k).select("query_id", F.col("score").alias("kth"))
    rest = open_.join(kth, "query_id").where(F.col("upper") >= F.col("kth")).drop("kth")
    rest = rest.join(promising, ["query_id", "part", "block", "at"], "left_anti")
    found = first.unionByName(exact(rest)).withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("times", F.lit(k)))))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
