"""Iterative operators over links: components, leak-free splits, greedy keep-first clusters, bounded crawls.

Every round works on whole tables; a checkpoint in the shared folder cuts the lineage after each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korvane.operators.lineage import cut
from korvane.operators.order import places
from korvane.operators.retrieval import _prepared, _scores, _swept


def components(edges: DataFrame) -> DataFrame:
    """(v, component): the least vertex reachable from each vertex of the edges (a, b), loops included.

    Labels fall to the least of the neighbours', then to their label's own label, so paths halve; rounds end when nothing moves.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a is not null and b is not null").distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("component")).withColumnRenamed("a", "v"))
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "component"), "b").groupBy(F.col("a").alias("v")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "v", "left").select("v", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        jump = lower.select(F.col("v").alias("component"), F.col("component").alias("further"))
        new = cut(lower.join(jump, "component", "left").select("v", F.least("component", "further").alias("component"), "was"))
        labels = new.drop("was")
        if not new.where("component < was").limit(1).count():
            return labels


def similar_pairs(vectors: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs of vectors, a < b, with a cosine of ``least`` or more, exactly."""
    v, q = _prepared(vectors, vectors.withColumnRenamed("vec_id", "item_id"))

    def fold(b: pa.Table, y: np.ndarray):
        items = b["item_id"].to_numpy()

        def pairs(a: np.ndarray, b: np.ndarray) -> pa.Table:
            return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        def step(ids: np.ndarray, x: np.ndarray) -> pa.Table:
            i, j = np.nonzero((_scores("cosine", x, y) >= least) & (items[:, None] < ids[None, :]))
            return pairs(items[i], ids[j])

        return step, lambda: pairs(items[:0], items[:0])

    return _swept(v, q, fold, "a long, b long")


def keep_first(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(v, kept): greedily in order of v, a node stays unless it is paired (a < b) with an earlier one that stays.

    Decided in rounds that give the sequential answer: a node stays once no earlier partner is open or kept, and goes as
    soon as one is kept.
    """
    links = cut(pairs.select("a", "b").where("a < b").distinct())
    state = cut(nodes.select("v").distinct().withColumn("kept", F.lit(None).cast("boolean")))
    while True:
        earlier = links.join(state.select(F.col("v").alias("a"), F.col("kept").alias("of_a")), "a")
        told = earlier.groupBy(F.col("b").alias("v")).agg(F.max(F.coalesce("of_a", F.lit(False))).alias("blocked"), F.max(F.col("of_a").isNull()).alias("waits"))
        verdict = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("blocked"), False).when(F.coalesce("waits", F.lit(False)), None).otherwise(True)
        state = cut(state.join(told, "v", "left").select("v", verdict.alias("kept")))
        if not state.where("kept is null").limit(1).count():
            return state


def disjoint_split(examples: DataFrame, links: DataFrame, holdout: Column) -> DataFrame:
    """(id, component, part): examples (id, stratum) into train and test without a component of ``links`` (a, b) on both sides.

    ``holdout`` says of a component whether it would go to test; the least component of each stratum always trains, so
    no stratum is tested unseen.
    """
    found = components(links.union(examples.select(F.col("id").alias("a"), F.col("id").alias("b")))).withColumnRenamed("v", "id")
    placed = examples.select("id", "stratum").join(found, "id")
    needed = placed.groupBy("stratum").agg(F.min("component").alias("component")).select("component").distinct().withColumn("needed", F.lit(True))
    part = F.when(F.col("needed").isNull() & holdout, "test").otherwise("train")
    return placed.join(needed, "component", "left").select("id", "component", part.alias("part"))


def crawl(links: DataFrame, seeds: DataFrame, depth: int, budget: int, scope: str = "") -> DataFrame:
    """(url, depth): pages reached from the seeds (url) over links (src, dst), breadth first.

    At most ``budget`` pages are visited, those of smaller depth and then of smaller address first; addresses out of the
    ``scope`` prefix are never entered.
    """
    ways = cut(links.select("src", "dst").where(F.col("dst").startswith(scope)).distinct())

    def first(reached: DataFrame, left: int, level: int) -> tuple[DataFrame, int]:
        reached = cut(reached)
        n = reached.count()
        held = reached if n <= left else places(reached, [F.col("url")]).where(F.col("place") <= left).drop("place")
        return held.withColumn("depth", F.lit(level)), min(n, left)

    front, seen = first(seeds.select("url").where(F.col("url").startswith(scope)).distinct(), budget, 0)
    visited = front = cut(front)
    for level in range(1, depth + 1):
        reached = front.join(ways, front["url"] == ways["src"]).select(F.col("dst").alias("url")).distinct().join(visited, "url", "left_anti")
        front, new = first(reached, budget - seen, level)
        if not new:
            break
        front = cut(front)
        seen, visited = seen + new, cut(visited.unionByName(front))
    return visited
