"""WARC fixity audit by Merkle trees.

Pages become WARC records in one ordered byte sequence; a record's offset is the sum of the lengths before it. Two
replicas, each with its own lengths and so its own offsets, are aligned by record key: :func:`paired` gives every
record that either has one place. Leaves hash a record's place, length and digest; a node hashes the hashes and the
byte range of ``fanout`` consecutive nodes below it. Ranges are counted from a node's own start, so a longer record
does not disturb the nodes behind it. Replicas are compared at the root; only children of mismatching nodes are read,
level by level, down to the records that differ. All of it is DataFrame operations; a level is a written table,
1 / ``fanout`` of the one below.

Defined results: null urls and pages count as empty; records with a null key come last in the order; of repeated keys
the nth of one replica meets the nth of the other, in the order of their digests; a record that a replica lacks is a
leaf without hash and takes no bytes; an empty table gives no rows and equal roots; other columns are passed on, and
only those named like the report's own (place, offset, offset_b, kind) give way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korvane.llm.common import Stages, packed, partitions


def record(url: Column, html: Column) -> Column:
    """The bytes of a resource record, header and block."""
    u, block = F.coalesce(url, F.lit("")), F.coalesce(html, F.lit(""))
    size = F.octet_length(block).cast("string")
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), u, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    return F.concat(head, block, F.lit("\r\n\r\n")).cast("binary")


def lay_out(records: DataFrame, stages: Stages, order: list[Column], lengths: dict[str, Column]) -> DataFrame:
    """_row, place and, for each of ``lengths``, the sum of it before the record: ranges of the order, sorted each, after the totals of the ranges before."""
    spark, names = records.sparkSession, list(lengths)
    keyed = records.select(packed(records), *(c.alias(f"l{i}") for i, c in enumerate(lengths.values())), F.struct(*(F.struct(c.isNull().alias("none"), c.alias("value")) for c in order)).alias("o"))
    ranged = stages.write(keyed.repartitionByRange(partitions(spark), "o").withColumn("pid", F.spark_partition_id()))
    sums = [F.count("*").alias("n"), *(F.sum(f"l{i}").alias(f"s{i}") for i in range(len(names)))]
    bases, at = [], [0] * (len(names) + 1)
    for r in ranged.groupBy("pid").agg(*sums).orderBy("pid").collect():  # a row a partition
        bases.append((r["pid"], *at))
        at = [x + y for x, y in zip(at, list(r)[1:], strict=True)]
    base = F.broadcast(spark.createDataFrame(bases, ", ".join(["pid int", "b long", *(f"b{i} long" for i in range(len(names)))])))
    before = Window.partitionBy("pid").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("n", F.count("*").over(before))
    for i in range(len(names)):
        placed = placed.withColumn(f"s{i}", F.coalesce(F.sum(f"l{i}").over(before), F.lit(0)))
    own = [(F.col(f"b{i}") + F.col(f"s{i}")).alias(n) for i, n in enumerate(names)]
    return placed.join(base, "pid").select("_row", (F.col("b") + F.col("n")).alias("place"), *own)


class Tree:
    """Levels of (node, hash, size), leaves (place, length, digest) first."""

    def __init__(self, leaves: DataFrame, stages: Stages, fanout: int = 16):
        own = F.sha2(F.concat_ws("|", F.col("place"), F.col("length"), F.coalesce("digest", F.lit("-"))), 256)
        self.fanout, self.levels = fanout, [stages.write(leaves.select(F.col("place").alias("node"), own.alias("hash"), F.col("length").alias("size")))]
        n = self.levels[0].count()
        while n > 1:
            children = F.array_sort(F.collect_list(F.struct("node", "hash")))  # fanout at most
            joined = F.array_join(F.transform(children, lambda c: c["hash"]), "")
            above = F.floor(F.col("node") / fanout).cast("long").alias("parent")
            grouped = self.levels[-1].groupBy(above).agg(F.sha2(F.concat_ws("|", joined, F.sum("size")), 256).alias("hash"), F.sum("size").alias("size"))
            self.levels.append(stages.write(grouped.withColumnRenamed("parent", "node")))
            n = -(-n // fanout)

    def root(self) -> str:
        row = self.levels[-1].collect()
        return row[0]["hash"] if row else ""


def mismatches(a: Tree, b: Tree, stages: Stages) -> DataFrame:
    """Leaves (node) that differ between two trees of one layout, found from the root down."""
    spark = a.levels[0].sparkSession
    nothing = spark.createDataFrame([], "node long")
    if a.root() == b.root():
        return nothing
    bad = None
    for x, y in zip(reversed(a.levels), reversed(b.levels), strict=True):
        if bad is not None:
            x, y = (t.withColumn("parent", F.floor(F.col("node") / a.fanout).cast("long")).join(bad, F.col("parent") == F.col("up"), "left_semi").drop("parent") for t in (x, y))
        both = x.select("node", "hash").join(y.select("node", F.col("hash").alias("other")), "node", "full_outer")
        found = stages.write(both.where(~F.col("hash").eqNullSafe(F.col("other"))).select("node"))
        bad = found.withColumnRenamed("node", "up")
    return bad.withColumnRenamed("up", "node")


def paired(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """key, length, length_b, a, b: the records of two replicas (key, length, digest), one row for each that either holds."""

    def numbered(t: DataFrame, digest: str, length: str) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy(*key).orderBy("digest"))
        return t.select(*key, nth.alias("nth"), F.col("digest").alias(digest), F.col("length").alias(length))

    x, y = numbered(a, "a", "length").alias("x"), numbered(b, "b", "length_b").alias("y")
    same = F.lit(True)
    for c in [*key, "nth"]:
        same &= F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    both = x.join(y, same, "full_outer")
    return both.select(*(F.coalesce(f"x.{c}", f"y.{c}").alias(c) for c in key), F.coalesce("x.length", F.lit(0)).alias("length"), F.coalesce("y.length_b", F.lit(0)).alias("length_b"), "a", "b")


def audit(records: DataFrame, order: list[Column], fanout: int = 16) -> DataFrame:
    """Records (all columns, with place, offset, offset_b and kind) whose digests ``a`` and ``b`` in two replicas differ; kind is lost, added or damaged, seen from ``a``.

    ``length`` is a record's length in ``a``, ``length_b``, where there is such a column, its length in ``b``. ``order``
    holds columns in ascending order, nulls last.
    """
    stages = Stages(records.sparkSession, "warc")
    other = F.col("length_b") if "length_b" in records.columns else F.when(F.col("b").isNull(), 0).otherwise(F.col("length"))
    placed = stages.write(lay_out(records, stages, order, {"offset": F.col("length").cast("long"), "offset_b": other.cast("long")}))
    row = F.col("_row")
    lengths = (row["length"], row["length_b"] if "length_b" in records.columns else F.when(row["b"].isNull(), 0).otherwise(row["length"]))
    trees = [Tree(placed.select("place", n.cast("long").alias("length"), row[c].alias("digest")), stages, fanout) for c, n in zip(("a", "b"), lengths, strict=True)]
    bad = mismatches(*trees, stages)
    kind = F.when(row["b"].isNull(), "lost").when(row["a"].isNull(), "added").otherwise("damaged")
    told = ("place", "offset", "offset_b")
    found = placed.join(bad, placed["place"] == bad["node"], "left_semi")
    return found.select(*(row[c].alias(c) for c in records.columns if c not in (*told, "kind")), *told, kind.alias("kind"))


def replicas(pages: DataFrame) -> DataFrame:
    """page_id, length and the digests of two replicas of ``pages``; the second has records damaged and lost by rule, for exercises."""
    damaged = F.coalesce(F.col("page_id") % 97 == 13, F.lit(False))
    lost = F.coalesce(F.col("page_id") % 389 == 7, F.lit(False))
    own = record(F.col("url"), F.col("html"))
    flipped = record(F.col("url"), F.translate(F.coalesce("html", F.lit("")), "<e", "e<"))
    b = F.when(~lost, F.sha2(F.when(damaged, flipped).otherwise(own), 256))
    return pages.select("page_id", F.octet_length(own).cast("long").alias("length"), F.sha2(own, 256).alias("a"), b.alias("b"))


ORACLE = """
WITH r AS (SELECT page_id, strlen('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
    || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10))
    + strlen(coalesce(html, '')) + 4 AS length, page_id % 389 = 7 AS lost, page_id % 97 = 13 AND (contains(html, '<') OR contains(html, 'e')) AS damaged FROM pages),
p AS (SELECT page_id, CAST(sum(length) OVER (ORDER BY page_id) - length AS BIGINT) AS "offset", CAST(length AS BIGINT) AS length, lost, damaged FROM r)
SELECT page_id, "offset", length, CASE WHEN lost THEN 'lost' ELSE 'damaged' END AS kind FROM p WHERE lost OR damaged"""
