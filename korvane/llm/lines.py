"""Line dedup: repeated runs of lines by prefix doubling over line ids, DataFrame operations only.

A line occurrence is deleted exactly if it lies in a run of consecutive lines of one document, together
at least ``min_chars`` characters long (each line counts its end), that also occurs, line for line, starting earlier:
in a smaller doc_id, or in the same document on a smaller line. Runs are judged on the input, and overlaps count.

Each line is a suffix of its document's sequence of line ids. Prefix doubling names the class of equal
prefixes of 1, 2, 4, ... lines by the first position that has it, keeping only suffixes whose prefix is
repeated; sorted by these names the suffixes are the suffix array down to the depth at which the threshold is decided
(a run of ``min_chars`` lines at most). The longest-common-prefix interval of a run of m lines is the class of
two overlapping power-of-two prefixes; all its members but the first are later copies, and overlapping copies join
to maximal runs. Exact copies of whole documents are settled first, by digest, and take no part.

Defined results: null texts stay null and count as empty; texts of under ``min_chars`` characters are never
emptied; rows that agree in doc_id and text are one document and are treated alike; of texts with the same doc_id, and
without one (these come last), the order is by digest; an empty table gives no rows; all other columns pass
unchanged but n_chars, which follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korvane.llm.common import Stages, packed, partitions, unpacked


def _keyed(docs: DataFrame) -> DataFrame:
    """key, doc_id, text and the whole row."""
    text = F.coalesce("text", F.lit(""))
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    key = F.unhex(F.md5(F.concat(ident, F.lit("|"), text).cast("binary")))
    return docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), packed(docs))


def _places(firsts: DataFrame, stages: Stages) -> DataFrame:
    """key -> place of the document's first line in the order of doc_id: range partitions, sorted each, after the totals of those before."""
    n = partitions(firsts.sparkSession)
    order = [F.col("doc_id").asc_nulls_last(), F.col("key").asc()]
    ranged = stages.write(firsts.repartitionByRange(n, *order).withColumn("pid", F.spark_partition_id()))
    totals, at, before = ranged.groupBy("pid").agg(F.sum("n").alias("count")).orderBy("pid").collect(), 0, []  # a row a partition
    for r in totals:
        before.append((r["pid"], at))
        at += r["count"]
    base = F.broadcast(firsts.sparkSession.createDataFrame(before, "pid int, base long"))
    own = F.coalesce(F.sum("n").over(Window.partitionBy("pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("own", own).join(base, "pid").select("key", (F.col("base") + F.col("own")).alias("place"))


def _least_runs(lines: DataFrame, min_chars: int) -> DataFrame:
    """(place, line, m): the shortest runs that hold ``min_chars`` characters, from each line on and up to each line.

    Every longer run is a union of these, so they decide which lines go.
    """
    so_far = Window.partitionBy("place").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w = lines.withColumn("end", F.sum("chars").over(so_far)).withColumn("start", F.col("end") - F.col("chars"))

    def nearest(mark: str, wanted, up: bool) -> DataFrame:  # the line whose mark is next to what another line asks for
        marks = F.array(F.struct(F.col(mark).alias("value"), F.lit(0).alias("asks"), "line"), F.struct(wanted.alias("value"), F.lit(1).alias("asks"), "line"))
        order = [F.desc("value"), "asks"] if up else ["value", "asks"]
        seen = Window.partitionBy("place").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        own = F.when(F.col("asks") == 0, F.col("line"))
        found = w.select("place", F.explode(marks).alias("x")).select("place", "x.*").withColumn("found", (F.min(own) if up else F.max(own)).over(seen))
        return found.where("asks = 1 and found is not null")

    onward = nearest("end", F.col("start") + min_chars, True).select("place", "line", (F.col("found") - F.col("line") + 1).alias("m"))
    upto = nearest("start", F.col("end") - min_chars, False).select("place", F.col("found").alias("line"), (F.col("line") - F.col("found") + 1).alias("m"))
    return onward.union(upto).distinct()


def repeated_runs(docs: DataFrame, min_chars: int, stages: Stages) -> DataFrame:
    """(key, all, runs): what goes from a document; runs are maximal, sorted, as [start, stop) in lines."""
    parted = _keyed(docs).select("key", "doc_id", "text", F.split("text", "\n", -1).alias("parts"))
    exploded = parted.select("key", "doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("whole"), F.length("text").alias("size"), F.size("parts").alias("n"), F.posexplode("parts").alias("line", "s"))
    lines = stages.write(exploded.select("key", "doc_id", "whole", "size", "n", "line", (F.length("s") + 1).cast("long").alias("chars"), F.unhex(F.md5(F.col("s").cast("binary"))).alias("id")))
    heads = lines.where("line = 0").groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("whole").alias("whole"), F.first("size").alias("size"), F.first("n").alias("n"))
    heads = stages.write(heads)
    first_of = heads.groupBy("whole").agg(F.min("doc_id").alias("f"), F.min(F.when(F.col("doc_id").isNull(), F.col("key"))).alias("k"))
    judged = heads.join(first_of, "whole").withColumn("is_first", F.when(F.col("f").isNotNull(), F.col("doc_id").eqNullSafe(F.col("f"))).otherwise(F.col("key") == F.col("k")))
    judged = stages.write(judged.select("key", "doc_id", "size", "n", "is_first"))
    copies = judged.where(~F.col("is_first") & (F.col("size") + 1 >= min_chars)).select("key")
    firsts = judged.where("is_first").select("key", "doc_id", "n")
    places = stages.write(_places(firsts, stages))
    placed = stages.write(lines.join(places, "key").select("key", "place", "line", "chars", "id"))
    stages.drop(lines)
    position = F.col("place") + F.col("line")  # lines of all documents, numbered in order
    least = stages.write(_least_runs(placed, min_chars))
    most = least.agg(F.max("m")).collect()[0][0] or 1

    names = placed.groupBy("id").agg(F.min(position).alias("c"), F.count("*").alias("n")).where("n > 1").drop("n")
    level = stages.write(placed.join(names, "id").select("place", "line", "c"))
    levels, k = level.withColumn("k", F.lit(0)), 0
    while 2 << k <= most:  # prefixes of 2 ** (k + 1) lines from two of 2 ** k
        shifted = level.select("place", (F.col("line") - (1 << k)).alias("line"), F.col("c").alias("d"))
        both = level.join(shifted, ["place", "line"])
        names = both.groupBy("c", "d").agg(F.min(position).alias("e"), F.count("*").alias("n")).where("n > 1").drop("n")
        level, k = stages.write(both.join(names, ["c", "d"]).select("place", "line", F.col("e").alias("c"))), k + 1
        levels = levels.unionByName(level.withColumn("k", F.lit(k)))

    log = F.length(F.bin("m")) - 1
    asked = least.withColumn("k", log).join(levels, ["k", "place", "line"])
    over = asked.withColumn("at", F.col("line") + F.col("m") - F.expr("shiftleft(1, k)"))
    tail = levels.select("k", "place", F.col("line").alias("at"), F.col("c").alias("d"))
    runs = stages.write(over.join(tail, ["k", "place", "at"]).select("place", "line", "m", "c", "d"))
    first = runs.groupBy("m", "c", "d").agg(F.min(position).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = runs.join(first, ["m", "c", "d"]).where(position > F.col("first")).select("place", "line", (F.col("line") + F.col("m")).alias("stop"))

    by_line = Window.partitionBy("place").orderBy("line")
    reach = F.max("stop").over(by_line.rowsBetween(Window.unboundedPreceding, -1))
    parted = later.withColumn("opens", (F.col("line") > F.coalesce(reach, F.lit(-1))).cast("int"))
    numbered = parted.withColumn("run", F.sum("opens").over(by_line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    maximal = numbered.groupBy("place", "run").agg(F.min("line").alias("start"), F.max("stop").alias("stop"))
    listed = maximal.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("runs")).join(places, "place")
    none = F.lit(None).cast(listed.schema["runs"].dataType)
    return listed.select("key", F.lit(False).alias("all"), "runs").unionByName(copies.select("key", F.lit(True).alias("all"), none.alias("runs")))


def dedup_lines(docs: DataFrame, min_chars: int = 40, report: bool = True) -> DataFrame:
    """``docs`` without later copies of repeated line runs, and, as a report, n_lines, n_removed and n_runs."""
    stages = Stages(docs.sparkSession, "lines")
    gone = stages.write(repeated_runs(docs, min_chars, stages))
    found = _keyed(docs).join(gone, "key", "left").withColumn("lines", F.split("text", "\n", -1))
    n = F.size("lines")
    # what stays lies between one run's stop and the next one's start
    stops = F.concat(F.array(F.lit(0)), F.transform("runs", lambda r: r["stop"].cast("int")))
    starts = F.concat(F.transform("runs", lambda r: r["start"].cast("int")), F.array(n))
    kept = F.flatten(F.zip_with(stops, starts, lambda a, b: F.slice("lines", a + 1, b - a)))
    every = F.coalesce("all", F.lit(False))
    text = F.when(every, F.lit("")).when(F.col("runs").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("_row")["text"])
    removed = F.when(every, n).otherwise(F.coalesce(F.aggregate("runs", F.lit(0), lambda s, r: s + (r["stop"] - r["start"]).cast("int")), F.lit(0)))
    count = F.when(every, F.lit(1)).otherwise(F.coalesce(F.size("runs"), F.lit(0)))
    told = {"n_lines": n.cast("long"), "n_removed": removed.cast("long"), "n_runs": F.greatest(count, F.lit(0)).cast("long")} if report else {}
    return unpacked(found, [*docs.columns, *told], {"text": text, "n_chars": F.length(text).cast("long"), **told})


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS s FROM d),
w AS (SELECT *, sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY line) AS stop_at, sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY line) - length(s) - 1 AS start_at FROM l),
r AS (SELECT a.doc_id, a.line, min(b.line) - a.line + 1 AS m FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.line >= a.line AND b.stop_at >= a.start_at + 40 GROUP BY a.doc_id, a.line
  UNION SELECT a.doc_id, max(b.line) AS line, a.line - max(b.line) + 1 AS m FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.line <= a.line AND b.start_at <= a.stop_at - 40 GROUP BY a.doc_id, a.line),
t AS (SELECT r.doc_id, r.line, r.m, string_agg(w.s, chr(10) ORDER BY w.line) AS run FROM r JOIN w ON w.doc_id = r.doc_id AND w.line >= r.line AND w.line < r.line + r.m GROUP BY r.doc_id, r.line, r.m),
o AS (SELECT *, row_number() OVER (PARTITION BY m, run ORDER BY doc_id, line) AS nth FROM t),
g AS (SELECT DISTINCT o.doc_id, o.line + i AS line FROM o, LATERAL (SELECT unnest(range(o.m)) AS i) WHERE nth > 1),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(g.line) AS n_removed, string_agg(l.s, chr(10) ORDER BY l.line) FILTER (WHERE g.line IS NULL) AS kept FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.line = l.line GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k"""
