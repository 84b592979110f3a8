"""Markdown documents as rows: questions with answers, sections under their headings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """file and the whole text of each file."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("text"))


def faq(docs: DataFrame, key: str = "file") -> DataFrame:
    """key, section, n, question, answer of ``Q: ...`` lines followed by ``**A:** ...``, under their second-level heading."""
    parts = docs.select(key, F.posexplode(F.split(F.concat(F.lit("\n"), "text"), "\n## ")).alias("s", "part"))
    title = F.when(F.col("s") > 0, F.trim(F.regexp_extract("part", "^([^\n]*)", 1)))
    pair = F.regexp_extract_all("part", F.lit("(?s)(Q:[^\n]*\n[*][*]A:[*][*].*?)(?=\nQ:|$)"), F.lit(1))
    pairs = parts.select(key, "s", title.alias("section"), F.posexplode(pair).alias("n", "qa"))
    return pairs.select(key, "section", "n", F.trim(F.regexp_extract("qa", "^Q:([^\n]*)", 1)).alias("question"), F.regexp_replace("qa", "(?s)^Q:[^\n]*\n[*][*]A:[*][*]\\s*|\\s+$", "").alias("answer"))


def sections(docs: DataFrame, key: str = "file") -> DataFrame:
    """key, n, path, body: the text under each heading, with the path of headings above it (three levels)."""
    lines = docs.select(key, F.posexplode(F.split("text", "\n")).alias("line", "s"))
    level = F.length(F.regexp_extract("s", "^(#{1,3}) ", 1))
    told = lines.withColumn("level", level).withColumn("title", F.trim(F.regexp_replace("s", "^#{1,3} ", "")))
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for i in (1, 2, 3):  # the last heading of a level that no higher one has closed
        told = told.withColumn(f"h{i}", F.last(F.when(F.col("level") == i, F.struct("line", "title")), ignorenulls=True).over(w))
    told = told.withColumn("n", F.sum(F.when(F.col("level") > 0, 1).otherwise(0)).over(w))
    line = lambda i: F.coalesce(F.col(f"h{i}.line"), F.lit(-1))
    second = F.when(line(2) > line(1), F.col("h2.title"))
    third = F.when(line(3) > F.greatest(line(1), line(2)), F.col("h3.title"))
    path = F.concat_ws(" > ", F.col("h1.title"), second, third)
    body = told.where("level = 0").select(key, "n", path.alias("path"), F.struct("line", "s").alias("row"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("row")), lambda r: r["s"]), "\n")
    return body.groupBy(key, "n", "path").agg(F.regexp_replace(joined, "^\\s+|\\s+$", "").alias("body")).where("body <> ''")
