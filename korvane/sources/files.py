"""File sources and sinks: CSV with bad rows left out, checked JSON lines, leaderboards, feeds and sitemaps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BAD = "_unread"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a CSV with a header; a row that does not fit the schema is left out."""
    rows = spark.read.schema(f"{schema}, {_BAD} string").option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BAD).csv(path)
    return rows.where(F.col(_BAD).isNull()).drop(_BAD)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; one that does not parse stops the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_leaderboard(rows: DataFrame, path: str, key: str, criterion: str, points: str, criteria: list[str]) -> None:
    """CSV of mean points by key: a column for each criterion, named beforehand so that no pass is spent on finding them."""
    rows.groupBy(key).pivot(criterion, criteria).agg(F.round(F.avg(points), 3)).write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines, nulls included."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_export(first: DataFrame, second: DataFrame, key: str, path: str) -> None:
    """JSON lines of two sources, one record a key: the first source's where both have one."""
    more = second.join(first.select(key), key, "left_anti").select(*first.columns)
    write_json(first.unionByName(more), path)


#: Addresses of one sitemap file, by its public format.
URLS = 50_000
NAMESPACE = "http://www.sitemaps.org/schemas/sitemap/0.9"


def _site_map(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A partition as one document: its root is opened before the first address and closed after the last."""
    opened = False
    for pdf in frames:
        if len(pdf):
            lines = list(pdf["value"]) if opened else [f'<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="{NAMESPACE}">', *pdf["value"]]
            opened = True
            yield pd.DataFrame({"value": lines})
    if opened:
        yield pd.DataFrame({"value": ["</urlset>"]})


def write_sitemap(pages: DataFrame, path: str, url: str = "url") -> None:
    """Sitemap files of :data:`URLS` addresses at most, each a document of its own; markup characters are escaped, null addresses left out and repeated ones written once."""
    safe = F.replace(F.replace(F.col(url), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    rows = pages.where(F.col(url).isNotNull()).select(F.concat(F.lit("<url><loc>"), safe, F.lit("</loc></url>")).alias("value")).distinct()
    files = rows.count() * 5 // (4 * URLS) + 1  # a fifth to spare, as hashing deals unevenly
    rows.repartition(files, "value").mapInPandas(_site_map, "value string").write.mode("overwrite").text(path)


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """loc: the addresses of a sitemap's text."""
    loc = F.explode(F.expr("regexp_extract_all(value, '<loc>([^<]*)</loc>', 1)"))
    found = spark.read.text(path).select(loc.alias("loc"))
    return found.select(F.replace(F.replace("loc", F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&")).alias("loc"))
