"""Queries as one SQL text for both engines: tables in braces, and @names where the dialects differ."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
SPARK = {"epoch": "unix_timestamp", "json": "get_json_object", "split": "split", "at": "element_at", "explode": "explode", "rx": "regexp_like", "sort": "array_sort", "list": "collect_list", "size": "size", "day": "to_date", "distinct": "array_distinct", "both": "array_intersect", "rxall": "regexp_extract_all", "join": "array_join", "range": "sequence", "has": "array_contains", "monthday": "day"} | {"filter": "filter", "map": "transform", "lx": "x ->", "g": "", "b": "\\\\b", "sha": "sha2", "bits": ", 256", "bround": "bround", "array": "array", "cat": "concat", "unaccent": "translate", "folds": ", 'àâäáãåçéèêëíìîïñóòôöõúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'"}
DUCK = {"epoch": "epoch", "json": "json_extract_string", "split": "string_split", "at": "list_extract", "explode": "unnest", "rx": "regexp_matches", "sort": "list_sort", "list": "list", "size": "len", "day": "date", "distinct": "list_distinct", "both": "list_intersect", "rxall": "regexp_extract_all", "join": "array_to_string", "range": "generate_series", "has": "list_contains", "monthday": "day"} | {"filter": "list_filter", "map": "list_transform", "lx": "lambda x:", "g": ", 'g'", "b": "\\b", "sha": "sha256", "bits": "", "bround": "round_even", "array": "list_value", "cat": "list_concat", "unaccent": "strip_accents", "folds": ""}


#: Counters that Spark gives as int and the other engine as bigint.
LONGS = {"place", "last_fiscal", "threshold", "ordinal", "amount"}


def _filtered(text: str) -> str:
    """count_if(x) as a filtered count, whose type both engines agree on."""
    while (at := text.find("count_if(")) >= 0:
        depth, end = 1, at + 9
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        text = f"{text[:at]}count(*) FILTER (WHERE {text[at + 9 : end - 1]}){text[end:]}"
    return text


def spoken(text: str, words: dict[str, str]) -> str:
    return re.sub(r"@(\w+)", lambda m: words[m[1]], _filtered(text))


def query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """The Spark form: only the tables that the text names are opened."""
    used = [t for t in TABLES if f"{{{t}}}" in text]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = spark.sql(spoken(text, SPARK), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})
        return out.select(*(out[c].cast("long").alias(c) if c in LONGS else out[c] for c in out.columns))

    return run


def oracle(text: str) -> str:
    """The DuckDB form."""
    return re.sub(r"\{(\w+)\}", r"\1", spoken(text, DUCK))
