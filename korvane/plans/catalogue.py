"""All queries of the library by name, with the DuckDB SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from korvane.functions import fuzzy, scalars, texts
from korvane.operators import assembly, relational
from korvane.plans import bound, dated, retrieval, screened, stored
from korvane.plans.sql import oracle, query
from korvane.streaming import limits, matches

#: Queries that :mod:`bound` builds otherwise are not taken from their text.
_TEXTS = {k: v for k, v in (relational.SQL | assembly.SQL | scalars.SQL | texts.SQL).items() if k not in bound.QUERIES}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: query(v) for k, v in _TEXTS.items()} | retrieval.QUERIES | bound.QUERIES | limits.QUERIES | fuzzy.QUERIES | matches.QUERIES | stored.QUERIES | screened.QUERIES | dated.QUERIES
ORACLES: dict[str, str] = {k: oracle(v) for k, v in _TEXTS.items()} | retrieval.ORACLES | bound.ORACLES | limits.ORACLES | stored.ORACLES | screened.ORACLES | dated.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval: keyword and vector legs, fused."""
    return retrieval.QUERIES["w05_hybrid"](spark, sf_dir)
