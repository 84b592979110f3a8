"""Stateful operators: the sliding-window limiter, and rollups as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PER, WINDOW_S = 5, 60


def _accept(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by user in order of time; the state is at most PER accepted times."""
    user, recent = None, []
    for pdf in frames:
        out = []
        for u, t in zip(pdf["user_id"], pdf["at"], strict=True):
            if u != user:
                user, recent = u, []
            recent = [x for x in recent if x > t - WINDOW_S]
            ok = len(recent) < PER
            if ok:
                recent.append(t)
            out.append(ok)
        yield pdf[["event_id", "user_id"]].assign(accepted=out)


def limited(events: DataFrame) -> DataFrame:
    """event_id, user_id, accepted: at most PER accepted events in WINDOW_S seconds a user; refused ones don't count. Streams over sorted partitions, so a busy user is never held whole."""
    rows = events.select("event_id", "user_id", F.unix_timestamp("ts").alias("at"))
    return rows.repartition("user_id").sortWithinPartitions("user_id", "at", "event_id").mapInPandas(_accept, "event_id long, user_id long, accepted boolean")


def rollup_stream(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by event type in tumbling windows with a watermark; for streams and, unchanged, for batches."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"r08_rate_limit": lambda spark, sf_dir: limited(spark.read.parquet(f"{sf_dir}/events.parquet"))}

#: The same walk over each user's events as a recursive table; the state is the list of accepted times.
ORACLES: dict[str, str] = {
    "r08_rate_limit": f"""WITH RECURSIVE e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS i FROM events),
w AS (SELECT event_id, user_id, i, true AS accepted, [t] AS recent FROM e WHERE i = 1
  UNION ALL SELECT e.event_id, e.user_id, e.i, len(list_filter(w.recent, lambda x: x > e.t - {WINDOW_S})) < {PER},
    CASE WHEN len(list_filter(w.recent, lambda x: x > e.t - {WINDOW_S})) < {PER} THEN list_append(list_filter(w.recent, lambda x: x > e.t - {WINDOW_S}), e.t) ELSE list_filter(w.recent, lambda x: x > e.t - {WINDOW_S}) END
    FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
SELECT event_id, user_id, accepted FROM w"""
}
