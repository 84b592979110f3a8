"""Each event once: deterministic keys, and their deduplication in a stream across restarts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCORED = ("goal", "correction")


def event_key(match: Column, kind: Column, uid: Column, generation: Column, home: Column, away: Column) -> Column:
    """``match:kind:uid`` where the event has an identity of its own; a goal or correction goes by its score line.

    A score line that comes again after a correction is another event: its generation, unless it is 0, is part of the key.
    Null generations are 0, null scores and kinds are empty.
    """
    part = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    again = F.when(F.coalesce(generation, F.lit(0)) != 0, F.concat(part(generation), F.lit(":"))).otherwise("")
    line = F.when(kind.isin(*SCORED), F.concat(again, part(home), F.lit("-"), part(away))).otherwise("")
    return F.concat(part(match), F.lit(":"), part(kind), F.lit(":"), F.when(part(uid) != "", part(uid)).otherwise(line))


def emitted_once(events: DataFrame, key: str, at: str, late: str = "2 hours") -> DataFrame:
    """The first event of each key; in a stream a repeat is known for ``late`` after the event, also across restarts.

    Events without a key or a time are not events: they are left out. A batch keeps the earliest of each key.
    """
    told = events.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    if told.isStreaming:
        return told.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
    names = [c for c in told.columns if c != key]
    first = told.groupBy(key).agg(F.min(F.struct(at, *(c for c in names if c != at))).alias("_first"))
    return first.select(*(F.col(key) if c == key else F.col("_first")[c].alias(c) for c in told.columns))


def emit(events: DataFrame, key: str, at: str, path: str, checkpoint: str, late: str = "2 hours", **trigger) -> StreamingQuery:
    """Writes each event once to Parquet; the file sink's log and the state in the checkpoint make a restart safe."""
    out = emitted_once(events, key, at, late).writeStream.format("parquet").option("path", path)
    return out.option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
