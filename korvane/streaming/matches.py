"""A state machine for each followed match: reads of its state and score become events, each once."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

COLUMNS = "match_id long, seq long, kind string, score long"
LIVE, OVER = ("in_play", "paused"), "done"


def step(held: tuple[str, int, int] | None, phase: str | None, score: int | None, updated: int) -> tuple[tuple[str, int, int] | None, list[str]]:
    """One read: (new state, kinds of events). A state is (phase, score, freshest update).

    The first read is a silent baseline; a read without phase or score changes nothing; nothing follows the end; a falling score counts
    only from a strictly fresher read.
    """
    if phase is None or score is None:
        return held, []
    if held is None:
        return (phase, score, updated), []
    before, had, fresh = held
    if before == OVER:
        return held, []
    kinds = ["kickoff"] if before == "scheduled" and phase in LIVE else []
    if score > had:
        kinds += ["goal"] * (score - had)
    elif score < had:
        if updated <= fresh:
            score = had
        else:
            kinds.append("correction")
    if phase == OVER:
        kinds.append("fulltime")
    return (phase, score, max(fresh, updated)), kinds


def _number(x: object) -> int | None:
    return None if pd.isna(x) else int(x)


def _walk(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by match in order; one match's state is held, never its rows. A read that cannot be taken gives an ``error`` row."""
    match, held = None, None
    for pdf in frames:
        out = []
        for m, seq, phase, score, updated in pdf[["match_id", "seq", "phase", "score", "updated"]].itertuples(index=False):
            if m != match:
                match, held = m, None
            try:
                held, kinds = step(held, phase, _number(score), int(updated))
            except (TypeError, ValueError):
                kinds = ["error"]
            out += [(m, seq, k, held[1] if held else None) for k in kinds]
        made = pd.DataFrame(out, columns=["match_id", "seq", "kind", "score"])
        yield made.astype({"match_id": "int64", "seq": "int64", "score": "Int64"})


def watch(reads: DataFrame) -> DataFrame:
    """match_id, seq, kind, score of all events in a batch of reads (match_id, seq, phase, score, updated)."""
    rows = reads.select("match_id", "seq", "phase", "score", "updated").where("match_id IS NOT NULL AND seq IS NOT NULL")
    return rows.repartition("match_id").sortWithinPartitions("match_id", "seq").mapInPandas(_walk, COLUMNS)


def watch_stream(reads: DataFrame, keep: int | None = None) -> DataFrame:
    """The same over a stream; states stay between batches, a finished match's for ``keep`` seconds after its last read, or for good.

    With ``keep`` the query runs batches without data, too, to see the time pass.

    A read that cannot be taken gives an ``error`` row; it stops neither its match nor the batch.
    """

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else None
        held = (held[0], int(held[1]), int(held[2])) if held else None
        out = []
        rows = pd.concat(list(frames)).sort_values("seq")
        for seq, phase, score, updated in rows[["seq", "phase", "score", "updated"]].itertuples(index=False):
            try:
                held, kinds = step(held, phase, _number(score), int(updated))
            except (TypeError, ValueError):
                kinds = ["error"]
            out += [(key[0], seq, k, held[1] if held else None) for k in kinds]
        if held:
            state.update(held)
            if keep and held[0] == OVER:
                state.setTimeoutDuration(1000 * keep)
        made = pd.DataFrame(out, columns=["match_id", "seq", "kind", "score"])
        yield made.astype({"match_id": "int64", "seq": "int64", "score": "Int64"})

    return reads.groupBy("match_id").applyInPandasWithState(follow, COLUMNS, "phase string, score long, updated long", "append", "ProcessingTimeTimeout" if keep else "NoTimeout")


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users stand for matches; a purchase is a goal, an error a read that lacks a score."""
    phase = F.when(F.col("event_type") == "view", "scheduled").when(F.col("event_type") == "signup", "paused").otherwise("in_play")
    score = F.when(F.col("event_type") != "error", F.floor(F.col("value") / 50))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return watch(rows.select(F.col("user_id").alias("match_id"), F.col("event_id").alias("seq"), phase.alias("phase"), score.alias("score"), F.unix_timestamp("ts").alias("updated")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"r02_match_watch": _query}
