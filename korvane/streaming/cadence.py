"""How often each key is asked: often while something may happen, rarely else; state with timers, a key at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds between two asks of a hot and of a cool key, for which an event keeps a key hot, and after the planned beginning for which one is waited.
HOT, COOL, HOT_FOR, GRACE = 2, 25, 60, 1800
#: Seconds after which the state of a key that ended is forgotten.
KEEP = 86_400

ASKS = "match_id long, at timestamp, every_s int"
ROWS = "match_id long, at timestamp, kind string, kickoff timestamp"


@dataclass
class Pace:
    """What is known of a key; times are seconds."""

    kickoff: int = 0
    started: bool = False
    hot_until: int = 0
    done: bool = False
    due: int = 0

    def every(self, now: int) -> int:
        """A key that has not begun is hot until ``GRACE`` after its time, one that has while an event is fresh."""
        if not self.started:
            return HOT if now < self.kickoff + GRACE else COOL
        return HOT if now < self.hot_until else COOL

    def take(self, kind: str, at: int, kickoff: int | None) -> None:
        """A row: ``schedule`` plans, ``started`` begins, ``event`` heats, ``done`` ends; what comes after the end changes nothing."""
        if self.done:
            return
        if kickoff is not None:
            self.kickoff = kickoff
        if kind in ("started", "event"):
            self.started = True
        if kind == "event":
            self.hot_until = max(self.hot_until, at + HOT_FOR)
        self.done = kind == "done"


class Asker(StatefulProcessor):
    """Rows of a key set its pace; its timer gives an ask and sets the next one. The clock is the watermark."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pace = handle.getValueState("pace", "kickoff long, started boolean, hot_until long, done boolean, due long")

    def _held(self) -> Pace:
        return Pace(*self.pace.get()) if self.pace.exists() else Pace()

    def _plan(self, p: Pace, due: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        p.due = due
        self.handle.registerTimer(1000 * due)
        self.pace.update(astuple(p))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = max(0, timerValues.getCurrentWatermarkInMs() // 1000)
        p, new = self._held(), not self.pace.exists()
        for pdf in rows:
            for at, kind, kickoff in pdf.sort_values("at")[["at", "kind", "kickoff"]].itertuples(index=False):
                p.take(kind, int(at.timestamp()), None if pd.isna(kickoff) else int(kickoff.timestamp()))
        if p.done:
            self._plan(p, now + KEEP)
        else:  # a key that heats up is asked sooner, one that cools down keeps its turn
            due = now + p.every(now)
            self._plan(p, due if new else min(p.due, due))
        yield pd.DataFrame({"match_id": [], "at": [], "every_s": []}).astype({"match_id": "int64", "at": "datetime64[ns]", "every_s": "int32"})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(0, timerValues.getCurrentWatermarkInMs() // 1000)
        p = self._held()
        if p.done:
            self.pace.clear()
            return
        every = p.every(now)
        self._plan(p, now + every)
        yield pd.DataFrame({"match_id": [key[0]], "at": [pd.Timestamp(now, unit="s")], "every_s": [every]}).astype({"every_s": "int32"})

    def close(self) -> None:
        pass


def asks(rows: DataFrame, late: str = "0 seconds") -> DataFrame:
    """match_id, at, every_s: when each key of a stream of :data:`ROWS` is to be asked, and how long until the next time.

    Rows without a key or time are left out; one clock row of any key moves the clock for all. The state lies in RocksDB, which
    the session is set to.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    told = rows.where(F.col("match_id").isNotNull() & F.col("at").isNotNull()).withWatermark("at", late)
    return told.groupBy("match_id").transformWithStateInPandas(statefulProcessor=Asker(), outputStructType=ASKS, outputMode="Append", timeMode="EventTime")
