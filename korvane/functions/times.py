"""Local time: days of an audience's own zone, and conversions between wall clocks and UTC. Times are UTC timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZONE = "America/New_York"


def local(ts: Column, zone: str = ZONE) -> Column:
    """The wall clock of ``zone`` at a UTC time."""
    return F.from_utc_timestamp(ts, zone)


def utc(wall: Column, zone: str = ZONE) -> Column:
    """The UTC time of a wall clock of ``zone``."""
    return F.to_utc_timestamp(wall, zone)


def shown(ts: Column, zone: str = ZONE) -> Column:
    """``Jun 12, 6:00 PM``, the wall clock of ``zone``; a dash for no time."""
    return F.coalesce(F.date_format(local(ts, zone), "MMM d, h:mm a"), F.lit("—"))


def local_days(events: DataFrame, now: Column, days: int, ts: str = "ts", zone: str = ZONE) -> DataFrame:
    """Events whose own local day is today's or one of the ``days`` after it, today being the day of ``now`` in ``zone``."""
    today, day = F.to_date(local(now, zone)), F.to_date(local(F.col(ts), zone))
    return events.where((day >= today) & (day <= F.date_add(today, days)))
