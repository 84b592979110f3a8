"""Next times of recurring posts, times of events from loose text, dates in the markup of pages, and the weight of age.

All are expressions of built-in functions: a row stays a row, and nothing shuffles. Defined results stand at each function; null
arguments are treated as missing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of kinds of rows, and the half-life and floor of news.
NEWS, HALF_LIFE, FLOOR, WEBPAGE, BOOST = 0.85, 180, 0.5, 0.8, 1.2
#: The hour of an event or a post whose time is not told.
HOUR = 9


def at(day: Column, hour: Column, minute: Column) -> Column:
    """A day at a wall clock; null for an hour or a minute that no clock shows."""
    return F.try_make_timestamp(F.year(day), F.month(day), F.day(day), hour, minute, F.lit(0))


def next_occurrence(freq: Column, interval: Column, time: Column, days: Column, end: Column, after: Column) -> Column:
    """The next time of a schedule after ``after``; null for schedules that do not repeat and past their ``end`` (a day as text).

    daily: ``interval`` days on; weekly: the next of ``days`` (0 is Monday; none: the weekday of ``after``), whatever the interval, and
    ``interval`` weeks on where no day is one of a week; monthly: ``interval`` months on, the day cut to the month's last. A missing
    ``freq`` is daily, a missing interval 1, a missing or malformed ``time`` (``HH:MM``) 09:00.
    """
    day, every = F.to_date(after), F.coalesce(interval, F.lit(1)).cast("int")
    clock = "^ *([0-9]{1,2}):([0-9]{1,2}) *$"
    told = F.coalesce(F.rlike(time, F.lit(clock)), F.lit(False))
    hour, minute = (F.when(told, F.regexp_extract(time, clock, i).try_cast("int")).otherwise(d) for i, d in ((1, HOUR), (2, 0)))
    wanted = F.when(F.size(F.coalesce(days, F.array().cast("array<int>"))) > 0, days).otherwise(F.array(F.weekday(day)))
    step = F.array_min(F.filter(F.sequence(F.lit(1), F.lit(7)), lambda k: F.array_contains(wanted, F.weekday(F.date_add(day, k)))))
    kind = F.coalesce(freq, F.lit("daily"))
    on = F.when(kind == "daily", F.date_add(day, every)).when(kind == "weekly", F.date_add(day, F.coalesce(step, every * 7))).when(kind == "monthly", F.add_months(day, every))
    late = F.coalesce((end != "") & (F.date_format(on, "yyyy-MM-dd") > end), F.lit(False))
    return F.when(~late, at(on, hour, minute))


def event_time(day: Column, time: Column) -> Column:
    """The time of an event from a day (``yyyy-M-d``) and loose text: ``6:30 pm``, ``18:30``, ``around 6 PM``; 09:00 where none is told.

    The first clock with minutes counts, else the first hour with AM or PM. Null for no day, and for a clock that does not exist.
    """
    date = F.to_date(F.try_to_timestamp(F.when(F.rlike(day, F.lit("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$")), day), F.lit("yyyy-M-d")))
    full, short = "([0-9]{1,2}):([0-9]{2})[ \t]*([AaPp][Mm])?", "([0-9]{1,2})[ \t]*([AaPp][Mm])"
    t = F.coalesce(time, F.lit(""))
    minutes, hours = F.rlike(t, F.lit(full)), F.rlike(t, F.lit(short))
    pick = lambda a, b, other: F.when(minutes, a).when(hours, b).otherwise(other)
    hour = pick(F.regexp_extract(t, full, 1), F.regexp_extract(t, short, 1), F.lit(str(HOUR))).cast("int")
    half = F.upper(pick(F.regexp_extract(t, full, 3), F.regexp_extract(t, short, 2), F.lit("")))
    turned = F.when((half == "PM") & (hour != 12), hour + 12).when((half == "AM") & (hour == 12), 0).otherwise(hour)
    return at(date, turned, F.when(minutes, F.regexp_extract(t, full, 2).cast("int")).otherwise(0))


def iso(text: Column) -> Column:
    """The time of an ISO date or date and time, else of its first ten characters, else null."""
    dated = F.when(F.rlike(text, F.lit("^[0-9]{4}-[0-9]{2}-[0-9]{2}")), text)
    return F.coalesce(dated.try_cast("timestamp"), F.substring(dated, 1, 10).try_cast("timestamp"))


def prior(kind: Column, published: Column, start: Column, end: Column, now: Column, boost: float = BOOST) -> Column:
    """The weight of a row by kind and age; dates are ISO text, what cannot be read is missing.

    news: halves with age from 0.85 down to 0.5, undated 0.85, dated ahead as if new. event: the boost until the end of the day of
    its end (or start), then as news if published is told, else 1. event_info: the boost. webpage: 0.8. All else 1.
    """
    age = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(iso(published))) / 86400e6)
    news = F.coalesce(F.greatest(F.lit(FLOOR), F.lit(NEWS) * F.pow(F.lit(0.5), age / HALF_LIFE)), F.lit(NEWS))
    ahead = F.coalesce(F.coalesce(iso(end), iso(start)) >= F.date_trunc("day", now), F.lit(False))
    event = F.when(ahead, boost).when(F.coalesce(published, F.lit("")) != "", news).otherwise(1.0)
    return F.when(kind == "news", news).when(kind == "event", event).when(kind == "event_info", boost).when(kind == "webpage", WEBPAGE).otherwise(1.0)


_NODE = "struct<`@type`: string, startDate: string, endDate: string, datePublished: string, dateModified: string>"


def page_dates(html: Column) -> Column:
    """A struct (published_at, event_start, event_end, source_updated_at) of dates in a page's markup, as written there; null where none is.

    From the meta element of publication, then JSON-LD (the first of each key; starts and ends of events only), then the first
    time element, which dates the publication alone. Comments do not count; a script that is no JSON is skipped.
    """
    h = F.regexp_replace(F.coalesce(html, F.lit("")), "(?s)<!--.*?-->", "")
    value = lambda tag, name: F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*[\"']([^\"'<>]*)[\"']", 1)
    filled = lambda x: F.nullif(F.trim(x), F.lit(""))
    meta = F.filter(F.regexp_extract_all(h, F.lit("(?i)(<meta\\b[^>]*>)"), F.lit(1)), lambda t: F.lower(value(t, "property")) == "article:published_time")
    scripts = F.regexp_extract_all(h, F.lit("(?is)<script\\b[^>]*\\btype\\s*=\\s*[\"']application/ld\\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))
    each = F.transform(scripts, lambda s: F.when(F.ltrim(s).startswith("["), F.coalesce(F.from_json(s, "array<string>"), F.array().cast("array<string>"))).otherwise(F.array(s)))
    nodes = F.filter(F.transform(F.flatten(each), lambda s: F.from_json(s, _NODE)), lambda n: n.isNotNull())
    events = F.filter(nodes, lambda n: F.lower(n["@type"]) == "event")
    of = lambda ns, key: F.get(F.filter(F.transform(ns, lambda n: filled(n[key])), lambda x: x.isNotNull()), F.lit(0))
    time = F.get(F.filter(F.transform(F.regexp_extract_all(h, F.lit("(?i)(<time\\b[^>]*>)"), F.lit(1)), lambda t: filled(value(t, "datetime"))), lambda x: x.isNotNull()), F.lit(0))
    published = F.coalesce(filled(value(F.get(meta, F.lit(0)), "content")), of(nodes, "datePublished"), time)
    return F.struct(published.alias("published_at"), of(events, "startDate").alias("event_start"), of(events, "endDate").alias("event_end"), of(nodes, "dateModified").alias("source_updated_at"))


def mended(text: Column) -> Column:
    """Without replacement characters, white space collapsed; empty for null."""
    return F.trim(F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\ufffd"), F.lit("")), "[ \t\r\n\f\u000b]+", " "))


def compared(text: Column) -> Column:
    """A form in which texts are held against each other: lower case, marks of emphasis and punctuation gone but for ``% $ .``, percent signs at their number."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9%$.]+", " ")
    return F.regexp_replace(F.trim(t), " +%", "%")
