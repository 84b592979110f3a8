"""Schedules, dates in markup, weights of age, and walks within a key, against values by hand."""

import datetime as dt

from pyspark.sql import functions as F

from korvane.functions import schedules
from korvane.operators import histories

T = dt.datetime


def test_next_occurrence(spark):
    cases = [
        ("daily", 1, "07:30", [], None, T(2024, 1, 31, 10), T(2024, 2, 1, 7, 30)), (None, None, None, None, None, T(2024, 1, 31, 10), T(2024, 2, 1, 9)), ("daily", 3, "bad", [], "2024-02-02", T(2024, 1, 31), None),
        ("weekly", 5, "09:00", [0, 2], None, T(2024, 1, 31, 8), T(2024, 2, 5, 9)), ("weekly", 1, "09:00", [], None, T(2024, 1, 31, 8), T(2024, 2, 7, 9)), ("weekly", 2, "09:00", [9], None, T(2024, 1, 31, 8), T(2024, 2, 14, 9)), ("weekly", 1, "9:05", [2, 3], "2024-02-01", T(2024, 1, 31, 8), T(2024, 2, 1, 9, 5)),
        ("monthly", 1, "23:59", None, "", T(2024, 1, 31), T(2024, 2, 29, 23, 59)), ("monthly", 13, "09:00", None, None, T(2024, 2, 29), T(2025, 3, 29, 9)), ("once", 1, "09:00", None, None, T(2024, 1, 31), None), ("yearly", 1, "09:00", None, None, T(2024, 1, 31), None),
        ("daily", 1, "25:00", None, None, T(2024, 1, 31), None), ("daily", 1, "09:00", None, None, None, None),
    ]
    df = spark.createDataFrame([(i, *c[:6]) for i, c in enumerate(cases)], "id int, freq string, n int, t string, days array<int>, end string, after timestamp")
    got = {r["id"]: r["x"] for r in df.select("id", schedules.next_occurrence(*(F.col(c) for c in ("freq", "n", "t", "days", "end", "after"))).alias("x")).collect()}
    assert got == {i: c[6] for i, c in enumerate(cases)}


def test_event_time(spark):
    cases = [("2024-03-05", "6:30 PM", T(2024, 3, 5, 18, 30)), ("2024-3-5", "TBD", T(2024, 3, 5, 9)), ("2024-03-05", None, T(2024, 3, 5, 9)), ("2024-03-05", "18:30", T(2024, 3, 5, 18, 30)), ("2024-03-05", "around 12am or 3 pm", T(2024, 3, 5, 0)), ("2024-03-05", "12:15 pm", T(2024, 3, 5, 12, 15)), ("2024-03-05", "5 o'clock", T(2024, 3, 5, 9)), ("2024-03-05", "25:00", None), ("2024-02-30", "6 PM", None), ("soon", "6 PM", None), (None, "6 PM", None)]
    df = spark.createDataFrame([(i, d, t) for i, (d, t, _) in enumerate(cases)], "id int, d string, t string")
    got = {r["id"]: r["x"] for r in df.select("id", schedules.event_time(F.col("d"), F.col("t")).alias("x")).collect()}
    assert got == {i: c[2] for i, c in enumerate(cases)}


def test_prior(spark):
    cases = [("news", "2024-01-31", None, None, 0.85), ("news", "2023-08-04", None, None, 0.5), ("news", "2024-01-01", None, None, round(0.85 * 0.5 ** (30 / 180), 6)), ("news", "2025-01-01", None, None, 0.85), ("news", "2024-01-31T00:00:00Z", None, None, 0.85), ("news", "no date", None, None, 0.85), ("news", None, None, None, 0.85),
             ("event", None, "2024-01-30", "2024-01-31", 1.2), ("event", None, "2024-01-31", None, 1.2), ("event", None, "2024-02-05", "2024-01-30", 1.0), ("event", "2010-01-01", "2024-01-30", None, 0.5), ("event", None, None, "bad", 1.0), ("event", None, "2024-02-01", "bad", 1.2), ("event_info", None, None, None, 1.2), ("webpage", "2010-01-01", None, None, 0.8), ("policy", None, None, None, 1.0), (None, None, None, None, 1.0)]
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "id int, k string, p string, s string, e string")
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    got = {r["id"]: round(r["x"], 6) for r in df.select("id", schedules.prior(F.col("k"), F.col("p"), F.col("s"), F.col("e"), now).alias("x")).collect()}
    assert got == {i: c[4] for i, c in enumerate(cases)}


def test_page_dates_and_texts(spark):
    ld = '<script type="application/ld+json">{}</script>'
    cases = [
        ('<META content="2024-01-02" property="article:published_time"><time datetime="2020">', ("2024-01-02", None, None, None)),
        (ld.format('{"@type": "Event", "startDate": "2024-05-01", "endDate": "", "datePublished": "2024-03-03"}'), ("2024-03-03", "2024-05-01", None, None)),
        (ld.format('[{"@type": "Article", "startDate": "1999", "dateModified": " 2024-04-04 "}, {"@type": "event", "endDate": "2024-06-01"}, 7]') + ld.format('{"dateModified": "later"}'), (None, None, "2024-06-01", "2024-04-04")),
        (ld.format("{broken") + "<time>no</time><time class='x' datetime='2021-01-01'>", ("2021-01-01", None, None, None)),
        ('<!-- <meta property="article:published_time" content="2024"> -->text', (None,) * 4), ("", (None,) * 4), (None, (None,) * 4),
    ]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "id int, h string")
    assert {r["id"]: tuple(r["d"]) for r in df.select("id", schedules.page_dates(F.col("h")).alias("d")).collect()} == {i: c[1] for i, c in enumerate(cases)}
    t = spark.createDataFrame([("a�b \n c ",), ("**Rate**: 85 % (of $3.5)",), (None,)], "t string").select(schedules.mended(F.col("t")), schedules.compared(F.col("t"))).collect()
    assert [r[0] for r in t] == ["ab c", "**Rate**: 85 % (of $3.5)", ""] and [r[1] for r in t] == ["a b c", "rate 85% of $3.5", ""]


def test_highlights(spark):
    rows = [(1, 10, "a", 2024, 5), (1, 10, "a2", 2023, 9), (1, None, "b", 2024, 7), (1, None, "b", 2024, 8), (1, 11, "c", None, 99), (1, 12, "d", 2020, None), (2, 13, "e", 2024, 1), (None, 14, "f", 2024, 1)]
    df = spark.createDataFrame(rows, "person long, paper long, title string, year int, cited int")
    got = {(r["person"], r["list"], r["place"]): (r["title"], r["cited"]) for r in histories.highlights(df, 2024).collect()}
    assert got == {(1, "top_cited", 1): ("c", 99), (1, "top_cited", 2): ("a2", 9), (1, "top_cited", 3): ("b", 8), (1, "top_cited", 4): ("d", 0), (1, "newest", 1): ("b", 8), (1, "newest", 2): ("a2", 9), (1, "newest", 3): ("d", 0), (1, "current_year", 1): ("b", 8), (2, "top_cited", 1): ("e", 1), (2, "newest", 1): ("e", 1), (2, "current_year", 1): ("e", 1)}
    assert histories.highlights(df, 2024, cited=1, newest=0, current=0).count() == 2 and histories.highlights(df.limit(0), 2024).count() == 0


def test_versions_and_scores(spark):
    df = spark.createDataFrame([(1, None, 1, False), (2, 1, 2, False), (3, 1, 3, True), (4, None, 1, True), (5, 9, None, None), (None, 1, 4, True)], "id long, root_id long, version int, active boolean")
    got = {r["id"]: tuple(r)[1:] for r in histories.versions(df).collect()}
    assert got == {1: (1, 1, 3, "superseded", 3, 3), 2: (1, 2, 2, "superseded", 3, 3), 3: (1, 3, 1, "current", 3, None), 4: (4, 1, 1, "current", 1, None), 5: (9, None, 1, "superseded", None, None)}
    goals = spark.createDataFrame([(1, 1, "h", "a"), (1, 2, "a", "a"), (1, 3, None, "a"), (1, 4, "a", "a"), (2, 1, "x", None)], "match long, seq int, team string, away string")
    assert {(r["match"], r["seq"]): (r["home_score"], r["away_score"]) for r in histories.running_scores(goals, ["seq"]).collect()} == {(1, 1): (1, 0), (1, 2): (1, 1), (1, 3): (2, 1), (1, 4): (2, 2), (2, 1): (1, 0)}
    assert histories.running_scores(goals.limit(0), ["seq"]).count() == 0 and histories.versions(df.limit(0)).count() == 0
