"""Steps that must not grow with repeated questions, or hold one group several times over."""

from pyspark.sql import functions as F

from korvane.functions import phrases
from korvane.operators import histories, routing, scoring


def test_repeated_questions_are_searched_once(spark, monkeypatch):
    people = spark.createDataFrame([(1, "ann lee", "lee"), (2, "bob lee", "lee")], "id long, name string, surname string")
    orgs = spark.createDataFrame([(7, "physics")], "id long, name string")
    asked = spark.range(300).select("id", F.lit("is ann lee in physics").alias("text")).unionByName(spark.createDataFrame([(300, None), (301, "lee"), (301, "bob lee"), (None, "lee")], "id long, text string"))
    searched, longest = [], phrases.longest
    monkeypatch.setattr(phrases, "longest", lambda texts, *a: searched.append(texts.count()) or longest(texts, *a))
    got = {(r["id"], r["text"]): (r["person"], r["n_people"], r["name_words"], r["org"]) for r in routing.candidates(asked, people, orgs).collect()}
    assert len(got) == 304 and all(got[i, "is ann lee in physics"] == (1, 1, 2, 7) for i in range(300))
    assert got[300, None] == got[None, "lee"] == (None, 0, None, None) and got[301, "lee"] == got[301, "bob lee"] == (2, 1, 2, None)
    assert searched == [3, 3, 3]


def test_slot_sides_meet_without_a_join(spark):
    kind = "id long, slot string, value string"
    asked = spark.createDataFrame([(1, "a")], "id long, skill string")
    df = scoring.slot_scores(asked, spark.createDataFrame([(1, "x", "v"), (1, None, "v"), (1, "y", "w")], kind), spark.createDataFrame([(1, "x", " V "), (1, None, "v"), (1, "x", "v")], kind))
    assert {tuple(r)[:5] for r in df.collect()} == {("a", 1, 1, 1, 2), (None, 1, 1, 1, 2)}  # null slots are not the same slot
    assert "FullOuter" not in df._jdf.queryExecution().executedPlan().toString()


def test_lists_leave_out_early(spark):
    rows = [(1, i, f"t{i % 7}", 2000 + i % 5 if i % 3 else None, i % 4) for i in range(60)]
    df = histories.highlights(spark.createDataFrame(rows, "person long, paper long, title string, year int, cited int"), 2001)
    got = [tuple(r)[1:4] for r in df.orderBy("list", "place").collect()]
    best = sorted(rows, key=lambda r: (-r[4], r[2], r[1]))
    of = lambda name, rs, n: [(name, i + 1, r[1]) for i, r in enumerate(rs[:n])]
    dated = sorted((r for r in best if r[3]), key=lambda r: -r[3])
    assert got == of("current_year", [r for r in best if r[3] == 2001], 10) + of("newest", dated, 5) + of("top_cited", best, 5)
    assert df._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 6
