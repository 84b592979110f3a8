"""Ordered rules against values by hand; dispatch and slot scores; evidence of a fact from four probes."""

import math

from pyspark.sql import functions as F

from korvane.operators import evidence, scoring, screens

SAID = [
    ("please clear my history", "clear_history", 1.0), ("RESET the chat", "clear_history", 1.0), ("switch to free mode", "free_mode", 1.0), ("exit free mode", "topic_mode", 1.0),
    ("any free pizza today?", "food", 1.0), ("what is the food budget per person?", "question", 0.9), ("I am bored", "social", 1.0), ("funding stays fundamental", "statement", 0.5),
    ("is it fun to read all of the minutes of the senate", "question", 0.9), ("  Hello\n", "greeting", 1.0), ("hello, my form about residency is wrong", "statement", 0.5), ("ok bye!", "farewell", 1.0),
    ("Thanks a lot", "thanks", 1.0), ("what can you do", "help", 1.0), ("who are you?", "identity", 1.0), ("and now where is the registrar", "question", 0.9),
    ("the registrar office moved where", "statement", 0.5), ("library hours?", "question", 0.9), ("", "statement", 0.5), (None, "statement", 0.5), ("x" * 50_000 + " pizza", "food", 1.0),
]
ASKED = [
    ("what is my gpa", "personal", "what is my gpa"), ("how do i see my gpa", None, None), ("did I get accepted", "personal", "did i get"), ("do my credits transfer", None, None),
    ("is the hold on my account gone", "personal", "hold"), ("where do i see my hold", None, None), ("write an email for me", "task", "write an email for me"), ("how do i write my thesis", None, None),
    ("do my math homework", "task", "do my math homework"), ("fees at northtown", "other_institution", "northtown"), ("transfer from northtown to own u", None, None),
    ("when is my appointment today", "live", "today"), ("is the gym open right now", "live", "open"), ("events open today", None, None), ("gym opening hours", None, None), ("", None, None), (None, None, None),
]


def test_intents_and_deflections(spark):
    df = spark.createDataFrame([(i, t, "own") for i, (t, _, _) in enumerate(SAID)], "id int, text string, intent string")
    got = {r["id"]: (r["intent"], r["confidence"]) for r in screens.intents(df).collect()}
    assert got == {i: (a, b) for i, (_, a, b) in enumerate(SAID)}
    assert len({c.name for c in screens.INTENTS} | {"question", "statement"}) == 12
    cues = screens.deflections(["northtown"], "own u")
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(ASKED)], "id int, text string")
    out = screens.deflected(df, cues).collect()
    assert {r["id"]: (r["family"], r["cue"]) for r in out} == {i: (a, b) for i, (_, a, b) in enumerate(ASKED)}
    assert all(r["deflect"] == (r["family"] is not None) for r in out)
    assert screens.deflected(df.limit(0), cues).count() == 0
    assert screens.deflected(df.union(df), screens.deflections()).where("deflect").count() == 2 * (sum(a is not None for _, a, _ in ASKED) - 1)


def test_decisions(spark):
    rows = [(1, "my gpa", 0.9, None, False), (2, None, 0.8, None, False), (3, None, 0.1, None, False), (4, None, 0.1, "NOT_IN_CONTEXT", None), (5, None, 0.8, "NOT_IN_CONTEXT", True), (6, None, 0.8, "NOT_IN_CONTEXT", None), (7, None, None, "FULLY_SUPPORTED", None), (8, "", math.nan, "NOT_IN_CONTEXT", None), (9, None, 0.5, "NOT_IN_CONTEXT", None)]
    df = spark.createDataFrame(rows, "id int, cue string, score double, label string, fact_shaped boolean")
    got = {r["id"]: (r["outcome"], r["check"], r["skip_fallback"]) for r in screens.decided(df, 0.5).collect()}
    answer, weak, back = ("answer", False, False), ("answer", True, False), ("fallback", True, False)
    assert got == {1: ("deflect", False, True), 2: answer, 3: weak, 4: back, 5: back, 6: answer, 7: weak, 8: back, 9: answer}
    asked = spark.createDataFrame([("How many students?",), ("pass rate of 2020",), ("who is ann",), (None,)], "text string")
    assert [r[0] for r in asked.select(screens.fact_shaped(F.col("text"))).collect()] == [True, True, False, False]


def test_ladder(spark):
    rows = [
        (1, 11, "primary", 1, None), (1, 12, "primary", 2, 0.6), (1, 13, "office", 1, 0.9),
        (2, 21, "primary", 1, 0.1), (2, 22, "office", 1, 0.15), (2, 23, "deep", 1, 0.9),
        (3, 31, "primary", 1, 0.1), (3, 32, "office", 1, 0.1), (3, 33, "deep", 1, 0.4), (3, 34, "live", 1, None),
        (4, 41, "primary", 1, 0.1), (4, 42, "deep", 1, 0.2), (4, 43, "live", 1, None),
        (5, 51, "office", 1, None), (5, 52, "deep", 1, 0.3),
        (6, 61, "primary", 1, None), (6, 62, "deep", 1, 0.9), (7, 71, "primary", 1, 0.1), (7, 72, "primary", 1, 0.9), (7, 71, "primary", 1, 0.1), (None, 1, "primary", 1, 0.9), (8, 81, "primary", 1, math.nan), (8, 82, "primary", 2, 0.12),
    ]
    results = spark.createDataFrame(rows, "item_id long, doc_id long, tier string, place int, score double")
    questions = spark.createDataFrame([(i,) for i in [*range(1, 10), 1, None]], "item_id long")
    got = {r["item_id"]: (r["tier"], r["miss"], r["relevance"]) for r in screens.ladder(questions, results).collect()}
    assert got == {1: ("primary", False, 0.6), 2: ("office", True, 0.15), 3: ("deep", True, 0.4), 4: ("live", True, None), 5: ("deep", True, 0.3), 6: ("primary", False, None), 7: ("primary", True, 0.1), 8: ("primary", True, 0.12), 9: ("none", True, None)}
    off = {r["item_id"]: r["tier"] for r in screens.ladder(questions, results, deep=False, live=False).collect()}
    assert off[3] == off[4] == "primary" and off[5] == "none"
    assert {r["doc_id"] for r in screens.served(results, screens.ladder(questions, results)).where("item_id in (2, 3)").collect()} == {22, 33}
    assert screens.ladder(questions.limit(0), results).count() == 0 and screens.ladder(questions, results.limit(0)).where("tier = 'none'").count() == 9


def test_rows_pages_titles(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    lit = F.lit
    df = spark.createDataFrame([(1, "two words"), (2, "mail me at a.b@c.org please"), (3, "three good words"), (4, None), (5, "at @ sign alone here")], "id int, text string")
    assert {r["id"]: r["refused"] for r in screens.screened(df).collect()} == {1: "short", 2: "mail", 3: None, 4: "short", 5: None}
    foods = [("Social", None, None, True), ("talk", "Pizza night", None, True), ("talk", "Colloquium", "with REFRESHMENTS", True), (None, None, None, False), ("talk", "Colloquium", "", False)]
    assert [one(screens.event_has_food(*(lit(x).cast("string") for x in f[:3]))) for f in foods] == [f[3] for f in foods]
    assert [one(screens.asks_for_food(lit(t))) for t in ("where is free food", "food budget", "how much pizza", "room")] == [True, False, False, False]
    pages = [("https://x.org/bursar/fees", "Office hours.", True, "high"), ("https://x.org/bursar", "Office hours.", False, "low"), ("/a", "You may be dismissed.", False, "high"), ("/a", "optional agreement", False, "low"), ("/a", "Apply for OPT now", None, "high"), (None, None, None, "low")]
    assert [one(screens.stakes(lit(u).cast("string"), lit(t).cast("string"), lit(v).cast("boolean"))) for u, t, v, _ in pages] == [p[3] for p in pages]
    kinds = {"https://x.org/faculty/lee": "people", "https://x.org/administration-0": "people", "https://x.org/faculty-handbook": "policy", "https://news.org/a": "policy", "https://x.org/News/2020?events": "news", "https://x.org/events#a": "event", "/newsletter-signup": "policy", "": "policy"}
    assert {u: one(screens.page_kind(lit(u))) for u in kinds} == kinds and one(screens.page_kind(lit(None).cast("string"))) == "policy"
    titles = [(["Associate Dean", "Professor"], "faculty"), (["Professor Emeritus"], "faculty"), (["Emerita"], "emeritus"), (["Dean"], "admin"), (["Academic Advisor"], "advisor"), (["Director"], "staff"), ([], "staff"), (["Professorship clerk"], "staff")]
    assert [one(screens.role_category(F.array(*(lit(t) for t in ts)).cast("array<string>"))) for ts, _ in titles] == [c for _, c in titles]
    ranks = {"Department Chair and Professor": 0, "Distinguished Professor": 1, "Professor": 2, "associate professor, Associate Dean": 3, "Assistant Professor": 4, "Senior University Lecturer": 5, "University Lecturer": 6, "Dean": 2, "Director": 7, "": 7}
    assert {t: one(screens.seniority(lit(t)))["rank"] for t in ranks} == ranks


def test_dispatch_and_slots(spark):
    m = "metric_of_person"
    rows = [("KG", m, "KG", m), ("KG", m, "KG", "card"), ("KG", "card", "RAG", None), ("KG", "card", "KG", m), ("RAG", None, "KG", m), ("RAG", None, "RAG", None), ("RAG", None, None, None), (None, None, "KG", m), ("KG", m, None, None)]
    runs = spark.createDataFrame(rows, "gold_family string, gold_skill string, told_family string, told_skill string")
    assert scoring.dispatch(runs).first().asDict() == {"n": 8, "family_accuracy": 0.5, "skill_accuracy": 0.333333, "structured_false_negative": 2, "false_honest_partial": 2, "wrong_confident_exact": 2}
    assert {tuple(r) for r in scoring.dispatch_confusion(runs).collect()} == {(m, m, 1), (m, "card", 1), ("card", m, 1)}
    assert scoring.dispatch(runs.limit(0)).first().asDict() == {"n": 0, "family_accuracy": 0.0, "skill_accuracy": None, "structured_false_negative": 0, "false_honest_partial": 0, "wrong_confident_exact": 0}
    asked = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, "d"), (None, "a")], "id long, skill string")
    kind = "id long, slot string, value string"
    gold = spark.createDataFrame([(1, "org", "CS"), (1, "n", "3"), (1, "note", "x"), (2, "org", "math"), (4, "org", "bio"), (9, "org", "x"), (3, "org", " ")], kind)
    told = spark.createDataFrame([(1, "org", " cs "), (1, "org", "cs"), (1, "n", "4"), (2, "org", "math"), (5, "org", "x"), (3, "org", None)], kind)
    got = {r["skill"]: tuple(r)[1:] for r in scoring.slot_scores(asked, gold, told, ("org", "n")).collect()}
    assert got == {None: (5, 2, 2, 2, 0.5, 0.5, 0.5, 0.4), "a": (2, 2, 1, 1, 0.666667, 0.666667, 0.666667, 0.5), "b": (1, 0, 0, 0, 1.0, 1.0, 1.0, 1.0), "c": (1, 0, 0, 1, 0.0, 0.0, 0.0, 0.0), "d": (1, 0, 1, 0, 0.0, 1.0, 0.0, 0.0)}


def test_evidence(spark):
    facts = spark.createDataFrame([(1, "Ann Lee leads the quantum optics group"), (2, "Parking costs nine dollars"), (3, "Nothing at all known"), (4, None), (5, "")], "fact_id long, text string")
    items = spark.createDataFrame([(10, "In 2020 Ann Lee leads the Quantum optics group, again."), (11, "Parking costs more"), (12, None), (13, "Ann leads optics")], "doc_id long, text string")
    nodes = spark.createDataFrame([(7, "Ann Lee professor"), (8, "Annabel Lee"), (9, None)], "node_id long, text string")
    vectors = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 1.0])], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(3, [0.9, 0.1])], "item_id long, embedding array<float>")
    got = evidence.gathered(facts, items, nodes, vectors, asked, words=20, near=1)
    told = {(r["fact_id"], r["probe"], r["kind"], r["ref"]) for r in got.collect()}
    assert told == {(1, "phrase", "item", 10), (1, "name", "node", 7), (1, "keyword", "item", 10), (1, "keyword", "item", 13), (2, "keyword", "item", 11), (3, "vector", "item", 10)}
    spans = items.select(F.lit("item").alias("kind"), F.col("doc_id").alias("ref"), "text").union(nodes.select(F.lit("node"), "node_id", "text"))
    scored = evidence.judged(got, facts, spans)
    out = {r["fact_id"]: tuple(r)[1:] for r in evidence.presence(facts, scored).collect()}
    assert out == {1: (True, False, "keyword,phrase", 1, 1.0), 2: (False, True, "keyword", 1, 0.5), 3: (False, False, "", 0, 0.0), 4: (False, False, "", 0, 0.0), 5: (False, False, "", 0, 0.0)}
    assert evidence.gathered(facts.limit(0), items).count() == 0 and evidence.gathered(facts, items.limit(0)).count() == 0


def test_evidence_proposals(spark, monkeypatch):
    """Texts that hold a run's words apart are not proposed for it; runs of one word, and texts under one id, are found as before."""
    facts = spark.createDataFrame([(1, "red lamps near water"), (2, "incomprehensible"), (3, None)], "fact_id long, text string")
    apart = [(i, "water red near lamps") for i in range(100)]
    items = spark.createDataFrame([*apart, (200, "Old RED lamps near water."), (200, "other words"), (201, "so incomprehensible it is"), (202, "incomprehensibles"), (203, "red"), (204, None), (None, "red lamps near water")], "ref long, text string")
    seen, cut = [], evidence.cut
    monkeypatch.setattr(evidence, "cut", lambda df: seen.append(cut(df)) or seen[-1])
    got = evidence._found(facts, items.where("ref is not null"), evidence.RUNS, "phrase", "item")
    assert sorted((r["fact_id"], r["ref"]) for r in got.collect()) == [(1, 200), (2, 201)]
    assert {(r["said"], r["ref"]) for t in seen if t.columns == ["said", "ref"] for r in t.collect()} == {("red lamps near water", 200), ("incomprehensible", 201)}
