"""The families of questions, each with the route it must take; candidates resolved from names."""

from pyspark.sql import functions as F

from korvane.operators import routing

P, O = {"person": 7, "n_people": 1, "name_words": 2}, {"org": 3}
CASES = [
    ("most cited papers by ann lee", P, "papers_of_person", {"entity_id": "7", "mode": "cited"}),
    ("top 3 papers of ann lee", P, "papers_of_person", {"mode": "recent", "n": "3"}),
    ("papers by lee", {"n_people": 4}, "person_disambig", {"origin": "papers_of_person", "candidates": "4"}),
    ("most cited paper in cs", O, "papers_cross_unsupported", {}),
    ("most cited paper", {}, None, None),
    ("what was ann lee's peak year", P, "citation_trend_of_person", {"mode": "peak"}),
    ("citations of ann lee in 2019", P, "citation_trend_of_person", {"mode": "year", "year": "2019"}),
    ("citations of ann lee since in 2019", {**P, "metric": "citations"}, "metric_of_person", {"metric": "citations"}),
    ("who lists databases as a research area", {"area": "databases"}, "people_by_area_tag", {"area": "databases"}),
    ("how many people work on databases", {"area": "databases", **O}, "count_people_by_research_area", {"org_id": "3"}),
    ("is ann lee working on databases", {"area": "databases", **P}, "does_person_research_area", {"entity_id": "7", "area": "databases"}),
    ("who works on databases", {"area": "databases"}, "people_by_research_area", {"area": "databases"}),
    ("most common research areas in cs", O, "area_counts", {"org_id": "3"}),
    ("what areas does cs cover", O, "areas_in_org", {"org_id": "3"}),
    ("research areas of professors in cs", O, "faculty_areas_in_department", {"org_id": "3"}),
    ("least cited professor", {"metric": "citations", "root": 1}, "metric_descending_unsupported", {"org_id": "1", "org_defaulted": "true"}),
    ("top 5 professors by citations in cs", {"metric": "citations", "root": 1, **O}, "top_people_by_metric", {"org_id": "3", "n": "5", "org_defaulted": "false"}),
    ("most cited professor", {"metric": "citations", "root": 1}, "top_people_by_metric", {"org_id": "1", "org_defaulted": "true"}),
    ("most citations needed to graduate", {"metric": "citations", "root": 1}, None, None),
    ("ann lee h-index", {"metric": "h_index", **P}, "metric_of_person", {"metric": "h_index"}),
    ("ann lee github", {"link": "github", **P}, "link_of_person", {"link": "github"}),
    ("what's on the website", {"link": "website"}, None, None),
    ("who are the officers of the chess club", {**O, "has_officers": True}, "officers_in_org", {"org_id": "3"}),
    ("how do I become president of the chess club", {**O, "has_officers": True}, None, None),
    ("who is the dean of cs", {"role": "dean", "climbed": 9, **O}, "people_by_role", {"role": "dean", "org_id": "9"}),
    ("how to become a dean", {"role": "dean", "role_words": 1}, None, None),
    ("list all colleges", {}, "orgs_by_type", {"type": "college"}),
    ("list clubs", {}, "orgs_by_type", {"type": "club"}),
    ("departments in engineering", {**O, "has_children": True}, "org_departments", {"org_id": "3"}),
    ("academic staff in biology", O, "faculty_in_department", {"org_id": "3"}),
    ("staff of the registrar", O, "people_in_org", {"org_id": "3"}),
    ("staff of the university", {"org": 1, "root": 1}, None, None),
    ("list all the michaels", {"n_people": 5, "person": 1, "person_name": "michael"}, "people_by_name", {"name": "michael", "n": "5"}),
    ("what does ann lee research", P, "research_of_person", {"entity_id": "7"}),
    ("Who is Ann Lee?", P, "entity_card", {"entity_id": "7"}),
    ("ann lee", P, "entity_card", {"entity_id": "7"}),
    ("professor lee's email", {"n_people": 2, "person": 1}, "person_disambig", {"origin": "entity_card"}),
    ("dean", {"role": "dean", "role_words": 1}, "people_by_role", {"role": "dean"}),
    ("officers", {}, "ambiguous_officers", {}),
    ("when does the library open", {}, None, None),
    ("", {}, None, None),
    (None, {}, None, None),
]
KINDS = {"person": "long", "n_people": "long", "name_words": "long", "org": "long", "root": "long", "climbed": "long", "has_officers": "boolean", "has_children": "boolean", "area": "string", "metric": "string", "link": "string", "role": "string", "role_words": "long", "person_name": "string"}


def test_families(spark):
    rows = [(i, t, *(c.get(k) for k in KINDS)) for i, (t, c, *_) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id long, text string, " + ", ".join(f"{k} {v}" for k, v in KINDS.items()))
    got = {r["id"]: r for r in routing.route(df).collect()}
    for i, (t, _, skill, args) in enumerate(CASES):
        assert got[i]["skill"] == skill, (t, got[i])
        assert (got[i]["rule"] is None) == (skill is None)
        if args is not None:
            assert args.items() <= got[i]["args"].items(), (t, got[i])
    assert {r["skill"] for r in got.values()} >= {r.skill for r in routing.RULES}
    assert routing.route(df.limit(0)).count() == 0
    assert routing.route(df.select("id", "text").where("id = 36")).first()["skill"] is None  # without candidates


def test_order_decides(spark):
    df = spark.createDataFrame([(1, "alpha beta")], "id long, text string")
    a, b = routing.Rule("a", "A", "x"), routing.Rule("b", "B", "y", "map('k', 1, 'none', NULL)")
    cues = {"x": "alpha", "y": "beta"}
    assert routing.route(df, [a, b], cues).first()["rule"] == "a"
    assert routing.route(df, [b, a], cues).first().asDict() == {"id": 1, "rule": "b", "skill": "B", "args": {"k": "1"}}


def test_candidates(spark):
    people = spark.createDataFrame([(1, "Ann Lee", "Lee"), (2, "Bob Lee", "Lee"), (3, "Ann Lee", "Lee"), (4, "Mo", None), (None, "No One", "One")], "id long, name string, surname string")
    orgs = spark.createDataFrame([(10, "Computer Science", True), (11, "Science", False)], "id long, name string, has_children boolean")
    asked = spark.createDataFrame([(1, "who is ann LEE in computer science"), (2, "professor Lee"), (3, "bob lee, science"), (4, None), (5, "mo"), (6, "leeward")], "id long, text string")
    got = {r["id"]: (r["person"], r["n_people"], r["name_words"], r["org"], r["has_children"]) for r in routing.candidates(asked, people, orgs, 1).collect()}
    assert got == {1: (1, 2, 2, 10, True), 2: (1, 3, 1, None, None), 3: (2, 1, 2, 11, False), 4: (None, 0, None, None, None), 5: (4, 1, 1, None, None), 6: (None, 0, None, None, None)}
    told = {r["id"]: r["skill"] for r in routing.route(routing.candidates(asked, people, orgs, 1)).collect()}
    assert told[3] is None or told[3] == "entity_card"
    assert told[5] == "entity_card" and told[4] is None
    assert routing.candidates(asked.limit(0), people, orgs).where(F.lit(True)).count() == 0
