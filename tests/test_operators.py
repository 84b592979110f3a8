"""Callable operators against values worked out by hand, and against plain Python on small tables."""

import difflib
import itertools
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from korvane.functions import matching, profiles, times, urls
from korvane.operators import chunks, graph, order, people, records, retrieval, scoring, slots, trends
from korvane.sources import markdown

RND = random.Random(5)


def test_leaderboard_ranks_and_coverage(spark):
    presenters = spark.createDataFrame([(1, n) for n in (100, 101, 102, 103)], "event long, number long")
    scores = spark.createDataFrame([(100, 4.0), (100, 4.0), (101, 5.0), (101, 3.0), (102, 3.0)], "number long, points double")
    got = {r["number"]: r for r in scoring.leaderboard(presenters, scores, ["event", "number"], "points", 2).collect()}
    assert [got[n]["place"] for n in (100, 101, 102, 103)] == [1, 1, 3, None]
    assert [got[n]["score"] for n in (100, 101, 102, 103)] == [4.0, 4.0, 3.0, None]
    assert [got[n]["low_coverage"] for n in (100, 101, 102, 103)] == [False, False, True, True]


def test_equal_scores_in_another_order_tie(spark):
    presenters = spark.createDataFrame([(1, n) for n in (100, 101, 102, 103)], "event long, number long")
    rows = [(100, 0.1), (100, 0.2), (100, 0.3), (101, 0.3), (101, 0.2), (101, 0.1), (102, float("inf")), (103, None)]  # 0.1 + 0.2 + 0.3 and 0.3 + 0.2 + 0.1 differ as doubles
    got = {r["number"]: r for r in scoring.leaderboard(presenters, spark.createDataFrame(rows, "number long, points double").coalesce(1), ["event", "number"], "points", 2).collect()}
    assert [got[n]["place"] for n in (100, 101, 102, 103)] == [2, 2, 1, None]
    assert [got[n]["score"] for n in (100, 101)] == [0.2, 0.2]


@pytest.mark.parametrize("small", [order.SMALL, 1])
def test_places_ranks_and_totals(spark, monkeypatch, small):
    monkeypatch.setattr(order, "SMALL", small)  # with 1, groups of several keys go by ranges
    rows = [(i, RND.randrange(12), RND.choice([1.0, 2.0, 2.5, None])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g long, x double").repartition(7)
    assert {r["id"]: r["place"] for r in order.places(df, [F.desc("g"), F.col("id")]).collect()} == {r[0]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    got = {r["id"]: r["place"] for r in order.ranks(df, "x", "g").collect()}
    assert all(got[i] == (None if x is None else 1 + sum(1 for _, h, y in rows if h == g and y is not None and y > x)) for i, g, x in rows)
    top = {r["id"]: r["place"] for r in order.top_with_ties(df, "g", 20).collect()}
    edge = sorted((r[1] for r in rows), reverse=True)[19]
    assert top == {i: 1 + sum(h > g for _, h, _ in rows) for i, g, _ in rows if g >= edge}
    assert order.places(df.limit(0), [F.col("id")]).count() == 0 and order.top_with_ties(df.limit(0), "g", 3).count() == 0


def test_momentum(spark):
    series = {1: [4, 14, 30, 77, 139], 2: [100] * 5, 3: [2, 2, 2, 2, 45], 4: [500, 400, 300, 200, 100]}
    rows = [(i, 2021 + k, n) for i, s in series.items() for k, n in enumerate(s)] + [(1, 2026, 5), (5, 2021, 50), (5, 2023, 60)]
    got = {r["id"]: r for r in trends.momentum(spark.createDataFrame(rows, "id long, y int, n long"), 2026).collect()}
    assert set(got) == {1, 2, 3, 4}  # no zero fill: a missing year is no window
    assert got[1]["pct"] == 129 and got[1]["rising"] and not got[1]["glyph"] and got[1]["latest"] == 139
    assert [got[i]["rising"] for i in (2, 3, 4)] == [False, False, False]
    for i, s in series.items():
        slopes = sorted((math.log1p(b) - math.log1p(a)) / (y - x) for (x, a), (y, b) in itertools.combinations(enumerate(s), 2))
        assert abs(got[i]["slope"] - statistics.median(slopes)) < 1e-9 and abs(got[i]["p25"] - slopes[2]) < 1e-9


def test_canonical_urls(spark):
    cases = {
        "http://WWW.njit.edu/registrar/": "https://www.njit.edu/registrar",
        "https://www.njit.edu/": "https://www.njit.edu/",
        "https://x.njit.edu/p#sec": "https://x.njit.edu/p",
        "https://x.njit.edu/Path/?Audience=International": "https://x.njit.edu/Path?Audience=International",
        "mailto:a": "mailto:a",
    }
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    once = {r["u"]: (r["c"], r["d"]) for r in df.select("u", urls.canonical(F.col("u")).alias("c")).select("u", "c", urls.canonical(F.col("c")).alias("d")).collect()}
    assert {k: c for k, (c, _) in once.items()} == cases and all(c == d for c, d in once.values())
    pages = ['<link rel="canonical" href="https://informatics.njit.edu/option"/>', "<html></html>", '<link href="https://example.com/x" rel="canonical">']
    links = [r["l"] for r in spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i long, h string").orderBy("i").select(urls.canonical_link(F.col("h"), "njit.edu").alias("l")).collect()]
    assert links == ["https://informatics.njit.edu/option", None, None]


def test_components_split_and_crawl(spark):
    edges = [(RND.randrange(60), RND.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(7, None)]
    parent = {v: v for e in edges for v in e if v is not None and None not in e}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        if b is not None:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r["v"]: r["component"] for r in graph.components(df).collect()} == {v: find(v) for v in parent}
    examples = spark.createDataFrame([(v, v % 4) for v in range(145)], "id long, stratum long")
    parts = {r["id"]: (r["component"], r["part"]) for r in graph.disjoint_split(examples, df.dropna(), F.col("component") % 2 == 1).collect()}
    by = {}
    for c, p in parts.values():
        by.setdefault(c, set()).add(p)
    assert len(parts) == 145 and all(len(p) == 1 for p in by.values()) and {p for _, p in parts.values()} == {"train", "test"}
    assert all(any(p == "train" for i, (_, p) in parts.items() if i % 4 == s) for s in range(4))
    links = spark.createDataFrame([("u/a", "u/b"), ("u/a", "u/c"), ("u/b", "u/d"), ("u/d", "u/a"), ("u/c", "x/e"), ("u/d", "u/f")], "src string, dst string")
    seed = spark.createDataFrame([("u/a",), ("x/q",)], "url string")
    walk = lambda *a: {r["url"]: r["depth"] for r in graph.crawl(links, seed, *a, "u/").collect()}
    assert walk(9, 99) == {"u/a": 0, "u/b": 1, "u/c": 1, "u/d": 2, "u/f": 3}
    assert walk(9, 2) == {"u/a": 0, "u/b": 1} and walk(1, 99) == {"u/a": 0, "u/b": 1, "u/c": 1}


def test_keep_first_is_the_greedy_answer(spark):
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=(20, 8))
    v = np.concatenate([base[i % 20] + 0.25 * rnd.normal(size=8) for i in range(90)]).reshape(90, 8)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(500, None)], "vec_id long, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    pairs = graph.similar_pairs(df, 0.92)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {(i, j) for i, j in itertools.combinations(range(90), 2) if np.floor(u[i] @ u[j] * 1e6 + 0.5) / 1e6 >= 0.92}
    kept = []
    for i in range(90):
        if not any(u[i] @ u[j] >= 0.92 for j in kept):
            kept.append(i)
    got = {r["v"]: r["kept"] for r in graph.keep_first(df.select(F.col("vec_id").alias("v")), pairs).collect()}
    assert [i for i in range(90) if got[i]] == kept and got[500]


def test_retrieval_rules(spark):
    ranked = spark.createDataFrame([(1, d, 1.0 / d, d) for d in range(1, 7)], "item_id long, doc_id long, score double, place int")
    again = spark.createDataFrame([(1, 4, 9.0), (1, 2, 5.0), (1, 1, 1.0)], "item_id long, doc_id long, rescore double")
    got = [r["doc_id"] for r in retrieval.reranked(ranked, again, head=4).orderBy("slot").collect()]
    fresh = {d: 1 / (60 + d) + 1 / (10 + {4: 1, 2: 2, 1: 3, 3: 4}[d]) for d in range(1, 5)}
    assert got == [*sorted(fresh, key=lambda d: -fresh[d]), 5, 6]
    prior = spark.createDataFrame([(4, 0.5)], "doc_id long, prior double")
    assert [r["doc_id"] for r in retrieval.reranked(ranked, again, prior, head=4).orderBy("slot").collect()] == [2, 1, 3, 4, 5, 6]
    entities = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a"), (5, None)], "doc_id long, entity string")
    dealt = retrieval.diversified(ranked, entities)
    assert [r["doc_id"] for r in dealt.orderBy("slot").collect()] == [1, 3, 5, 6, 2, 4]
    profiles_ = spark.createDataFrame([("a", 90), ("b", 1)], "entity string, profile_id long")
    wide = retrieval.expanded(dealt, profiles_).orderBy("slot").collect()
    assert [(r["doc_id"], r["expanded"]) for r in wide] == [(90, True), (1, False), (3, False), (5, False), (6, False), (2, False), (4, False)]
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha gamma"), (3, "the of"), (4, None), (5, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "The alpha, of course: GAMMA"), (8, "the of")], "item_id long, text string")
    found = {(r["item_id"], r["place"]): r["doc_id"] for r in retrieval.bm25(docs, asked).collect()}
    assert found == {(7, 1): 2, (7, 2): 1, (8, 1): 3}  # stop words count only where nothing else is asked
    only = retrieval.bm25(docs, asked, allowed=docs.where("doc_id = 1").select("doc_id"))
    assert [(r["item_id"], r["doc_id"]) for r in only.collect()] == [(7, 1)]


def test_nearest_over_slices(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "SLICE", 30)
    monkeypatch.setattr(retrieval, "BLOCK", 4)
    rnd = np.random.default_rng(1)
    v, q = rnd.normal(size=(200, 6)), rnd.normal(size=(11, 6))
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)] + [(99, None)], "item_id long, embedding array<double>")
    got = {}
    for r in retrieval.nearest(vectors, asked, 7).orderBy("item_id", "place").collect():
        got.setdefault(r["item_id"], []).append(r["doc_id"])
    assert got == {i: sorted(range(200), key=lambda j: np.linalg.norm(v[j] - x))[:7] for i, x in enumerate(q)}  # noqa: B023


def test_vectors_that_cannot_be_compared(spark):
    """Null, empty, short, missing and non-finite numbers take no part; vectors meet questions of their length; repeated questions are one."""
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [1.0]), (6, [1.0, None]), (7, [1.0, float("nan")]), (8, [float("inf"), 0.0]), (9, [1.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = vectors.where("vec_id <> 1").selectExpr("vec_id as item_id", "embedding").union(spark.createDataFrame([(2, [0.0, 1.0])], "item_id long, embedding array<double>"))
    got = {(r["item_id"], r["doc_id"]): (r["score"], r["place"]) for r in retrieval.nearest(vectors, asked, 5).collect()}
    assert got == {(2, 2): (0.0, 1), (2, 1): (1.414214, 2), (5, 5): (0.0, 1), (9, 9): (0.0, 1)}
    assert retrieval.nearest(vectors.limit(0), asked, 5).count() == 0 and retrieval.nearest(vectors, asked.limit(0), 5).count() == 0
    assert retrieval.target_rank(vectors, asked, spark.createDataFrame([(2, 1), (9, 9), (5, 77)], "item_id long, target_id long")).collect()[0]["target_rank"] in (1, 2)


def test_descendants_of_any_depth(spark):
    rows = [(i, i - 1 if i else None, True) for i in range(12)] + [(100, 101, True), (101, 100, True), (50, 3, False), (51, 50, True)]
    got = {(r["ancestor"], r["id"]): r["depth"] for r in people.descendants(spark.createDataFrame(rows, "id long, parent_id long, active boolean")).collect()}
    want = {(a, b): b - a for a in range(12) for b in range(a, 12)} | {(100, 100): 0, (101, 101): 0, (100, 101): 1, (101, 100): 1, (50, 50): 0, (51, 51): 0, (50, 51): 1}
    assert got == want


def test_slots(spark):
    cases = [("Koutis", "what does kotis teach"), ("is", "what is his position"), ("Smith", "email smithson now"), ("He", "what is the position"), ("Ann Lee", "call lea"), ("", "x"), ("abc", "")]
    got = {r["id"]: r["grounded"] for r in slots.grounded(spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "id long, mention string, message string")).collect()}

    def plain(m, q):
        words = lambda t: [w for w in "".join(c if c.isalpha() else " " for c in t.lower()).split() if len(w) > 1]
        return any(x == y or (len(x) > 2 and len(y) > 2 and (x in y or y in x)) or difflib.SequenceMatcher(None, x, y).ratio() >= 0.8 for x in words(m) for y in words(q))

    assert got == {i: plain(*c) for i, c in enumerate(cases)}
    folk = spark.createDataFrame([(1, "Ann Koutis", 7), (2, "Bob Koutis", 8), (3, "Carla Mendez", 7), (4, "Karla Mendez", 8), (5, "Zoe Lamb", 7)], "person long, name string, org long")
    orgs = spark.createDataFrame([(7, "Physics"), (8, "History")], "org long, org_name string")
    asked = [(1, "ann koutis", ""), (2, "koutis", ""), (3, "lamb", ""), (4, "carla mendes", "the one in physics please"), (5, "carla mendes", ""), (6, "nobody here", ""), (7, "Zoe Lamb", "")]
    told = {r["id"]: (r["status"], r["person"], r["via"]) for r in slots.person_slots(spark.createDataFrame(asked, "id long, name string, message string"), folk, orgs, margin=9.0).collect()}
    assert told == {1: ("ok", 1, "exact"), 2: ("ambiguous", None, None), 3: ("ok", 5, "exact"), 4: ("ok", 3, "fuzzy"), 5: ("ambiguous", None, None), 6: ("none", None, None), 7: ("ok", 5, "exact")}


def test_chunks(spark):
    text = " ".join(f"word{i}{'.' if i % 9 == 8 else ''}" for i in range(200))
    docs = spark.createDataFrame([(1, text), (2, "short one"), (3, "  "), (4, None), (5, "x " * 90_000)], "doc_id long, text string")
    got = {}
    for r in chunks.chunks(docs, 40, 8).orderBy("doc_id", "chunk").collect():
        got.setdefault(r["doc_id"], []).append((r["text"], r["n_tokens"]))
    assert set(got) == {1, 2, 5} and got[2] == [("short one", 2)]
    assert all(n <= 40 and t.endswith(".") for t, n in got[1][:-1]) and all(x in " ".join(t for t, _ in got[1]) for x in text.split())
    assert sum(n for _, n in got[5]) - 8 * (len(got[5]) - 1) == 90_000
    mk = lambda rows: spark.createDataFrame(rows, "doc_id long, chunk int, text string")
    todo = chunks.upkeep(mk([(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (3, 0, "z")]), mk([(1, 0, "a"), (1, 1, "x"), (9, 0, "q"), (3, 0, "z")]), mk([(1, 0, ""), (1, 1, ""), (8, 0, ""), (9, 0, "")]))
    assert {(r["doc_id"], r["chunk"]): r["action"] for r in todo.collect()} == {(1, 1): "update", (2, 0): "insert", (9, 0): "delete", (3, 0): "embed", (8, 0): "drop_vector"}


def test_covering_against_all_pairs(spark):
    vocab = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(RND.choices(vocab, weights=range(1, 41), k=RND.randint(1, 25)))) for i in range(80)] + [(900, None), (901, "")]
    asked = [(i, " ".join(RND.choices(vocab, weights=range(1, 41), k=RND.randint(1, 8)))) for i in range(30)] + [(77, "unheard of words")]
    d, a = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "item_id long, text string")
    for least in (0.7, 1.0):
        got = {(r["item_id"], r["doc_id"]) for r in matching.covering(retrieval.asked_tokens(a), d, least).collect()}
        want = {(i, j) for i, q in asked for j, t in docs if len(set(q.split()) & set((t or "").split())) >= least * len(set(q.split()) - {"of"}) - 1e-9 and t}
        assert got == want
    cues = [("task", "for me"), ("live", r"\bnow\b")]
    rows = spark.createDataFrame([("Do it FOR ME now",), ("open now",), ("nowhere",), (None,)], "text string")
    assert [r["gate"] for r in matching.gate(rows, cues).collect()] == ["task", "live", "answerable", "answerable"]


def test_records(spark):
    t = spark.createDataFrame([(i, f"n{i}", None if i % 7 == 0 else i) for i in range(50)], "id long, name string, x long")
    same = records.copy_faults(t, t.repartition(5), "id", ["name", "x"])
    assert same.count() == 0
    other = t.where("id <> 3").withColumn("x", F.when(F.col("id") == 21, 5).otherwise(F.col("x")))
    keep = spark.conf.get("spark.sql.shuffle.partitions")
    digests = {r["bucket"]: r["n"] for r in records.row_digests(t, "id", ["name"], 10).collect()}
    assert digests == {b: 10 for b in range(5)} and keep
    assert [(r["bucket"], r["fault"]) for r in records.copy_faults(t, other, "id", ["name", "x"]).collect()] == [(0, "different")]
    ts = lambda m: f"2024-01-01 10:{m:02d}:00"
    left = [(i, ts(RND.randrange(3)), RND.sample("abcdef", 3)) for i in range(15)]
    right = [(i, ts(RND.randrange(3)), RND.sample("abcdef", 2)) for i in range(12)]
    mk = lambda rows: spark.createDataFrame(rows, "id long, ts string, tokens array<string>").withColumn("ts", F.to_timestamp("ts"))
    want, free = [], {r[0] for r in right}
    for i, t0, x in sorted(left):
        pool = [(-len(set(x) & set(y)), j) for j, t1, y in right if t1 == t0 and j in free and set(x) & set(y)]
        if pool:
            n, j = min(pool)
            free.discard(j)
            want.append((i, j, -n))
    assert sorted(tuple(r) for r in records.match_feeds(mk(left), mk(right)).collect()) == sorted(want)


def test_local_time(spark):
    e = spark.createDataFrame([(1, "2024-03-10 06:59:00"), (2, "2024-03-10 07:01:00"), (3, "2024-01-01 04:59:00"), (4, "2024-01-01 05:00:00")], "id long, t string").withColumn("ts", F.to_timestamp("t"))
    wall = {r["id"]: str(r["w"]) for r in e.select("id", times.local(F.col("ts")).alias("w")).collect()}
    assert wall == {1: "2024-03-10 01:59:00", 2: "2024-03-10 03:01:00", 3: "2023-12-31 23:59:00", 4: "2024-01-01 00:00:00"}
    assert {r["id"] for r in times.local_days(e, F.lit("2024-01-01 04:00:00").cast("timestamp"), 0).collect()} == {3}
    assert [r["s"] for r in e.orderBy("id").select(times.shown(F.col("ts")).alias("s")).collect()][0] == "Mar 10, 1:59 AM"
    back = e.select((times.utc(times.local(F.col("ts"))) == F.col("ts")).alias("same")).collect()
    assert all(r["same"] for r in back)


def test_profiles(spark):
    one = lambda c, x: spark.createDataFrame([(x,)], "t string").select(c(F.col("t")).alias("r")).first()["r"]
    assert one(profiles.venue, "Proceedings of the 12th Annual Conference on Things (KDD), 2019") == "KDD 2019"
    assert one(profiles.venue, "arXiv preprint arXiv:2101.1, 2021") == "arXiv 2021"
    assert one(profiles.office, "4105 Guttenberg Building (GITC)") == "4105 GITC"
    assert one(profiles.interests, "Teaching Interests; databases, machine learning ; Past Courses; CS 101") == ["databases", "machine learning"]
    rows = spark.createDataFrame([(1, 'A. Lee, B. Kim. "Deep things," Journal of X, 2018, 2020\n\nC. Ray. Plain title. Venue Y, 2011'), (2, None)], "id long, text string")
    got = [(r["title"], r["venue"], r["year"]) for r in profiles.citations(rows).orderBy("n").collect()]
    assert got[0] == ("Deep things", "Journal of X 2020", 2020) and got[1][2] == 2011
    taught = spark.createDataFrame([(1, "CS 610 Algorithms; CS 435 algorithms; CS101 Intro; CS 610 Other; note")], "id long, text string")
    assert {r["title"]: r["codes"] for r in profiles.courses(taught).collect()} == {"algorithms": "CS 435, CS 610", "intro": "CS 101"}
    html = '<h2>Faculty</h2><a href="/profile/ann/"><h1 class="name">Ann Lee</h1><p class="title">Professor</p></a><h3>Staff</h3><a href="https://p/profile/bob"><h1>Bob</h1></a><a href="/x">Physics Learn More</a>'
    page = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    assert [(r["slug"], r["name"], r["title"], r["section"]) for r in profiles.listing(page).orderBy("n").collect()] == [("ann", "Ann Lee", "Professor", "Faculty"), ("bob", "Bob", "", "Staff")]
    assert [(r["label"], r["url"]) for r in profiles.hub_links(page).collect()] == [("Physics", "/x")]


def test_markdown(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Top\nintro\n## Money\nQ: How much?\n**A:** Ten.\nMore.\n\nQ: When?\n**A:** Now.\n## Other\n### Deep\nbody text\n# Next\nend\n")
    docs = markdown.read_markdown(spark, str(tmp_path / "a.md"))
    assert [(r["section"], r["question"], r["answer"]) for r in markdown.faq(docs).orderBy("n").collect()] == [("Money", "How much?", "Ten.\nMore."), ("Money", "When?", "Now.")]
    assert {(r["path"], r["body"]) for r in markdown.sections(docs).collect() if "Q:" not in r["body"]} == {("Top", "intro"), ("Top > Other > Deep", "body text"), ("Next", "end")}


def test_people_skills(spark):
    orgs = spark.createDataFrame([(1, None, "U", "u", "root", True), (2, 1, "College", "coll", "college", True), (3, 2, "Dept", "dept", "department", True), (4, 2, "Old", "old", "department", False)], "id long, parent_id long, name string, slug string, type string, active boolean")
    folk = spark.createDataFrame([(10, "Ann"), (11, "Bob"), (12, "Cy")], "id long, name string")
    roles = spark.createDataFrame([(10, 3, "faculty", "Prof"), (10, 2, "staff", "Dean"), (11, 3, "staff", None), (12, 4, "faculty", "Prof")], "person long, org long, category string, title string")
    got = {(r["org"], r["person"]): r["title"] for r in people.people_in_org(folk, roles, orgs).collect()}
    assert got == {(1, 10): "Dean", (1, 11): None, (2, 10): "Dean", (2, 11): None, (3, 10): "Prof", (3, 11): None, (4, 12): "Prof"}
    m = spark.createDataFrame([(10, "cites", 5.0), (11, "cites", 5.0), (12, "cites", 9.0)], "person long, field string, value double")
    assert {(r["org"], r["person"]): r["place"] for r in people.top_by_metric(folk, roles, orgs, m, "cites").collect()}[(1, 11)] == 1
    q = spark.createDataFrame([(1, " COLL "), (2, "the college"), (3, "old"), (4, None)], "id long, name string")
    assert {r["id"]: r["org"] for r in people.resolve_org(orgs, q, spark.createDataFrame([("the college", "coll")], "alias string, slug string")).collect()} == {1: 2, 2: 2, 3: None, 4: None}
    assert people.orgs_by_type(orgs, "department", 2).count() == 1 and people.orgs_by_type(orgs, "nonsense").count() == 0
