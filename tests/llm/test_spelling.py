"""Spelling variants against comparison of all pairs and plain counting."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from korvane.llm import spelling
from korvane.llm.queries import QUERIES

RND = random.Random(21)
SCHEMA = "doc_id long, text string, word string, n long, `key` string, form int, root int, at int"


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def by_hand(words, ratio=5):
    out, forms = {}, {}
    for w, n in words.items():
        own = [x for x in words if near(w, x)]
        best = min(own, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= ratio * n else None
        out[w] = len(own)
    rows = set()
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        rows.add((w, forms[w], root, n, out[w], forms[w] and words[forms[w]]))
    return rows


def variant(w):
    i, c = RND.randrange(len(w)), RND.choice("abcdeéßüx")
    return RND.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])


def counted(texts, least, every, some):
    c = Counter()
    for d, t in texts:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            c[w] += 1
    return {w: n for w, n in c.items() if len(w) >= least and n >= some}


def tuples(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("letters", ["ab", "abcdeé", "aaaaab", "日本語文字"])
def test_all_pairs(spark, letters):
    words = {"".join(RND.choice(letters) for _ in range(RND.randint(4, 10))) for _ in range(120)}
    for w in list(words)[:60]:
        v = variant(w)
        words |= {x for x in (v, variant(v) if len(v) > 4 else v) if len(x) >= 4}
    words = {w: RND.choice([5, 5, 7, 30, 200, 1200, 9000, 50_000]) for w in words}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    assert tuples(spelling.group_variants(df)) == by_hand(words)
    pairs = {(r["a"], r["b"]): (r["a_n"], r["b_n"]) for r in spelling.near_pairs(df).collect()}
    assert pairs == {(a, b): (words[a], words[b]) for a in words for b in words if a < b and near(a, b)}


def test_chain_of_forms(spark):
    """Each word leads to the next one, five times as frequent: the root is the end of the chain."""
    words = {"abcdef" + "x" * i: 5 * 5**i for i in range(14)}
    got = {r["word"]: r for r in spelling.group_variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert all(got[w]["root"] == "abcdef" + "x" * 13 for w in words) and got["abcdef"]["form"] == "abcdefx"


def test_texts(spark):
    stems = ["".join(RND.choice("aeinorstÄé") for _ in range(RND.randint(5, 9))) for _ in range(40)]
    texts = []
    for i in range(120):
        ws = [RND.choice(stems[: RND.choice([3, 10, 40])]) for _ in range(RND.randint(0, 90))]
        ws = [variant(w) if RND.random() < 0.1 else w.upper() if RND.random() < 0.1 else w for w in ws]
        texts.append((i, " ".join(ws)))
    texts += [(500, None), (501, ""), (502, "a" * 100_000), (503, "ÀÉ×÷ " * 3000 + "it's x_y1z"), (None, " ".join(stems * 3)), texts[4], (504, "wörter" * 3)]
    df = spark.createDataFrame([(d, t, "w", 1, "k", 2, 3, 4) for d, t in texts], SCHEMA).repartition(4)
    for every in (7, 199, None):
        want = counted(texts, 6, every, 2)
        assert len(want) > 50
        words = spelling.count_words(df, 6, every).where("n >= 2")
        assert {r["word"]: r["n"] for r in words.collect()} == want
    assert tuples(spelling.group_variants(words)) == by_hand(want)
    for none in (df.limit(0), df.where("text is null"), df.where("doc_id = 501")):
        assert spelling.group_variants(spelling.count_words(none)).count() == 0


def test_marks():
    often = Counter(RND.choice("abcd") + RND.choice("abcd") for _ in range(300))
    for _ in range(300):
        w = "".join(RND.choice("abcd") for _ in range(RND.randint(4, 12)))
        prefix, pivots = spelling.marks(w, often)
        order = sorted((often.get(w[i : i + 2], 0), w[i : i + 2], i) for i in range(len(w) - 1))
        assert {i for *_, i in order[:3]} <= set(prefix)
        pairs = [(a + b, i, j) for a, _, i in order[:3] for b, _, j in order[:3] if j >= i + 2]
        assert pivots[1] >= pivots[0] + 2 and sum(often.get(w[i : i + 2], 0) for i in pivots) == min(pairs)[0]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text")).collect()]
    got = tuples(QUERIES["op11_spelling"](spark, sf))
    want = counted(rows, 6, 199, 5)
    assert got == by_hand(want) and len(got) > 500


def test_tables_that_grow_with_the_words_are_not_sent_through_the_driver(spark):
    words = spark.createDataFrame([("letters", 50), ("lettters", 5), ("lettttters", 5), ("another", 9)], "word string, n long")
    got = spelling.group_variants(words)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r["word"], r["form"], r["root"]) for r in got.collect()} == {("letters", None, "letters"), ("lettters", "letters", "letters"), ("lettttters", None, "lettttters"), ("another", None, "another")}
