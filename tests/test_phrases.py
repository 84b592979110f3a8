"""Leftmost-longest phrases against a plain scan, by trie and by join; masks."""

import random
import re

import pytest
from pyspark.sql import functions as F

from korvane.functions import phrases as ph

RND = random.Random(4)
WORDS = ["a", "b", "c", "Dd", "é", "z9"]


def plain(text, known):
    ws = [(m.group().casefold(), *m.span()) for m in re.finditer(r"[^\W_]+", text or "")]
    out, i = [], 0
    while i < len(ws):
        fit = [(len(q), -p) for p, q in known if q and [w for w, *_ in ws[i : i + len(q)]] == q]
        if not fit:
            i += 1
            continue
        n, p = max(fit)
        out.append((-p, ws[i][1], ws[i + n - 1][2], n))
        i += n
    return out


@pytest.fixture(scope="module")
def data(spark):
    texts = [" ".join(RND.choice(WORDS) + RND.choice(["", ",", "_", "."]) for _ in range(RND.randint(0, 30))) for _ in range(60)] + [None, "", "A b" * 3000, "ab-a_b"]
    known = [(i, [w.casefold() for w in RND.choices(WORDS, k=RND.randint(1, 4))]) for i in range(25)] + [(99, []), (7, ["c", "c", "c", "c", "c"])]
    t = spark.createDataFrame([(i, x, i) for i, x in enumerate(texts)], "text_id long, text string, words long")
    p = spark.createDataFrame([(i, " ".join(q).upper(), f"k{i % 3}") for i, q in known] + [(None, "a", "k"), (50, None, "k")], "phrase_id long, text string, kind string")
    return texts, known, t, p


@pytest.mark.parametrize("held", [ph.HELD, 0])
def test_find(spark, data, monkeypatch, held):
    texts, known, t, p = data
    monkeypatch.setattr(ph, "HELD", held)
    want = sorted((i, *m) for i, x in enumerate(texts) for m in plain(x, known))
    assert sorted(tuple(r) for r in ph.find(t, p).collect()) == want
    assert sorted(tuple(r) for r in ph.find(t.union(t.limit(5)), p).collect()) == sorted(want + [m for m in want if m[0] in {r[0] for r in t.limit(5).collect()}])
    best = {i: max((n, -q) for j, q, _, _, n in want if j == i) for i, *_ in want}
    assert {r["text_id"]: (r["words"], -r["phrase_id"]) for r in ph.longest(t, p).collect()} == best
    assert ph.find(t.limit(0), p).count() == 0 and ph.find(t, p.limit(0)).count() == 0


def test_mask(spark, data):
    texts, known, t, p = data
    got = {r["text_id"]: (r["text"], r["words"]) for r in ph.mask(t, p.where("phrase_id <> 50")).collect()}
    for i, x in enumerate(texts):
        out, end = "", 0
        for q, a, b, _ in plain(x, known):
            out, end = out + x[end:a] + f"<{min(f'k{j % 3}' for j, _ in known if j == q)}>", b
        assert got[i] == (None if x is None else out + x[end:], i)


def test_all_sentences_over_all_conversations(spark):
    sf = "/root/testdata/sf0.001"
    c = spark.read.parquet(f"{sf}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("text_id"), "text")
    b = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", F.explode(F.split("text", "[ .,]+")).alias("text")).where("length(text) > 3")
    p = b.groupBy("text").agg(F.min("item_id").alias("phrase_id"))
    known = [(r["phrase_id"], [w.casefold() for w in re.findall(r"[^\W_]+", r["text"])]) for r in p.collect()]
    words = {tuple(q): min(i for i, r in known if r == q) for _, q in known if q}
    got = sorted(tuple(r) for r in ph.find(c, p).collect())
    want = []
    for r in c.collect():  # single words, so a scan word by word is the whole story but for parts with an apostrophe
        ws = [(m.group().casefold(), *m.span()) for m in re.finditer(r"[^\W_]+", r["text"] or "")]
        i = 0
        while i < len(ws):
            n = max((n for n in range(1, min(3, len(ws) - i) + 1) if tuple(w for w, *_ in ws[i : i + n]) in words), default=0)
            if n:
                want.append((r["text_id"], words[tuple(w for w, *_ in ws[i : i + n])], ws[i][1], ws[i + n - 1][2], n))
            i += max(n, 1)
    assert got == sorted(want) and len(got) > 100


@pytest.mark.parametrize("held", [ph.HELD, 0])
def test_longest_of_overlapping_phrases(spark, monkeypatch, held):
    monkeypatch.setattr(ph, "HELD", held)
    t = spark.createDataFrame([(1, "x a b c d"), (2, "a b"), (3, "b c d a b"), (4, "c")], "text_id long, text string")
    p = spark.createDataFrame([(5, "a b"), (6, "b c d"), (4, "a b")], "phrase_id long, text string")
    assert sorted(tuple(r) for r in ph.longest(t, p, overlapping=True).collect()) == [(1, 6, 3), (2, 4, 2), (3, 6, 3)]
    assert sorted(tuple(r) for r in ph.longest(t, p).collect()) == [(1, 4, 2), (2, 4, 2), (3, 6, 3)]
    assert sorted((r["text_id"], r["phrase_id"], r["words"]) for r in ph.find(t, p, overlapping=True).collect()) == [(1, 4, 2), (1, 6, 3), (2, 4, 2), (3, 4, 2), (3, 6, 3)]
