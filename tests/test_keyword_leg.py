"""BM25 summed where documents lie against the join of weights, and plain Python."""

import math
import random
from collections import Counter

import pytest

from korvane.operators import retrieval as r

RND = random.Random(8)
WORDS = ["ab", "cd", "ef", "gh", "rare", "xx", "yy"]


@pytest.mark.parametrize("okapi", [False, True])
def test_both_ways_give_the_same(spark, monkeypatch, okapi):
    texts = [(i, " ".join(RND.choices(WORDS, weights=[9, 5, 5, 3, 1, 2, 2], k=RND.randint(0, 12)))) for i in range(-20, 60)]
    texts += [(3, "ab rare"), (None, "rare rare xx"), (99, None), (100, "")]  # a repeated document, one without id, two without tokens
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    asked = {"a": "ab cd", "b": "rare", "c": "the", "d": "nowhere yy xx", "e": None, "f": "ab ab ab ef gh"}
    items = spark.createDataFrame(list(asked.items()), "item_id string, text string")
    some = spark.createDataFrame([(i,) for i in range(0, 60, 3)], "doc_id long")

    def told(allowed=None, k=4):
        return sorted(((x["item_id"], x["place"], x["doc_id"], x["score"]) for x in r.bm25(docs, items, k, allowed, okapi).collect()), key=str)

    monkeypatch.setattr(r, "PAIRS", 7)
    near = told(), told(some)
    monkeypatch.setattr(r, "SMALL", 0)
    assert near == (told(), told(some)) and near[0] != near[1]
    lengths = [len((t or "").split()) for _, t in texts]
    mean, best = sum(lengths) / len(texts), Counter()
    df = sum(1 for _, t in texts if "rare" in (t or ""))
    if not okapi:
        for (d, t), n in zip(texts, lengths, strict=True):
            if tf := (t or "").split().count("rare"):
                best[d] += max(math.log((len(texts) - df + 0.5) / (df + 0.5)), r.FLOOR) * tf * (r.K1 + 1) / (tf + r.K1 * (1 - r.B + r.B * n / mean))
        assert [x[3] for x in near[0] if x[0] == "b"] == pytest.approx(sorted(best.values(), reverse=True)[:4], abs=2e-6)
