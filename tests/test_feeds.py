"""Feeds matched without pairs."""

import random

from pyspark.sql import functions as F

from korvane.operators import records

RND = random.Random(7)
KIND = "id long, ts string, tokens array<string>"


def brute(left, right):
    want, free = [], {r[0] for r in right}
    for i, t0, x in sorted(left):
        pool = [(-len(set(x) & set(y)), j) for j, t1, y in right if t1 == t0 and j in free and set(x) & set(y)]
        if pool:
            n, j = min(pool)
            free.discard(j)
            want.append((i, j, -n))
    return sorted(want)


def test_feeds_make_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(records, "CHOICES", 3)  # choices are forgotten and ranked anew
    mk = lambda rows: spark.createDataFrame(rows, KIND).withColumn("ts", F.to_timestamp("ts"))
    row = lambda i, k: (i, f"2024-01-01 10:{RND.randrange(2):02d}:00", RND.sample("abcdef", k))
    left, right = [row(i, RND.choice((1, 2, 3))) for i in range(200)], [row(i, RND.choice((1, 2))) for i in range(150)]
    got = records.match_feeds(mk(left), mk(right))
    assert sorted(tuple(r) for r in got.collect()) == brute(left, right)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()  # a busy minute costs its rows, not its pairs
    odd = [(1, None, ["a"]), (2, "2024-01-01 10:00:00", None), (3, "2024-01-01 10:00:00", [None]), (4, "2024-01-01 10:00:00", [])]
    assert records.match_feeds(mk(odd), mk(odd)).count() == 0
