"""Sample sizes by hand, intervals against resampling whole questions."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from korvane.operators import power


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_sizes(spark):
    L = F.lit
    assert one(spark, power.required_facts(L(0.5), 0.05)) == 384 and one(spark, power.required_facts(L(0.0), 0.05)) == 0
    assert one(spark, power.required_questions(L(0.5), L(2.0), 0.05)) == 192 and one(spark, power.required_questions(L(0.5), L(0.0), 0.05)) is None
    for half, n, m in ((0.1, 50, 0.05), (0.07, 33, 0.05), (0.02, 50, 0.05), (0.0, 50, 0.05), (0.1, 0, 0.05), (0.1, 50, 0.0)):
        want = n if m <= 0 or half <= 0 or n <= 0 else max(n, math.ceil(n * (half / m) ** 2))
        assert one(spark, power.questions_for_margin(L(half), L(n), m)) == want if m > 0 else True


def test_bootstrap(spark):
    rnd = random.Random(4)
    records = []
    for q in range(120):
        p = rnd.choice([0.1, 0.6])
        records += [(q, rnd.choice(["find", "rank", "answer"]), rnd.random() < p) for _ in range(rnd.randint(1, 9))]
    df = spark.createDataFrame(records + [(None, "x", True)], "question long, stage string, missed boolean")
    a, b = (power.bootstrap(d, 800, 3).first() for d in (df, df.repartition(7)))
    assert {k: round(a[k], 9) for k in a.asDict()} == {k: round(b[k], 9) for k in b.asDict()}
    by = {}
    for q, _, m in records:
        by.setdefault(q, []).append(m)
    keys, draws = list(by), []
    for _ in range(2000):
        take = [rnd.choice(keys) for _ in keys]
        draws.append(sum(sum(by[q]) for q in take) / sum(len(by[q]) for q in take))
    draws.sort()
    assert a["share"] == sum(map(sum, by.values())) / len(records) and (a["questions"], a["facts"]) == (120, len(records))
    assert abs(a["low"] - draws[50]) < 0.02 and abs(a["high"] - draws[1950]) < 0.02
    p = power.power(df, draws=800, seed=3).first()
    assert p["questions_5"] == max(120, math.ceil(120 * (p["half_width"] / 0.05) ** 2)) and p["facts_10"] == round(1.96**2 * p["share"] * (1 - p["share"]) / 0.01)
    misses = [s for q, s, m in records if m]
    per = len(records) / 120
    got = {r["stage"]: (r["misses"], round(r["share"], 9), r["questions"]) for r in power.by_stage(df).collect()}
    for s in set(misses):
        c, t = misses.count(s), len(misses)
        adj = (c + 2) / (t + 4)
        assert got[s] == (c, round(c / t, 9), round(1.96**2 * adj * (1 - adj) / 0.01 / per))
    none = power.bootstrap(df.limit(0), 50).first()
    assert (none["share"], none["low"], none["high"], none["questions"]) == (0.0, 0.0, 0.0, 0) and power.by_stage(df.limit(0)).count() == 0
    assert np.isfinite(none["half_width"])
