"""Addresses and robots rules case by case, stratified draws against their definition."""

import ipaddress
import random

from pyspark.sql import functions as F

from korvane.functions import safety
from korvane.operators import sampling

RND = random.Random(3)


def test_addresses_as_the_library_has_them(spark):
    hosts = [str(ipaddress.IPv4Address(RND.getrandbits(32))) for _ in range(300)] + ["127.0.0.1", "10.1.2.3", "169.254.169.254", "192.168.0.1", "100.64.0.1", "8.8.8.8", "172.15.255.255", "172.32.0.0", "223.255.255.255", "224.0.0.1", "255.255.255.255"]
    hosts += ["::1", "fe80::1", "fc00::2", "2606:4700::1111", "2001:db8::1", "2001:4860:4860::8888", "::ffff:127.0.0.1", "2002:7f00:1::", "ff02::1", "::"]
    got = {r["h"]: r["p"] for r in spark.createDataFrame([(h,) for h in hosts], "h string").select("h", safety.public_address(F.col("h")).alias("p")).collect()}
    for h in hosts:
        a = ipaddress.ip_address(h)
        if h.startswith(("192.88.99.", "192.0.0.")):
            continue  # parts of these networks differ between versions of the registry
        assert got[h] == (a.is_global and not (a.is_loopback or a.is_link_local or a.is_reserved or a.is_multicast)), h


def test_safe_urls(spark):
    cases = {
        "https://example.com/a": True, "http://Example.COM:8080/": True, "ftp://example.com": False, "http://localhost/": False, "http://127.0.0.1/": False, "http://[::1]/": False, "http://8.8.8.8/x": True,
        "http://user:pw@10.0.0.1/": False, "http://user@example.com": True, "http://2130706433/": False, "http://0x7f.0.0.1/": False, "http://a.internal/": False, "http://010.0.0.1/": False, "http://single/": False,
        "javascript:alert(1)": False, "": False, "http://": False, "http://example.com\\@127.0.0.1/": True, "http://[2606:4700::1111]:443/": True,
    }
    got = {r["u"]: r["s"] for r in spark.createDataFrame([(u,) for u in [*cases, None]], "u string").select("u", safety.safe_url(F.col("u")).alias("s")).collect()}
    assert got == cases | {None: False}


def test_robots(spark):
    text = "User-agent: a\nUser-agent: bot\nDisallow: /x\nAllow: /x/y\nDisallow: /*.pdf$\n\nuser-agent: *\nDisallow: / # all\nAllow: /open\n"
    rules = safety.robots_rules(spark.createDataFrame([("H.org", text), ("empty.org", ""), ("none.org", None), (None, text), ("all.org", "User-agent: *\nDisallow:\n")], "host string, text string"))
    assert rules.count() == 8
    pages = {"http://h.org/x": (False, False), "http://h.org/x/y/z": (True, False), "http://h.org/a.pdf": (False, False), "http://h.org/a.pdf?v": (True, False), "http://h.org/open/1": (True, True), "http://h.org": (True, False), "http://empty.org/x": (True, True), "http://all.org/x": (True, True), "nonsense": (True, True)}
    df = spark.createDataFrame([(u, 1) for u in [*pages, None]], "url string, size int")
    for i, agent in enumerate(("MyBot/1.0", "other")):
        got = {r["url"]: r["allowed"] for r in safety.robots_allowed(df, rules, agent).collect()}
        assert got == {u: v[i] for u, v in pages.items()} | {None: True}
    tie = spark.createDataFrame([("h", "*", False, "/p"), ("h", "*", True, "/p")], "host string, agent string, allow boolean, path string")
    assert safety.robots_allowed(spark.createDataFrame([("http://h/p",)], "url string"), tie, "q").first()["allowed"]


def test_quotas(spark):
    for n in (0, 1, 7, 50, 99, 100, 1000):
        sizes = {"a": 61, "b": 25, "c": 13, "d": 1}
        got = {r["stratum"]: r["quota"] for r in sampling.quotas(spark.createDataFrame(list(sizes.items()), "stratum string, size long"), n).collect()}
        m = min(n, 100)
        low = {k: m * v // 100 for k, v in sizes.items()}
        more = sorted(sizes, key=lambda k: (-(m * sizes[k] % 100), k))[: m - sum(low.values())]
        assert got == {k: low[k] + (k in more) for k in sizes} and sum(got.values()) == m


def test_stratified(spark):
    rows = [(i, "big" if i % 10 else "small") for i in range(5000)] + [(i, "first") for i in range(0, 5000, 50)] + [(3, "big"), (None, "big"), (9, None)]
    df = spark.createDataFrame(rows, "id long, stratum string")
    one = {(r["id"], r["stratum"]) for r in sampling.stratified(df, 777, 5, ["first"]).collect()}
    two = {(r["id"], r["stratum"]) for r in sampling.stratified(df.repartition(7), 777, 5, ["first"]).collect()}
    assert one == two and len(one) == 777 == len({i for i, _ in one})
    assert {s for i, s in one if i % 50 == 0} <= {"first"}
    assert one != {(r["id"], r["stratum"]) for r in sampling.stratified(df, 777, 6, ["first"]).collect()}
    by_hash = {s: [r["id"] for r in sampling.placed(df, ["first"]).where(F.col("stratum") == s).orderBy(F.expr("cast(shiftrightunsigned(xxhash64(5, id), 54) as long)"), F.xxhash64(F.lit(5), F.col("id")), "id").collect()] for s in ("big", "small", "first")}
    for s, ids in by_hash.items():
        drawn = {i for i, t in one if t == s}
        assert drawn == set(ids[: len(drawn)])
    assert sampling.stratified(df, 10**6).count() == 5000 and sampling.stratified(df, 0).count() == 0 and sampling.stratified(df.limit(0), 5).count() == 0
