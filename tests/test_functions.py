"""Python operators against brute force, and files by round trips."""

import itertools

import pytest

from korvane.functions.fuzzy import CUT, common_length, fuzzy_names, indel_ratio, token_set, token_set_ratio
from korvane.sources import files
from korvane.streaming.matches import step, watch, watch_stream

READS = [(1, 1, "scheduled", 0, 1), (1, 2, "in_play", 0, 2), (1, 3, "in_play", 2, 3), (1, 4, "in_play", 1, 3), (1, 5, "in_play", 1, 4), (1, 6, None, None, 5), (1, 7, "done", 1, 6), (1, 8, "in_play", 3, 7), (2, 1, "in_play", 4, 1), (2, 2, "in_play", 5, 2)]
EVENTS = [(1, 2, "kickoff", 0), (1, 3, "goal", 2), (1, 3, "goal", 2), (1, 5, "correction", 1), (1, 7, "fulltime", 1), (2, 2, "goal", 5)]
SCHEMA = "match_id long, seq long, phase string, score long, updated long"


def test_fuzzy_equals_brute_force(spark):
    names = ["small ring", "smal ring", "large bolt", "large blt", "ab", "", None, "ring small", "small rings", "small ring"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {(r["asked"], r["known"]) for r in fuzzy_names(df, df).collect()}
    assert got == {(a, b) for a, b in itertools.product({n for n in names if n is not None}, repeat=2) if indel_ratio(a, b) >= CUT}


def test_ratios(spark):
    def table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            corner = 0
            for j, y in enumerate(b, 1):
                corner, row[j] = row[j], corner + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    words = ["", "a", "small ring", "ring small", "smalring", "éclair", "zz" * 40, "abcabcabc", "cbacbacba"]
    assert all(common_length(a, b) == table(a, b) for a, b in itertools.product(words, repeat=2))
    assert token_set_ratio("fuzzy was a bear", "was a bear") == 100.0 and token_set_ratio("", "a") == 0.0
    assert token_set_ratio("ann lee", "bob ray") == indel_ratio("ann lee", "bob ray")
    df = spark.createDataFrame([("ann marie lee", "lee ann x"), (None, "a")], "a string, b string")
    assert [r["t"] for r in df.select(token_set("a", "b").alias("t")).collect()] == [token_set_ratio("ann marie lee", "lee ann x"), None]


def test_match_watch(spark):
    got = sorted(tuple(r) for r in watch(spark.createDataFrame(READS, SCHEMA)).collect())
    assert got == sorted(EVENTS)
    assert watch(spark.createDataFrame([], SCHEMA)).collect() == []
    assert step(None, None, 1, 1) == (None, [])


def test_match_stream_equals_batch(spark, tmp_path):
    for i, part in enumerate((READS[:4], READS[4:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"p={i}"))
    reads = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in" / "p=*"))
    q = watch_stream(reads).writeStream.outputMode("append").format("memory").queryName("matches").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(90)
    assert sorted(tuple(r) for r in spark.table("matches").collect()) == sorted(EVENTS)


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,n\n1,2\nx,y\n3,\n")
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "a.csv"), "id long, n long").collect())) == [(1, 2), (3, None)]
    rows = spark.createDataFrame([(1, "a", 2.0), (1, "b", 4.0), (2, "a", None)], "k long, c string, p double")
    files.write_leaderboard(rows, str(tmp_path / "board"), "k", "c", "p", ["a", "b"])
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "board"), "k long, a double, b double").collect())) == [(1, 2.0, 4.0), (2, None, None)]
    files.write_json(rows, str(tmp_path / "j"))
    assert sorted(map(str, files.read_jsonl(spark, str(tmp_path / "j"), "k long, c string, p double").collect())) == sorted(map(str, rows.collect()))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text('{"k": 1}\n{"k": \n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "bad"), "k long").collect()
    urls = spark.createDataFrame([("http://a/?x=1&y=2",), (None,), ("http://a/?x=1&y=2",)], "url string")
    files.write_sitemap(urls, str(tmp_path / "map"))
    assert [r["loc"] for r in files.read_sitemap(spark, str(tmp_path / "map")).collect()] == ["http://a/?x=1&y=2"]
    import xml.etree.ElementTree as tree

    for part in (tmp_path / "map").glob("part-*"):
        root = tree.parse(part).getroot()
        assert root.tag.endswith("urlset") and [x.text for x in root.iter() if x.tag.endswith("loc")] == ["http://a/?x=1&y=2"]
    one, two = spark.createDataFrame([(1, "x")], "k long, v string"), spark.createDataFrame([("y", 1), ("z", 2)], "v string, k long")
    files.write_export(one, two, "k", str(tmp_path / "e"))
    assert sorted(map(tuple, files.read_jsonl(spark, str(tmp_path / "e"), "k long, v string").collect())) == [(1, "x"), (2, "z")]


def test_stream_isolates_bad_reads(spark, tmp_path):
    rows = [(1, 1, "in_play", "0", "1"), (1, 2, "in_play", "1", None), (1, 3, "in_play", "2", "3"), (2, 1, "in_play", "0", "1"), (2, 2, "done", "1", "2")]
    spark.createDataFrame(rows, "match_id long, seq long, phase string, score string, updated string").coalesce(1).write.parquet(str(tmp_path / "in"))
    reads = spark.readStream.schema("match_id long, seq long, phase string, score string, updated string").parquet(str(tmp_path / "in"))
    q = watch_stream(reads).writeStream.outputMode("append").format("memory").queryName("isolated").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(90)
    assert sorted(tuple(r) for r in spark.table("isolated").collect()) == [(1, 2, "error", 0), (1, 3, "goal", 2), (1, 3, "goal", 2), (2, 2, "fulltime", 1), (2, 2, "goal", 1)]
