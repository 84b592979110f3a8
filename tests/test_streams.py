"""Streams with restarts: each event once, cadence by a clock in the data, the pull source."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from korvane.sources.pull import PullSource, draft
from korvane.streaming import cadence, emission

T0 = dt.datetime(2024, 5, 1, 12)


def s(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def run(query):
    assert query.awaitTermination(120)


def test_event_keys(spark):
    rows = [(7, "goal", None, 0, 1, 0), (7, "goal", None, 2, 1, 0), (7, "goal", "p9-33", 2, 1, 0), (7, "correction", None, 1, 0, 0), (7, "kickoff", None, None, None, None), (7, "goal", "", None, 2, 1)]
    df = spark.createDataFrame(rows, "m long, k string, u string, g int, h int, a int")
    keys = [r[0] for r in df.select(emission.event_key(*map(F.col, "mkugha"))).collect()]
    assert keys == ["7:goal:1-0", "7:goal:2:1-0", "7:goal:p9-33", "7:correction:1:0-0", "7:kickoff:", "7:goal:2-1"]


def test_each_event_once(spark, tmp_path):
    """Two micro-batches, a restart between them, repeats in the same and in later batches, and late ones."""
    schema = "key string, at timestamp, n int"
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    batches = [[("a", s(0), 1), ("a", s(0), 1), ("b", s(5), 2), (None, s(5), 9)], [("a", s(0), 1), ("c", s(60), 3), ("b", s(5), 2)], [("c", s(60), 3), ("d", s(90), 4), ("a", s(0), 1), ("e", None, 5)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        for _ in range(2):  # the second start finds nothing new
            run(emission.emit(spark.readStream.schema(schema).parquet(source), "key", "at", out, mark, "1 hour"))
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    everything = spark.read.schema(schema).parquet(source)
    assert got == [("a", s(0), 1), ("b", s(5), 2), ("c", s(60), 3), ("d", s(90), 4)]
    assert got == sorted(tuple(r) for r in emission.emitted_once(everything, "key", "at").collect())


def test_pace():
    p = cadence.Pace(kickoff=1000)
    assert p.every(0) == p.every(1000 + cadence.GRACE - 1) == cadence.HOT and p.every(1000 + cadence.GRACE) == cadence.COOL
    p.take("started", 1001, None)
    assert p.every(1002) == cadence.COOL
    p.take("event", 1100, None)
    assert p.every(1100 + cadence.HOT_FOR - 1) == cadence.HOT and p.every(1100 + cadence.HOT_FOR) == cadence.COOL
    p.take("done", 1300, None)
    p.take("event", 1400, None)
    assert p.done and p.hot_until == 1100 + cadence.HOT_FOR


def test_cadence_by_a_clock(spark, tmp_path):
    """Match 1 is hot after an event and cools down, 2 has been quiet since its beginning, 3 ends; match 0 only moves the clock."""
    source, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    asked = []

    def tell(*rows):
        spark.createDataFrame(rows, cadence.ROWS).coalesce(1).write.mode("append").parquet(source)
        stream = cadence.asks(spark.readStream.schema(cadence.ROWS).parquet(source))
        keep = lambda df, _: asked.extend((r["match_id"], (r["at"] - T0).total_seconds(), r["every_s"]) for r in df.where("match_id > 0").collect())
        run(stream.writeStream.foreachBatch(keep).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start())

    clock = lambda t: (0, s(t), "schedule", s(100_000))
    tell(clock(0))
    tell((1, s(1), "event", s(0)), (2, s(1), "started", s(0)), (3, s(1), "event", s(0)), clock(10))
    for t in (12, 14, 16):
        tell(clock(t))
    one = [a for a in asked if a[0] == 1]
    assert len(one) >= 3 and all(e == cadence.HOT for *_, e in one) and all(b[1] - a[1] >= cadence.HOT for a, b in zip(one, one[1:]))
    assert len([a for a in asked if a[0] == 2]) <= 1
    tell((3, s(17), "done", None), clock(18))
    before = len([a for a in asked if a[0] == 3])
    for t in (60, 200, 230, 260):
        tell(clock(t))
    assert len([a for a in asked if a[0] == 3]) == before  # an ended match is not asked
    late = [a for a in asked if a[0] == 1 and a[1] >= 200]
    assert late and late[-1][2] == cadence.COOL  # its event is old by now
    assert {e for m, _, e in asked if m == 2} == {cadence.COOL}


def test_pull_source(spark, tmp_path):
    folder, out, mark = (str(tmp_path / x) for x in ("drop", "out", "mark"))
    os.makedirs(folder)

    def put(name, *lines):
        with open(f"{folder}/_{name}", "w") as f:
            f.write("\n".join(lines))
        os.rename(f"{folder}/_{name}", f"{folder}/{name}")

    spark.dataSource.register(PullSource)
    start = lambda: run(spark.readStream.format("drafts").option("path", folder).load().writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start())
    good = lambda i: json.dumps({"source": "s", "id": i, "content": f"c{i}", "more": 1})
    put("b.jsonl", good(1), "", "no json", good(2))
    start()
    start()
    put("a.jsonl", good(3), "[1]", json.dumps({"source": "s"}))  # an earlier name, but a later file
    with open(f"{folder}/c.jsonl", "wb") as f:
        f.write(b"\xff\xfe")
    start()
    got = spark.read.parquet(out)
    assert sorted(r["id"] for r in got.where("fault is null").collect()) == [1, 2, 3]
    assert sorted((r["file"], r["line"], r["fault"]) for r in got.where("fault is not null and line is not null").collect()) == [("a.jsonl", 1, "not an object"), ("a.jsonl", 2, "no source or content"), ("b.jsonl", 2, "not JSON")]
    assert got.where("file = 'c.jsonl'").count() == 1


@pytest.mark.parametrize("text", ['{"source": "s", "content": 5}', '{"source": "s", "content": "x", "id": true}', '{"source": "s", "content": "x", "org": "y"}'])
def test_draft_types(text):
    assert draft(text)[-1] == "wrong type"
