"""Scheduler, delivery states and unsending against a plain walk; replays and restarts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from korvane.operators.scoring import validated
from korvane.store.outbox import ATTEMPTS, Outbox

T0 = dt.datetime(2024, 5, 1, 12)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def lit(minutes):
    return F.lit(at(minutes)).cast("timestamp")


@pytest.fixture
def box(spark, tmp_path):
    return Outbox(spark, f"file://{tmp_path}/box", buckets=2)


REQUEST = "source string, id long, request_key string, org long, type string, content string, scheduled_for timestamp, delete_at timestamp"
OUTCOME = "key string, platform string, message string, success boolean, error string, at timestamp"
TRY = "key string, platform string, seq long, success boolean, error string, terminal boolean"


def states(box):
    return {r["key"]: r["status"] for r in box.posts.read().collect()}


def filled(spark, box):
    rows = [("feed", 1, None, 7, "news", "a", at(0), at(30)), ("feed", None, "k", 7, "news", "b", None, at(30)), ("feed", None, None, 7, "news", "c", at(50), None), ("feed", None, None, 7, "news", "c", at(99), None)]
    return box.enqueue(spark.createDataFrame(rows, REQUEST), "in")


def test_enqueue_once(spark, box):
    import hashlib

    new = {r["key"] for r in filled(spark, box).collect()}
    auto = "feed:auto:" + hashlib.sha1(b"7|news|c").hexdigest()
    assert new == {"feed:1", "feed:k", auto} == set(states(box))
    again = [("feed", 1, None, 7, "news", "changed", at(0), None), ("feed", 2, None, None, None, None, None, None)]
    assert [r["key"] for r in box.enqueue(spark.createDataFrame(again, REQUEST), "more").collect()] == ["feed:2"]
    assert box.posts.read().where("key = 'feed:1'").first()["content"] == "a"


def test_tick(spark, box):
    filled(spark, box)
    mk = lambda *rows: spark.createDataFrame(rows, "template string, content string, enabled boolean, every_s long, next_run timestamp")
    box.templates.merge(mk(("t", "hello", True, 600, at(-25)), ("off", "x", False, 600, at(-25)), ("later", "y", True, 60, at(5))), "templates")
    claimed = {r["key"] for r in box.tick(lit(1), "tick-1").collect()}
    assert claimed == {"feed:1", "feed:k", "template:t:2024-05-01 11:35:00"}
    assert {r["key"] for r in box.tick(lit(1), "tick-1").collect()} == claimed  # replayed: the same claims, nothing new
    assert box.templates.read().where("template = 't'").first()["next_run"] == at(5)
    assert box.tick(lit(2), "tick-2").count() == 0
    assert {r["key"] for r in box.tick(lit(7), "tick-3").collect()} == {"template:t:2024-05-01 12:05:00", "template:later:2024-05-01 12:05:00"}


def sent(spark, box):
    filled(spark, box)
    box.tick(lit(1), "tick")
    rows = [("feed:1", "x", "m1", False, "timeout", at(2)), ("feed:1", "y", "m2", True, None, at(3)), ("feed:k", "x", None, False, "down", at(2)), ("nobody", "x", "m", True, None, at(2)), (None, "x", "m", True, None, at(2))]
    return spark.createDataFrame(rows, OUTCOME)


def test_settle(spark, box):
    told = sent(spark, box)
    box.settle(told, "s1")
    want = {"feed:1": "sent", "feed:k": "failed"}
    assert {k: v for k, v in states(box).items() if v != "scheduled"} == want
    box.settle(told, "s1")
    box.settle(told.withColumn("success", ~F.col("success")), "s2")  # nothing follows the end
    assert {k: v for k, v in states(box).items() if v != "scheduled"} == want
    assert box.posts.read().where("key = 'feed:1'").first()["sent_at"] == at(3) and box.deliveries.read().count() == 3


def test_unsend_against_a_walk(spark, box):
    filled(spark, box)
    box.tick(lit(1), "tick")
    kinds = {
        "gone": [(False, "Message NOT FOUND", False)], "fine": [(True, None, False)], "cannot": [(False, "unsupported here", False)], "never": [(False, "no rights", True)],
        "slow": [(False, "timeout", False)] * 2 + [(True, None, False)], "lost": [(False, "timeout", False)] * (ATTEMPTS + 1), "waits": [(False, "timeout", False)] * 2,
    }
    ok = [("feed:1", p, f"m-{p}", True, None, at(2)) for p in kinds] + [("feed:1", "bare", None, True, None, at(2)), ("feed:1", "bad", "m", False, "e", at(2))]
    box.settle(spark.createDataFrame(ok, OUTCOME), "s")
    assert box.due_to_go(lit(29)).count() == 0 and box.due_to_go(lit(31)).count() == len(ok)
    tries = [("feed:1", p, i, s, e, t) for p, told in kinds.items() for i, (s, e, t) in enumerate(told)]
    box.unsend(spark.createDataFrame(tries, TRY), lit(31), "u1")

    def walk(told, held=0):
        for s, e, t in told:
            e = (e or "").lower()
            if s or "not found" in e or "unknown message" in e:
                return "deleted", held
            if "unsupported" in e:
                return "delete_unsupported", held
            if t:
                return "delete_failed", held
            held += 1
            if held >= ATTEMPTS:
                return "delete_failed", held
        return None, held

    got = {r["platform"]: (r["delete_status"], r["delete_attempts"]) for r in box.deliveries.read().collect()}
    assert got == {p: walk(t) for p, t in kinds.items()} | {"bare": ("not_applicable", 0), "bad": ("not_applicable", 0)}
    assert box.posts.read().where("key = 'feed:1'").first()["deleted_at"] is None
    more = spark.createDataFrame([("feed:1", "waits", i, False, "timeout", False) for i in range(9)] + [("feed:1", "fine", 1, False, "no rights", True)], TRY)
    box.unsend(more, lit(40), "u2")
    box.unsend(more, lit(40), "u2")
    assert box.deliveries.read().where("platform = 'waits'").first()["delete_attempts"] == ATTEMPTS
    assert box.deliveries.read().where("platform = 'fine'").first()["delete_status"] == "deleted"
    assert box.posts.read().where("key = 'feed:1'").first()["deleted_at"] == at(40) and box.due_to_go(lit(99)).count() == 0


def test_stream_restarts_where_it_stopped(spark, box, tmp_path):
    told = sent(spark, box)
    source, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    told.where("platform = 'x'").coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema(OUTCOME).parquet(source)
    assert box.follow(stream(), "q", mark).awaitTermination(120)
    assert states(box)["feed:1"] == "failed"
    versions = box.posts.latest()
    assert box.follow(stream(), "q", mark).awaitTermination(120)  # nothing new
    assert box.posts.latest() == versions
    box.enqueue(spark.createDataFrame([("feed", 9, None, 1, "n", "z", None, None)], REQUEST), "late")
    box.tick(lit(5), "tick-2")
    spark.createDataFrame([("feed:9", "x", "m", True, None, at(6)), ("feed:1", "y", "m", True, None, at(6))], OUTCOME).coalesce(1).write.mode("append").parquet(source)
    assert box.follow(stream(), "q", mark).awaitTermination(120)
    assert states(box)["feed:9"] == "sent" and states(box)["feed:1"] == "failed"
    box.settle(spark.createDataFrame([("feed:9", "x", "m", False, "e", at(7))], OUTCOME), "q-1")  # that batch is in the log
    assert states(box)["feed:9"] == "sent"


def test_validated_scores(spark):
    rows = [(1, [5, 6]), (2, [5]), (3, [5, 11]), (4, None), (5, [None, 3]), (6, [0, 10]), (7, [])]
    got = {r["id"]: (r["fault"], r["final_score"]) for r in validated(spark.createDataFrame(rows, "id long, s array<int>"), "s", 2, 0, 10).collect()}
    assert got == {1: (None, 5.5), 2: ("count", None), 3: ("range", None), 4: ("count", None), 5: ("missing", None), 6: (None, 5.0), 7: ("count", None)}
