"""Keyed tables: merges against plain dictionaries, replays, failures, versions."""

import random

import pytest
from pyspark.sql import functions as F

from korvane.store.tables import Conflict, KeyedTable, Version

SCHEMA = "id long, part string, x double, note string"


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, ["id", "part"], buckets=4)


def state(df):
    return {(r["id"], r["part"]): (r["x"], r["note"]) for r in df.collect()}


def test_merges_equal_a_dictionary(spark, table):
    rnd, held, audit, states = random.Random(2), {}, [], [{}]
    for n in range(1, 5):
        rows = [(rnd.randint(0, 30), rnd.choice("ab"), float(rnd.randint(0, 3)), rnd.choice([None, "u", "v"]), rnd.choice(["upsert", "upsert", "insert", "delete"]), i) for i in range(60)]
        rows += [(None, "a", 1.0, "lost", "upsert", 99)]
        df = spark.createDataFrame(rows, f"{SCHEMA}, op string, at int")
        v = table.merge(df, f"b{n}", op=F.col("op"), order=F.col("at"))
        last = {(r[0], r[1]): r for r in rows if r[0] is not None}
        before = dict(held)
        for k, r in last.items():
            if r[4] == "delete":
                held.pop(k, None)
            elif r[4] == "upsert" or k not in held:
                held[k] = (r[2], r[3])
        for k in last:
            if before.get(k) != held.get(k):
                audit.append((k, "insert" if k not in before else "delete" if k not in held else "update", n, *(held.get(k) or before[k])))
        states.append(dict(held))
        assert v.number == n and v.refused == 1 and state(table.read()) == held
    got = [((r["id"], r["part"]), r["action"], r["version"], r["x"], r["note"]) for r in table.audit().collect()]
    assert sorted(got, key=str) == sorted(audit, key=str)
    for n, s in enumerate(states):
        assert state(table.read(n)) == s
        spans = table.history().where((F.col("since") <= n) & (F.col("until").isNull() | (F.col("until") > n)))
        assert state(spans) == s
    table.compact_audit()
    assert table.audit().count() == len(audit) and state(table.read()) == held
    assert table.vacuum() > 0 and state(table.read()) == held and table.audit().count() == len(audit)


def test_replay_changes_nothing(spark, table):
    df = spark.createDataFrame([(1, "a", 1.0, None), (2, "b", 2.0, "n")], SCHEMA)
    one = table.merge(df, "first")
    assert table.merge(df, "first") == one and table.audit().count() == 2
    same = table.merge(df, "again")  # another name, the same rows: a version, but no change
    assert same.number == 2 and table.audit().count() == 2
    assert table.merge(df.limit(0), "none").number == 3 and table.read().count() == 2


def test_keep_nulls_and_computed_values(spark, table):
    mk = lambda *rows: spark.createDataFrame(rows, SCHEMA)
    table.merge(mk((1, "a", 1.0, "kept"), (2, "a", 5.0, None)), "one")
    table.merge(mk((1, "a", 9.0, None), (2, "a", None, "late")), "two", keep_nulls=True)
    assert state(table.read()) == {(1, "a"): (9.0, "kept"), (2, "a"): (5.0, "late")}
    total = {"x": F.coalesce(F.col("old.x"), F.lit(0)) + F.col("new.x")}
    table.merge(mk((1, "a", 1.0, "sum"), (3, "a", 2.0, "new")), "three", set_values=total)
    assert state(table.read()) == {(1, "a"): (10.0, "sum"), (2, "a"): (5.0, "late"), (3, "a"): (2.0, "new")}


def test_failed_write_leaves_the_old_version(spark, table):
    good = spark.createDataFrame([(i, "a", 1.0, "ok") for i in range(20)], SCHEMA)
    table.merge(good, "good")
    bad = good.withColumn("x", F.when(F.col("id") == 7, F.raise_error(F.lit("broken"))).otherwise(F.lit(2.0)))
    with pytest.raises(Exception, match="broken"):
        table.merge(bad, "bad")
    assert table.latest() == 1 and table.read().where("x = 1.0").count() == 20 and table.audit().count() == 20
    table.merge(good.withColumn("x", F.lit(2.0)), "bad")  # the name is free: nothing of it was committed
    assert table.read().where("x = 2.0").count() == 20


def test_second_writer_fails(spark, table, monkeypatch):
    df = spark.createDataFrame([(1, "a", 1.0, "x")], SCHEMA)
    table.merge(df, "mine")
    monkeypatch.setattr(table, "version", lambda number=None: Version())  # it read the log before the other one wrote
    with pytest.raises(Conflict):
        table.merge(df, "theirs")
    monkeypatch.undo()
    assert table.version().batch == "mine" and table.read().count() == 1


def test_only_touched_buckets_are_rewritten(spark, table):
    table.merge(spark.createDataFrame([(i, "a", 1.0, "x") for i in range(50)], SCHEMA), "all")
    a, b = table.version(), table.merge(spark.createDataFrame([(3, "a", 2.0, "y")], SCHEMA), "one")
    assert sum(a.buckets[k] != b.buckets[k] for k in a.buckets) == 1 and len(a.buckets) == 4


def test_a_batch_is_computed_once(spark, tmp_path):
    """Refused rows are counted on the way; inserts of what is there touch no bucket; a merge writes its rows once."""
    table = KeyedTable(spark, f"file://{tmp_path}/once", "id long, x double", ["id"])
    met = spark.sparkContext.accumulator(0)

    def told(it):
        for b in it:
            met.add(b.num_rows)
            yield b

    df = spark.createDataFrame([(i, 1.0) for i in range(20)] + [(None, 2.0), (None, 3.0)], "id long, x double").mapInArrow(told, "id long, x double")
    assert table.merge(df, "a", "insert").refused == 2 and met.value == 22
    first = table.version()
    second = table.merge(df, "b", "insert")
    assert second.refused == 2 and second.buckets == first.buckets and second.audit == first.audit and met.value == 44
    assert table.read().count() == table.audit().count() == 20
