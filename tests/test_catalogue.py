"""Every query against its DuckDB twin on the smallest tables, and the stateful ones against plain loops."""

import duckdb
import pandas as pd
import pytest

from korvane.plans.catalogue import ORACLES, QUERIES, flagship
from korvane.plans.sql import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple("" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(ORACLES[name]).df())


def test_flagship(spark):
    assert flagship(spark, SF).count() > 0


def test_rate_limit(spark):
    from korvane.streaming.limits import limited

    pdf = pd.DataFrame({"event_id": range(12), "user_id": [1] * 8 + [2] * 4, "ts": pd.to_datetime([0, 1, 2, 3, 4, 5, 61, 62, 0, 1, 2, 3], unit="s")})
    got = {r["event_id"]: r["accepted"] for r in limited(spark.createDataFrame(pdf)).collect()}
    assert [got[i] for i in range(12)] == [True] * 5 + [False, True, True] + [True] * 4


def test_rollup_stream_equals_batch(spark, tmp_path):
    from korvane.streaming.limits import rollup_stream

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.select("ts", "event_type", "value").repartition(2).write.parquet(str(tmp_path / "in"))
    stream = rollup_stream(spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("rollup").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    got = spark.table("rollup").select("start", "event_type", "n").toPandas()
    want = rollup_stream(events).select("start", "event_type", "n").toPandas()
    assert rows(got) == rows(want)
