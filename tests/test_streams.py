"""Exact daily admission on a stream against the same caps on stored events."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vellumgrid.streaming import limits

SCHEMA = "ts timestamp, event_id long, user_id long"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def at(day, second):
    return dt.datetime(2025, 3, day, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=second)


def admitted(rows):
    return sorted((r["event_id"], r["user_id"], r["ts"]) for r in rows.collect())


def test_streamed_admission_equals_the_stored_one(rocks, tmp_path):
    """Calls out of order, repeated ones and ties; late ones are as if they had never come."""
    rng = random.Random(7)
    calls = [(at(1 + i % 3, rng.randrange(86_400)), i, rng.choice([1, 1, 1, 2, 3, 4 + i % 20])) for i in range(400)]
    calls += [(at(1, 50), 1000 + i, 7) for i in range(8)] + [(at(2, 86_399), 2000, 9), (at(3, 0), 2001, 9)]
    files = [[], [], []]
    for c in rng.sample(calls, len(calls)):
        files[0 if c[0] < at(2, 43_200) and rng.random() < 0.7 else rng.choice([0, 1])].append(c)
    files[1] += rng.sample(calls, 60)  # again
    files[2] += [(at(9, 0), 9000, 1)]  # moves the watermark past the third day
    late = [(at(1, 1), 9100 + i, 50 + i) for i in range(5)]
    source = str(tmp_path / "in")
    run = lambda: limits.admit_stream(rocks.readStream.schema(SCHEMA).parquet(source), str(tmp_path / "out"), str(tmp_path / "c"), "3 days", per_visitor=4, total=30).awaitTermination(300)
    for rows in files:
        rocks.createDataFrame(rows, SCHEMA).repartition(2).write.mode("append").parquet(source)
        run()
    rocks.createDataFrame([*late, (at(9, 1), 9001, 1)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    run()
    stored = limits.daily_caps(rocks.createDataFrame(list(dict.fromkeys(calls)), SCHEMA), per_visitor=4, total=30).where("admitted")
    got = rocks.read.parquet(str(tmp_path / "out"))
    assert admitted(got) == admitted(stored)
    assert {r["n"] for r in got.groupBy("day").agg(F.count("*").alias("n")).collect()} == {30}
    assert got.groupBy("day", "user_id").count().agg(F.max("count")).first()[0] == 4
