import os
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.streaming import timers as W

SCHEMA = "key string, ts timestamp, kind string, value int"


@pytest.fixture
def events(spark, tmp_path):
    """A table of events, and a stream that reads them in four batches, not quite in order; the last one moves the clock on."""
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", "c", None]), 1_000_000 + rng.randrange(400), rng.choice(["started", "retried", "finalized", "failed", "other", None]), i) for i in range(150)]
    rows += [rows[5], ("x", None, "started", 0), ("edge", 1_000_000, "started", 1), ("edge", 1_000_010, "started", 2), ("edge", 1_000_021, "started", 3)]
    rows.sort(key=lambda r: (r[1] or 0) + rng.randrange(8))
    rows.append(("clock", 1_009_000, "started", 9))
    table = spark.createDataFrame(rows, "key string, s long, kind string, value int").select("key", F.timestamp_seconds("s").alias("ts"), "kind", "value")
    cuts = [0, 40, 80, 120, len(rows) - 1, len(rows)]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = str(tmp_path / f"part{i}")
        spark.createDataFrame(rows[a:b], "key string, s long, kind string, value int").select("key", F.timestamp_seconds("s").alias("ts"), "kind", "value").coalesce(1).write.parquet(part)
        (file,) = [f for f in os.listdir(part) if f.endswith(".parquet")]
        (tmp_path / "in").mkdir(exist_ok=True)
        os.rename(f"{part}/{file}", tmp_path / "in" / f"{i}.parquet")
        os.utime(tmp_path / "in" / f"{i}.parquet", (1000 + i, 1000 + i))
    return table, spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path)


def rows_of(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_second_look(spark, events):
    table, stream, folder = events
    whole = W.refreshes(table)
    got = {(r["key"], r["at"].timestamp(), r["kind"]) for r in whole.where("key = 'edge'").collect()}
    assert got == {("edge", 1_000_000.0, "now"), ("edge", 1_000_010.0, "now"), ("edge", 1_000_021.0, "now"), ("edge", 1_000_020.0, "later"), ("edge", 1_000_031.0, "later")}
    streamed = W.run_to_table(W.refreshes_stream(stream, "20 seconds"), f"{folder}/out", f"{folder}/cp")
    assert rows_of(streamed) == rows_of(whole.where("kind = 'now' or key is distinct from 'clock'"))


def test_uploads_without_an_answer(spark, events):
    table, stream, folder = events
    whole = W.unanswered(table, 10)
    assert {r["at"].timestamp() for r in whole.where("key = 'edge'").collect()} == {1_000_020.0, 1_000_031.0}
    streamed = W.run_to_table(W.unanswered_stream(stream, 10, "20 seconds"), f"{folder}/out", f"{folder}/cp")
    assert rows_of(streamed) == rows_of(whole.where("key is distinct from 'clock'")) != []
    ends = spark.createDataFrame([("k", 0, "started"), ("k", 0, "failed"), ("k", 5, "retried"), ("k", 9, "removed"), ("l", 0, "started"), ("l", 11, "finalized")], "key string, s long, kind string").select("key", F.timestamp_seconds("s").alias("ts"), "kind")
    assert [(r["key"], r["at"].timestamp()) for r in W.unanswered(ends, 10).collect()] == [("l", 10.0)]


def test_values_at_rest(spark, events):
    table, stream, folder = events
    table = table.where("ts is not null")
    whole = W.settled(table, ("value",), 5, order="value")
    streamed = W.run_to_table(W.settled(stream.where("ts is not null"), ("value",), 5, late="20 seconds", order="value"), f"{folder}/out", f"{folder}/cp")
    assert rows_of(streamed) == rows_of(whole.where("key is distinct from 'clock'")) != []
    near = spark.createDataFrame([(1, 0), (2, 200), (3, 400), (4, 1000)], "value int, ms long").select(F.lit("s").alias("key"), F.timestamp_millis("ms").alias("ts"), "value")
    assert sorted((r["value"], r["at"].timestamp()) for r in W.settled(near, ("value",)).collect()) == [(3, 0.7), (4, 1.3)]
