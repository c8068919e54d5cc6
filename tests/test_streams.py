from pyspark.sql import functions as F

from tallyspark.streaming import changes as C


def test_latest_and_windows(spark):
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00", 7, "a"), (2, "2024-01-01 00:00:00", 7, "b"), (3, "2024-01-01 00:06:00", 8, "a")], "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert {(r["user_id"], r["event_type"]) for r in C.latest_by_key(events).collect()} == {(7, "b"), (8, "a")}
    assert C.windowed_counts(events).count() == 3


def test_upsert_stream(spark, tmp_path):
    schema = "id string, ord long, vendor string"
    spark.createDataFrame([("a", 0, "new"), ("c", 1, "new")], schema).write.parquet(str(tmp_path / "in"))
    table = {"rows": [("a", 0, "old"), ("b", 1, "old")]}
    read = lambda: spark.createDataFrame(table["rows"], schema)
    write = lambda df: table.update(rows=[tuple(r) for r in df.select("id", "ord", "vendor").collect()])
    for _ in range(2):  # a second query finds nothing new
        query = C.upsert_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), read, write, str(tmp_path / "cp"))
        query.awaitTermination()
        assert {(r[0], r[2]) for r in table["rows"]} == {("a", "new"), ("b", "old"), ("c", "new")}
