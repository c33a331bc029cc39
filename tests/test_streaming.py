"""Streams into tables, change feeds, windows."""

from pyspark.sql import functions as F

from vtable.streaming.sink import upsert_batch, write_to
from vtable.streaming.source import register
from vtable.streaming.windows import deduplicated, session, sliding, tumbling
from vtable.table import Table


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_upsert_stream(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    for k in range(2):
        events.where(f"event_id % 2 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    t = Table.create(spark, f"{tmp_path}/t", "user_id INT PRIMARY KEY, event_id INT, value REAL")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = write_to(stream.select("user_id", "event_id", "value", (F.col("event_type") == "error").alias("_d")), t, "s", f"{tmp_path}/cp", order="event_id").trigger(availableNow=True).start()
    q.awaitTermination()
    assert t.version == 3
    assert all(r.problems == 0 for r in t.check().collect())
    v = t.version
    upsert_batch(t, "s")(spark.createDataFrame([(1, 1)], "user_id long, event_id long"), 1)  # a batch that is run again
    assert t.version == v


def test_change_feed(spark, tmp_path):
    t = Table.create(spark, f"{tmp_path}/t", "id INT PRIMARY KEY, v TEXT")
    t.insert([(1, "a"), (2, "b")])
    t.delete("id = 1")
    register(spark)
    got = spark.read.format("vtable_changes").load(f"{tmp_path}/t")
    want = rows(t.changes().select("id", "v", "_d", "_v"))
    assert rows(got) == want
    assert rows(spark.read.format("vtable_changes").option("after", 2).load(f"{tmp_path}/t")) == [(1, "a", True, 3)]
    q = spark.readStream.format("vtable_changes").load(f"{tmp_path}/t").writeStream.format("memory").queryName("feed").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    t.insert([(3, "c")])
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("feed")) == rows(t.changes().select("id", "v", "_d", "_v"))


def test_windows_equal_batch(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    for name, f in (("w1", lambda d, late: tumbling(d, "1 hour", "event_type", late=late)), ("w2", lambda d, late: sliding(d, "2 hours", "1 hour", late=late)), ("w3", lambda d, late: session(d, "10 minutes", "user_id", late=late))):
        q = f(stream, "1 day").writeStream.format("memory").outputMode("complete").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        assert rows(spark.table(name)) == rows(f(events, None)), name
    q = deduplicated(stream.union(stream), "event_id", late="10 days").writeStream.format("memory").queryName("w4").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("w4").count() == events.count()
