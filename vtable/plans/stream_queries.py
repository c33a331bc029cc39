"""Streaming queries, run to the end of what is there; their results equal the batch's."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.options import Options
from ..sources.schema import TableSchema
from ..sources.workspace import new_folder, read
from ..streaming import windows
from ..streaming.sink import write_to
from ..streaming.stateful import running_totals
from ..table import Table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a file stream; a file's name is a pattern that only it matches."""
    return spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events*.parquet")


def finished(df: DataFrame) -> DataFrame:
    """All rows of a windowed aggregate, run to the end: each batch is a whole result, and the last one is kept in a file."""
    spark, folder = df.sparkSession, new_folder(df.sparkSession)
    last: list[str] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/{number}")
        last.append(f"{folder}/out/{number}")

    q = df.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/cp").queryName(f"w{uuid.uuid4().hex}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(last[-1])


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS start, (date_trunc('hour', ts) + INTERVAL 1 HOUR)::TIMESTAMP AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    return finished(windows.tumbling(events(spark, sf_dir), "1 hour", "event_type", late="1 day"))


@query(
    """SELECT s AS start, s + INTERVAL 2 HOUR AS "end", count(*) AS n, round(sum(value), 4) AS total
FROM (SELECT value, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR])::TIMESTAMP AS s FROM events) GROUP BY ALL"""
)
def stream_sliding(spark, sf_dir):
    return finished(windows.sliding(events(spark, sf_dir), "2 hours", "1 hour", late="1 day"))


@query(
    """SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 10 MINUTE AS "end", count(*) AS n, round(sum(value), 4) AS total FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) s FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END new FROM events))
GROUP BY user_id, s"""
)
def stream_session(spark, sf_dir):
    return finished(windows.session(events(spark, sf_dir), "10 minutes", "user_id", late="1 day"))


@query("SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) rn FROM events) WHERE rn = 1 AND event_type <> 'error'")
def stream_upsert(spark, sf_dir):
    folder = new_folder(spark)
    stream = events(spark, sf_dir).select("user_id", "event_type", "value", "event_id", (F.col("event_type") == "error").alias("_d"))
    table = Table.create(spark, f"{folder}/t", TableSchema.of("events", stream.select("user_id", "event_type", "value").schema, ["user_id"]), options=Options(sync="OFF"))
    write_to(stream, table, f"u{uuid.uuid4().hex}", f"{folder}/cp", order="event_id").trigger(availableNow=True).start().awaitTermination()
    return table.read()


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def stream_stateful(spark, sf_dir):
    """Running totals by user; each micro-batch's go to a table, whose last word on a user is the total."""
    folder = new_folder(spark)
    totals = running_totals(events(spark, sf_dir), "user_id", "value")
    table = Table.create(spark, f"{folder}/t", TableSchema.of("totals", totals.schema, ["user_id"]), options=Options(sync="OFF"))
    write_to(totals, table, f"t{uuid.uuid4().hex}", f"{folder}/cp").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    return table.read().withColumn("total", F.round("total", 4))


def in_files(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """events as a stream of three files, one for each micro-batch: those with an even number but for the last hours, those of the last hours, and
    those with an odd number. A batch drops what is older than the watermark of the one before it, so the third drops what is late."""
    rows = read(spark, sf_dir, "events")
    even = rows.where("event_id % 2 = 0")
    top = F.lit(even.agg(F.max("ts")).first()[0]).cast("timestamp_ntz")
    recent = (F.col("ts") >= top - F.expr("INTERVAL 12 HOURS")) & (F.col("ts") < top)
    for part in (even.where(~recent), even.where(recent), rows.where("event_id % 2 = 1")):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(0.05)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def appended(df: DataFrame, folder: str) -> DataFrame:
    """All rows that the stream gives in append mode, run to the end of what is there."""
    q = df.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").queryName(f"a{uuid.uuid4().hex}").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out")


@query(
    """WITH w AS (SELECT max(ts) FILTER (WHERE event_id % 2 = 0) - INTERVAL 1 DAY AS first, max(ts) - INTERVAL 1 DAY AS last FROM events),
e AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS s, event_id, value FROM events)
SELECT s AS start, s + INTERVAL 1 HOUR AS "end", count(*) AS n, round(sum(value), 4) AS total FROM e, w
WHERE (event_id % 2 = 0 OR s + INTERVAL 1 HOUR > first) AND s + INTERVAL 1 HOUR <= last GROUP BY s"""
)
def stream_append_late(spark, sf_dir):
    """Windows in append mode: each is given once, when the watermark has passed it, and rows that come later are dropped. The last file's
    rows are as old as the first's, so all but those of the last day are late."""
    folder = new_folder(spark)
    return appended(windows.tumbling(in_files(spark, sf_dir, folder), "1 hour", late="1 day"), folder)


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_deduplicated(spark, sf_dir):
    """The first row of each user and type, whatever comes later within the watermark."""
    folder = new_folder(spark)
    return appended(windows.deduplicated(in_files(spark, sf_dir, folder), "user_id", "event_type", late="10000 days").select("user_id", "event_type"), folder)
