"""Files and other stores as sources and sinks of tables."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Endings and the formats that they stand for.
ENDINGS = {"csv": "csv", "tsv": "csv", "json": "json", "jsonl": "json", "parquet": "parquet", "orc": "orc", "avro": "avro", "txt": "text", "xml": "xml"}


def format_of(path: str) -> str:
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    try:
        return ENDINGS[ending]
    except KeyError:
        raise ValueError(f"no format is known for {path}") from None


def load(spark: SparkSession, path: str, schema: T.StructType | str, kind: str | None = None, **options: Any) -> DataFrame:
    """Files in any format that Spark reads. A schema is asked for, so that no pass is spent on guessing it."""
    kind = kind or format_of(path)
    defaults = {"header": True, "sep": "\t" if path.endswith(".tsv") else ","} if kind == "csv" else {}
    return spark.read.format(kind).schema(schema).options(**defaults | options).load(path)


def save(df: DataFrame, path: str, kind: str | None = None, mode: str = "error", partition_by: tuple[str, ...] = (), **options: Any) -> None:
    kind = kind or format_of(path)
    defaults = {"header": True, "sep": "\t" if path.endswith(".tsv") else ","} if kind == "csv" else {}
    out = df.write.format(kind).mode(mode).options(**defaults | options)
    (out.partitionBy(*partition_by) if partition_by else out).save(path)


def jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, low: int | None = None, high: int | None = None, parts: int = 8, **options: Any) -> DataFrame:
    """A table of another database; with a numeric key and its bounds it is read in parts."""
    given = {"url": url, "dbtable": table} | options
    if key is not None:
        given |= {"partitionColumn": key, "lowerBound": low, "upperBound": high, "numPartitions": parts}
    return spark.read.format("jdbc").options(**given).load()


def kafka(spark: SparkSession, servers: str, topic: str, stream: bool = True, **options: Any) -> DataFrame:
    """A topic's records; Spark's connector must be on the class path."""
    reader = spark.readStream if stream else spark.read
    return reader.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic} | options).load()
