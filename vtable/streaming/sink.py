"""Streams into tables and out of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.resolve import DELETED
from ..table import Table


def upsert_batch(table: Table, name: str, order: str | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: upserts a micro-batch, whose `_d` rows are deletes, exactly once.

    The batch's number is in its commit, so a batch that is run again after a failure finds itself done. Of a batch's rows with one key the
    one with the highest order stays.
    """

    def run(batch: DataFrame, number: int) -> None:
        rows, key = batch, list(table.schema.key)
        if order is not None:
            rest = [c for c in batch.columns if c not in key]
            rows = batch.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*")
        names = [c.name for c in table.schema.columns if c.name in rows.columns] + ([DELETED] if DELETED in rows.columns else [])
        table.write(rows.select(*names), op="stream", batch=f"{name}:{number}")

    return run


def write_to(stream: DataFrame, table: Table, name: str, checkpoint: str, order: str | None = None) -> DataStreamWriter:
    """A writer that keeps table up to date with the stream; start() it."""
    return stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(upsert_batch(table, name, order))
